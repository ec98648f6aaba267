"""Log directories as streams of parsed events.

Lines come from growing files (``tail.follow``): appended bytes, rotation and truncation
are followed, and the place reached is in the stream's checkpoint. Folders in a store that
only Spark reads, where whole files land, are read with ``follow=False``. Audit records of
one event arrive together; the group is emitted once the watermark has passed its time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.detect import Rule, annotate
from emberwatch.operators.scoring import with_threat
from emberwatch.schema import normalise
from emberwatch.sources import audit, honeypot, store, zeek
from emberwatch.streaming import tail


def tail_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None, follow: bool = True, pattern: str = "*") -> DataFrame:
    """Lines of the files of ``folder``: ``value, file, line_id``.

    With ``follow=False`` a file is read once, when it appears, and its lines have no id
    that tells equal ones apart.
    """
    if follow and files_per_batch is None:
        return tail.follow(spark, folder, pattern).select("value", "file", "line_id")
    reader = spark.readStream.format("text").option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select("value", F.col("_metadata.file_name").alias("file"), F.lit(None).cast("string").alias("line_id"))


def _kept() -> dict:
    return {"line_id": F.col("line_id")}


def zeek_stream(spark: SparkSession, folder: str, sensor: str, follow: bool = True) -> DataFrame:
    """Sensor logs; the log kind is the file name up to the first dot."""
    lines = tail_lines(spark, folder, follow=follow).withColumn("log", F.substring_index("file", ".", 1))
    return normalise(zeek.zeek_events(zeek.parse_lines(lines), sensor, _kept()))


def honeypot_stream(spark: SparkSession, folder: str, sensor: str, follow: bool = True) -> DataFrame:
    return normalise(honeypot.honeypot_events(honeypot.parse_lines(tail_lines(spark, folder, follow=follow)), sensor, _kept()))


def audit_groups_stream(spark: SparkSession, folder: str, delay: str = "30 seconds", follow: bool = True) -> DataFrame:
    """Audit record groups by file, id and time. All records of an event carry the same time."""
    parsed = audit.parse_lines(tail_lines(spark, folder, follow=follow))
    parsed = parsed.withColumn("ts", F.timestamp_micros((F.col("ts_epoch") * 1_000_000).cast("bigint"))).withWatermark("ts", delay)
    return parsed.groupBy("ts", "file", "audit_id").agg(
        F.min("ts_epoch").alias("ts_epoch"), F.collect_list("kv").alias("records"), F.min("line_id").alias("line_id"))


def raw_log_stream(spark: SparkSession, folder: str, follow: bool = True) -> DataFrame:
    lines = tail_lines(spark, folder, follow=follow).withColumn("line_no", F.lit(None).cast("bigint"))
    return normalise(audit.raw_events(lines, _kept()))


def detect_and_score(events: DataFrame, rules: list[Rule], semantics: str = "strict") -> DataFrame:
    """Rule hits and threat score of every event. Stateless: the same on tables and streams."""
    return with_threat(annotate(events, rules, semantics))


def start_table(events: DataFrame, path: str, checkpoint: str, interval: str | None = "2 seconds", name: str | None = None):
    """Write a stream as plain Parquet, partitioned by day; ``interval=None`` drains what is there and stops.

    The file sink commits every micro-batch once, also after a restart from the checkpoint.
    """
    out = events.withColumn("dt", F.date_format("ts", "yyyy.MM.dd"))
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("dt").outputMode("append")
    if name:
        writer = writer.queryName(name)
    return _triggered(writer, interval).start()


def _triggered(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def start_family(events: DataFrame, root: str, checkpoint: str, stream: str, family: str = "unified-logs", late: str | None = None,
                 late_family: str = "late-events", day_shift_hours: int = 0, interval: str | None = "2 seconds"):
    """Write a stream of events to an index family: ids, times and categories filled, every micro-batch once.

    ``stream`` names the writer; it stays the same over restarts and is used by one query at
    a time. ``late`` names a boolean column: rows where it is true go to ``late_family``
    instead, so that none is lost. See ``store.write_batch`` for what a repeated batch does.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if late is None:
            store.write_batch(batch, batch_id, root, family, stream, day_shift_hours)
            return
        behind = F.coalesce(F.col(f"`{late}`"), F.lit(False))
        batch = batch.persist()  # two writes, one run of the stream's plan
        try:
            store.write_batch(batch.where(behind).drop(late), batch_id, root, late_family, stream, day_shift_hours)
            store.write_batch(batch.where(~behind).drop(late), batch_id, root, family, stream, day_shift_hours)
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return _triggered(writer, interval).start()


def start_split(rows: DataFrame, path: str, late_path: str, checkpoint: str, late: str = "late", interval: str | None = "2 seconds"):
    """Write the rows of a keyed stream to one table and its late rows to another, every micro-batch once.

    Each batch has a folder of its own, which a repeated batch writes anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for target, keep in ((late_path, F.col(late)), (path, ~F.col(late))):
                batch.where(keep).drop(late).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return _triggered(writer, interval).start()

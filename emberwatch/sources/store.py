"""Event tables on files: daily partitions, index families, committed micro-batches and range queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.columns import col, contains_any, filled, index_day, iso, parse_iso, text
from emberwatch.functions.files import Folder
from emberwatch.functions.ordered import with_running_sum
from emberwatch.schema import conform, event_schema, normalise
from emberwatch.session import cut_lineage

# Index families searched together and login words of the category inference.
INDEX_FAMILIES = ["unified-logs", "network-flows", "honeypot-logs", "host-logs"]
LOGIN_WORDS = ["login", "logon", "logout", "logoff", "auth"]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines events in the unified schema with ``ts`` and the case they came from."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    out = conform(lines)
    return out.withColumn("case_id", F.regexp_replace("file_name", r"\.[^.]*$", "")).drop("file_name")


def infer_category() -> Column:
    """Category of an event that states none: memory, login, network, file, process."""
    action, outcome = text(col("event.action")), text(col("event.outcome"))
    has = lambda p: filled(col(p)).isNotNull()
    return F.coalesce(
        filled(col("event.category")),
        F.when(F.size(F.coalesce(col("memory.anomalies"), F.array())) > 0, F.lit("memory")),
        F.when(contains_any(action, LOGIN_WORDS) | (outcome.isin("success", "failure") & (has("user.name") | has("source.ip"))),
               F.lit("authentication")),
        F.when(has("network.protocol") | has("source.ip") | has("destination.ip"), F.lit("network")),
        F.when(has("file.path") | has("file.name"), F.lit("file")),
        F.when((F.coalesce(col("process.pid"), F.lit(0)) != 0) | has("process.executable") | has("process.name"), F.lit("process")),
    )


def _uuid(digest: Column) -> Column:
    """32 hex digits in the form of an event id (8-4-4-4-12)."""
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def with_ids(df: DataFrame) -> DataFrame:
    """Fill missing event ids from the row's content, so that a repeated job gives the same ones.

    Equal rows are told apart by an occurrence number, counted per input partition and
    carried over the partitions, so that a row that makes up most of the table is counted by
    many tasks. Rows with a ``line_id`` are never equal and need no counting.
    """
    own = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    event = F.col("event")
    if "line_id" in df.columns:
        return df.withColumn("event", event.withField("id", F.coalesce(filled(col("event.id")), _uuid(own))))
    missing = filled(col("event.id")).isNull()
    # the partition of a row must not change between the passes below
    rows = cut_lineage(df.where(missing).withColumns({"__h": own, "__p": F.spark_partition_id().cast("long"), "__m": F.monotonically_increasing_id()}))
    rows = with_running_sum(rows, ["__h"], "__p", ["__m"], F.lit(1).cast("long"), "__n")
    digest = F.when(F.col("__n") == 1, F.col("__h")).otherwise(F.md5(F.concat_ws(":", "__h", "__n")))
    rows = rows.withColumn("event", event.withField("id", _uuid(digest))).select(df.columns)
    return df.where(~missing).unionByName(rows)


def prepare(df: DataFrame) -> DataFrame:
    """Fill id, time and category before writing."""
    df = with_ids(df)
    ev = F.col("event").withField("category", infer_category())
    stamp = F.coalesce(filled(F.col("`@timestamp`")), iso(F.current_timestamp()))
    return df.withColumns({"event": ev, "@timestamp": stamp}).withColumn("ts", parse_iso(F.col("`@timestamp`")))


# The batch of rows that no stream wrote, and what separates a stream's name from its batch number.
APPENDED, AT = "append", "@"
#: Commit files kept per stream; the newest one says how far a stream is visible.
KEPT_COMMITS = 100


def _write(df: DataFrame, root: str, family: str, batch: str, day_shift_hours: int) -> dict[str, int]:
    ready = df.withColumn("dt", index_day(F.col("ts"), day_shift_hours))
    seen = Observation()
    ready = ready.observe(seen, F.count_if(F.col("dt").isNotNull()).alias("success"), F.count_if(F.col("dt").isNull()).alias("failed"))
    ready = ready.withColumns({"dt": F.coalesce("dt", F.lit("rejected")), "batch": F.lit(batch)})
    ready.write.mode("append").partitionBy("dt", "batch").parquet(f"{root}/{family}")
    return {"success": seen.get["success"], "failed": seen.get["failed"]}


def write_events(df: DataFrame, root: str, family: str = "unified-logs", day_shift_hours: int = 0) -> dict[str, int]:
    """Append to the daily partitions of one index family; returns how many rows were written and refused.

    Rows whose time cannot be read go to the family's partition ``dt=rejected``.
    """
    return _write(prepare(df), root, family, APPENDED, day_shift_hours)


def _commits(spark: SparkSession, root: str, family: str, stream: str) -> Folder:
    return Folder(spark, f"{root}/{family}/_commits/{stream}")


def committed(spark: SparkSession, root: str, family: str, stream: str) -> int:
    """Number of the stream's last committed batch; -1 before the first."""
    return max((int(n.removesuffix(".json")) for n in _commits(spark, root, family, stream).names() if n.endswith(".json")), default=-1)


def write_batch(df: DataFrame, batch_id: int, root: str, family: str, stream: str, day_shift_hours: int = 0) -> dict[str, int] | None:
    """Write one micro-batch to a family once; None when it is there already.

    A batch has a folder of its own in every day it touches. What an attempt that failed
    left in them is taken away first, and the rows become visible to ``read_family`` with
    the batch's commit file, which is written last.
    """
    if AT in stream or "/" in stream or not stream:
        raise ValueError(f"no name for a stream: {stream!r}")
    spark = df.sparkSession
    log = _commits(spark, root, family, stream)
    if committed(spark, root, family, stream) >= batch_id:
        return None
    batch = f"{stream}{AT}{batch_id}"
    Folder(spark, f"{root}/{family}").delete_folders(f"dt=*/batch={batch}")
    counts = _write(prepare(df), root, family, batch, day_shift_hours)
    log.write(f"{batch_id:019d}.json", {"stream": stream, "batch": batch_id, **counts})
    for name in [n for n in log.names() if n.endswith(".json")][:-KEPT_COMMITS]:
        log.delete(name)
    return counts


def _visible(spark: SparkSession, root: str, family: str) -> Column:
    """Rows of committed batches. The test reads partition columns only, so that others are never opened."""
    streams = Folder(spark, f"{root}/{family}/_commits").names()
    out = F.col("batch") == APPENDED
    for s in streams:
        number = F.substring_index("batch", AT, -1).try_cast("bigint")
        out = out | ((F.substring_index("batch", AT, 1) == s) & (number <= committed(spark, root, family, s)))
    return out


def read_family(spark: SparkSession, root: str, families: list[str] | None = None) -> DataFrame:
    """Union of the index families that exist, committed batches only; a missing family is ignored."""
    found = []
    for name in families or INDEX_FAMILIES:
        try:
            found.append(spark.read.parquet(f"{root}/{name}").where(_visible(spark, root, name)).drop("batch"))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    if not found:
        return normalise(spark.createDataFrame([], event_schema())).withColumn("dt", F.lit(None).cast("string"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def query_events(df: DataFrame, start: str, end: str, filters: dict | None = None, size: int | None = None) -> DataFrame:
    """Events of a time range that satisfy equality filters; with ``size`` the oldest so many.

    With a ``dt`` partition column the range also prunes partitions; one day of
    slack on both sides covers families whose days are shifted.
    """
    lo, hi = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    if "dt" in df.columns:
        day = F.date_format
        df = df.where(F.col("dt").cast("string").between(
            day(lo - F.expr("interval 1 day"), "yyyy.MM.dd"), day(hi + F.expr("interval 1 day"), "yyyy.MM.dd")))
    df = df.where(F.col("ts").between(lo, hi))
    for path, value in (filters or {}).items():
        df = df.where(col(path) == F.lit(value))
    if size is None:
        return df
    return df.orderBy("ts", "seq").limit(size)

"""Aggregations of the operations dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions.columns import col, filled, is_json_object, text, truth

# Display weights of the threat ranking.
RANK_WEIGHTS = {"high": 1.0, "medium": 0.6, "low": 0.3}
RANK_OTHER = 0.2


def is_flagged() -> Column:
    """Event counts as a threat: confident, from a honeypot, or tagged as attack."""
    return (
        truth(col("threat.confidence") >= 0.5)
        | truth(col("event.dataset") == "cowrie")
        | truth(F.array_contains(col("tags"), "attack"))
    )


def in_range(df: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("ts") >= F.to_timestamp(F.lit(start)))
    if end is not None:
        df = df.where(F.col("ts") <= F.to_timestamp(F.lit(end)))
    return df


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_events"), F.count_if(is_flagged()).alias("threat_count"))


def severity_distribution(attacks: DataFrame) -> DataFrame:
    """Count and rounded percentage per severity bucket; anything unnamed is ``unknown``."""
    level = text(col("detection.severity"))
    bucket = F.when(level.isin("high", "medium", "low"), level).otherwise(F.lit("unknown"))
    counts = attacks.groupBy(bucket.alias("severity")).agg(F.count(F.lit(1)).alias("events"))
    total = F.sum("events").over(Window.partitionBy())  # over four rows at most
    return counts.withColumn("percent", F.floor(F.col("events") * 100.0 / total + 0.5).cast("bigint"))


def tactic_distribution(attacks: DataFrame, top: int | None = None) -> DataFrame:
    out = attacks.groupBy(F.coalesce(filled(col("threat.tactic.name")), F.lit("unknown")).alias("tactic")).agg(
        F.count(F.lit(1)).alias("events"))
    if top is not None:
        out = out.orderBy(F.col("events").desc(), "tactic").limit(top)
    return out


def trend(df: DataFrame, interval: str = "1 hour", threats_only: bool = False) -> DataFrame:
    """Events per interval over the span of the data, empty intervals included."""
    src = df.where(is_flagged()) if threats_only else df
    counts = src.groupBy(F.window("ts", interval).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    counts = counts.select(F.col("w.start").alias("bucket"), "events")
    # The spine is one row per interval between the first and last bucket.
    span = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {interval}"))).alias("bucket"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("events", F.lit(0)).alias("events"))


def attack_list(seed_events: DataFrame, limit: int = 20) -> DataFrame:
    return seed_events.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(limit)


def rank_score() -> Column:
    level = text(col("detection.severity"))
    weight = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in RANK_WEIGHTS.items()], F.lit(RANK_OTHER))
    return F.coalesce(col("threat.confidence"), F.lit(0.0)) * 100 + weight * 40


def threat_ranking(attacks: DataFrame) -> DataFrame:
    return attacks.withColumn("rank_score", rank_score()).orderBy(F.col("rank_score").desc(), "seq")


def high_risk_projection(attacks: DataFrame, total: Column | int) -> DataFrame:
    """Share of high-severity entries in a list projected onto a total."""
    total = F.lit(total) if isinstance(total, int) else total
    share = F.count_if(text(col("detection.severity")) == "high") / F.greatest(F.count(F.lit(1)), F.lit(1))
    return attacks.agg(F.floor(share * total + 0.5).cast("bigint").alias("high_risk"))


def _values(dtype: T.DataType, c: Column) -> Column:
    """All values below a column as one text, one per line."""
    if isinstance(dtype, T.StructType):
        return F.concat_ws("\n", *[_values(f.dataType, c[f.name]) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return F.concat_ws("\n", F.transform(c, lambda x: _values(dtype.elementType, x)))
    return c.cast("string")


def _record_values(raw: Column) -> Column:
    """Values of a JSON record without the names of its keys and without escapes; other text as it is."""
    string = r'"(?:[^"\\]|\\.)*"'
    values = F.regexp_replace(raw, rf"({string}\s*:)|({string})", "$2")
    return F.when(is_json_object(raw), F.regexp_replace(values, r'\\(["\\/])', "$1")).otherwise(raw)


def search(df: DataFrame, query: str, fields: list[str] | None = None) -> DataFrame:
    """Rows where any word of the query occurs in the value of any field (whole text, case-insensitive; names of fields don't count)."""
    values = [_record_values(F.col("raw")) if f == "raw" and df.schema[f].dataType == T.StringType() else _values(df.schema[f].dataType, F.col(f"`{f}`"))
              for f in fields or df.columns]
    body = F.lower(F.concat_ws("\n", *values))
    hit = F.lit(False)
    for word in query.lower().split():
        hit = hit | body.contains(word)
    return df.where(hit)


def page(df: DataFrame, number: int = 1, size: int = 20, order: list[Column] | None = None) -> DataFrame:
    """One page of a report, newest first."""
    order = order or [F.col("ts").desc(), F.col("seq").desc()]
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def counts_by_category(df: DataFrame) -> DataFrame:
    return df.groupBy(col("event.category").alias("category"), col("event.dataset").alias("dataset")).agg(
        F.count(F.lit(1)).alias("events"))


def _defects() -> Column:
    return F.array_compact(F.array(
        F.when(filled(col("event.dataset")).isNull(), F.lit("missing event.dataset")),
        F.when(filled(col("source.ip")).isNull(), F.lit("missing source.ip")),
        F.when(filled(col("event.category")).isNull(), F.lit("missing event.category")),
    ))


def quality_report(df: DataFrame) -> DataFrame:
    """Share of events that carry dataset, source address and category."""
    bad = F.size(_defects()) > 0
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"),
        F.round(F.count_if(~bad) * 100.0 / n, 1).alias("valid_percent"))


def quality_samples(df: DataFrame, samples: int = 5) -> DataFrame:
    """First defective events with what they lack."""
    return (df.withColumn("defects", F.array_join(_defects(), ", ")).where(F.col("defects") != "")
            .orderBy("seq").limit(samples))


def with_threat_info(df: DataFrame, present: bool = True) -> DataFrame:
    has = filled(col("threat.technique.id")).isNotNull()
    return df.where(has if present else ~has)


def threat_presence(df: DataFrame) -> DataFrame:
    """Events with and without threat information, in one pass."""
    return df.groupBy(filled(col("threat.technique.id")).isNotNull().alias("has_threat")).agg(F.count(F.lit(1)).alias("events"))


def display_row(df: DataFrame) -> DataFrame:
    """Projection shown in tables: '-' for anything missing, time in UTC+8."""
    dash = lambda c: F.coalesce(filled(c), F.lit("-"))
    return df.select(
        "seq", dash(col("event.id")).alias("id"), dash(col("threat.technique.name")).alias("technique"),
        dash(col("threat.tactic.name")).alias("tactic"), dash(col("host.name")).alias("host"),
        dash(col("source.ip")).alias("source_ip"), dash(col("destination.ip")).alias("destination_ip"),
        F.coalesce(F.date_format(F.from_utc_timestamp("ts", "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("time"),
    )

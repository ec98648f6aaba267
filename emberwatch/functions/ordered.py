"""Order-dependent helpers that split a hot key into chunks.

A window over ``keys`` alone puts a whole key into one task. These helpers run
the window over ``keys`` plus a chunk of the order column (a block of line
numbers or a slice of time), reduce every chunk to one summary row, carry the
summaries forward, and join the carry back. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_BLOCK = 500_000


def line_chunk(seq: Column, block: int = LINE_BLOCK) -> Column:
    return F.floor(seq / F.lit(block)).cast("long")


def time_chunk(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def _carry(df: DataFrame, keys: list[str], chunk: str, summary: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """Per-chunk summary, its running form over earlier chunks, joined back on keys and chunk."""
    per_chunk = df.groupBy(*keys, chunk).agg(*[c.alias(n) for n, c in summary.items()])
    over = Window.partitionBy(*keys).orderBy(chunk)
    return _join_back(df, keys, chunk, per_chunk, [c(over).alias(n) for n, c in carried.items()])


def _join_back(df: DataFrame, keys: list[str], chunk: str, per_chunk: DataFrame, values: list[Column]) -> DataFrame:
    """``values`` of each chunk's summary beside the chunk's rows."""
    cols = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    carry = per_chunk.select(*cols, F.col(chunk).alias("__kc"), *values)
    on = [df[k].eqNullSafe(carry[f"__k{i}"]) for i, k in enumerate(keys)] + [df[chunk] == carry["__kc"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(carry, cond, "left").drop("__kc", *[f"__k{i}" for i in range(len(keys))])


def with_previous(df: DataFrame, keys: list[str], chunk: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Value of the previous row of the same key for each entry of ``values``."""
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    packed = F.struct(*[c.alias(n) for n, c in values.items()])
    df = df.withColumns({"__v": packed, "__o": F.struct(*order)})
    df = df.withColumn("__lag", F.lag("__v").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    out = _carry(
        df, keys, chunk,
        {"__last": F.max_by("__v", "__o")},
        {"__prev_chunk": lambda over: F.lag("__last").over(over)},
    )
    prev = F.when(F.col("__first"), F.col("__prev_chunk")).otherwise(F.col("__lag"))
    out = out.withColumn("__prev", prev)
    for n in values:
        out = out.withColumn(n, F.col(f"__prev.{n}"))
    return out.drop("__v", "__o", "__lag", "__first", "__prev_chunk", "__prev")


def with_running_sum(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` within the key."""
    w = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__x", value).withColumn("__in", F.sum("__x").over(w))
    out = _carry(
        df, keys, chunk,
        {"__tot": F.sum("__x")},
        {"__before": lambda over: F.sum("__tot").over(over.rowsBetween(Window.unboundedPreceding, -1))},
    )
    out = out.withColumn(name, F.col("__in") + F.coalesce(F.col("__before"), F.lit(0)))
    return out.drop("__x", "__in", "__before")


def with_runs(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Number of the run of equal ``value`` (nulls equal one another) a row belongs to, counted from 1 within the key."""
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    df = df.withColumns({"__x": F.struct(value.alias("v")), "__o": F.struct(*order)}).withColumn("__lag", F.lag("__x").over(w))
    # the first row of a chunk counts once the chunk before is known
    df = df.withColumn("__new", (F.col("__lag").isNotNull() & ~F.col("__lag").eqNullSafe(F.col("__x"))).cast("long"))
    df = df.withColumn("__in", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per_chunk = df.groupBy(*keys, chunk).agg(
        F.min_by("__x", "__o").alias("__a"), F.max_by("__x", "__o").alias("__z"), F.sum("__new").alias("__n"))
    over = Window.partitionBy(*keys).orderBy(chunk)
    per_chunk = per_chunk.withColumn("__opens", (~F.lag("__z").over(over).eqNullSafe(F.col("__a"))).cast("long"))
    carried = F.sum(F.col("__n") + F.col("__opens")).over(over) - F.col("__n")
    out = _join_back(df, keys, chunk, per_chunk, [carried.alias("__before")])
    return out.withColumn(name, F.col("__in") + F.col("__before")).drop("__x", "__o", "__lag", "__new", "__in", "__before")


def with_runs_between(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, starts: Callable[[Column, Column], Column],
                      name: str, following: str) -> DataFrame:
    """Number of the run a row belongs to (from 1 within the key) and the ``value`` of the row behind it, null at the end of the key.

    ``starts(last, this)`` says from two neighbouring values whether a run starts. One window and one carry give both.
    """
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    df = df.withColumns({"__x": value, "__o": F.struct(*order)}).withColumns({"__lag": F.lag("__x").over(w), "__lead": F.lead("__x").over(w)})
    # the first row of a chunk counts once the chunk before is known
    df = df.withColumn("__new", F.when(F.col("__lag").isNotNull() & starts(F.col("__lag"), F.col("__x")), 1).otherwise(0))
    df = df.withColumn("__in", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per_chunk = df.groupBy(*keys, chunk).agg(
        F.min_by("__x", "__o").alias("__a"), F.max_by("__x", "__o").alias("__z"), F.sum("__new").alias("__n"))
    over = Window.partitionBy(*keys).orderBy(chunk)
    last = F.lag("__z").over(over)
    per_chunk = per_chunk.withColumns({"__opens": F.when(last.isNull() | starts(last, F.col("__a")), 1).otherwise(0), "__after": F.lead("__a").over(over)})
    carried = F.sum(F.col("__n") + F.col("__opens")).over(over) - F.col("__n")
    out = _join_back(df, keys, chunk, per_chunk, [carried.alias("__before"), F.col("__after")])
    out = out.withColumns({name: F.col("__in") + F.col("__before"), following: F.coalesce("__lead", "__after")})
    return out.drop("__x", "__o", "__lag", "__lead", "__new", "__in", "__before", "__after")


def with_last_known(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str,
                    include_current: bool = True) -> DataFrame:
    """Latest non-null ``value`` of the key up to the current row (as-of lookup)."""
    end = 0 if include_current else -1
    w = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    df = df.withColumns({"__x": value, "__o": F.struct(*order)})
    df = df.withColumn("__in", F.last("__x", ignorenulls=True).over(w))
    out = _carry(
        df, keys, chunk,
        {"__last": F.max_by("__x", F.when(F.col("__x").isNotNull(), F.col("__o")))},
        {"__before": lambda over: F.last("__last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))},
    )
    out = out.withColumn(name, F.coalesce(F.col("__in"), F.col("__before")))
    return out.drop("__x", "__o", "__in", "__before")

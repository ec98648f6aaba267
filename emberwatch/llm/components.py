"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.session import settled


def _with_smallest(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with ``m``, the smallest v of each u.

    The join key is another expression than the grouping key: both sides get an
    exchange of their own, and the links of a busy node can be split.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), "m")
    return links.withColumn("k", F.bitwise_not("u")).join(least, "k")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (u, v: bigint) that is not the smallest of its component.

    Each round links larger neighbours to the smallest one (large star), then
    smaller ones to theirs (small star); the number of rounds grows with the
    logarithm of the component size. Only counts reach the driver. Links of a node
    to itself and repeated links have no effect; no links give an empty table.
    """
    u, v = F.col("u"), F.col("v")
    now = settled(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u != v).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        large = _with_smallest(both).where(v > u).select(v.alias("u"), F.least("m", u).alias("v")).distinct()
        marked = _with_smallest(large)
        small = marked.select(u.alias("u"), F.col("m").alias("v")).unionByName(marked.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")))
        now, before = settled(small.distinct()), state
        state = _state(now)
        if state == before:
            break
    return now.select(u.alias("node"), v.alias("root"))

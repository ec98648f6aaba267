"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within radius r share a point within r / 2 of both. For r = 2
every distinct fingerprint emits itself and its 64 one-bit variants. All members
of a variant's ball are within r of each other, so the pairs that collide there
need no further test, and no pair is emitted: a ball is kept as a mask of 64 flip
bits and one bit for its centre, which sums with plain bit operations, and gives a
star of links from its first member to the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.columns import packed, unpacked
from emberwatch.llm.components import components
from emberwatch.session import cut_lineage

SEED = 42
_BLOCK = 1 << 16


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text.

    Words are runs of characters other than ASCII blanks, A-Z lower-cased; features
    are the XXH64 values of all word shingles, repeats included. Fewer words than
    ``width`` make one shingle, no words give zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    stops = ends[width - 1:] if len(words) >= width else ends[-1:]
    ones = np.zeros(64, np.int64)
    hash_of = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at:min(at + _BLOCK, n)].tolist(), stops[at:at + _BLOCK].tolist())
        h = np.array([hash_of(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprint(text: Column, width: int = 3) -> Column:
    """The SimHash as a signed bigint with the same bits."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, width) for t in texts], np.uint64).view(np.int64))

    return hashed(text)


def ball_links(prints: DataFrame) -> DataFrame:
    """Links ``u, v`` between the distinct fingerprints in column ``f`` that differ in two bits or less; their closure is complete."""
    one = F.lit(1).cast("long")
    flips = F.explode(F.array(*[F.lit(i) for i in range(-1, 64)])).alias("i")
    # i = -1 is the fingerprint itself
    # 65 rows from each: a number of partitions of its own keeps adaptive execution from joining the small ones before they
    # grow; by another expression than the grouping above, else the planner takes the repartition out as done already
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prints.repartition(parts, F.bitwise_not("f")).select("f", flips)
    bit = F.expr("shiftleft(1L, i)")
    variants = spread.select(
        F.when(F.col("i") < 0, F.col("f")).otherwise(F.col("f").bitwiseXOR(bit)).alias("v"),
        F.when(F.col("i") < 0, F.lit(0).cast("long")).otherwise(bit).alias("flip"), (F.col("i") < 0).cast("int").alias("own"))
    balls = variants.groupBy("v").agg(F.bit_or("flip").alias("mask"), F.max("own").alias("own"))
    balls = balls.where(F.bit_count("mask") + F.col("own") >= 2)
    lowest = F.col("mask").bitwiseAND(-F.col("mask"))
    balls = balls.select("v", "mask", F.when(F.col("own") == 1, F.col("v")).otherwise(F.col("v").bitwiseXOR(lowest)).alias("u"))
    member = balls.select("u", "v", "mask", F.explode(F.array(*[F.lit(i) for i in range(64)])).alias("i"))
    member = member.where(F.col("mask").bitwiseAND(F.expr("shiftleft(1L, i)")) != 0)
    links = member.select("u", F.col("v").bitwiseXOR(F.expr("shiftleft(1L, i)")).alias("v"))
    return links.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Adds ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links.

    Fingerprints are linked at two or fewer differing bits; empty and null texts
    have the fingerprint zero and are linked like any other. Null ids are never
    the smallest; a component of null ids only has a null id. Repeated rows stay
    repeated. An empty table gives an empty table.
    """
    rows = docs.select(packed(docs, text), F.col(f"`{doc_id}`").alias("id"), fingerprint(F.col(f"`{text}`").cast("string"), width).alias("f"))
    rows = cut_lineage(rows)
    prints = rows.groupBy("f").agg(F.min("id").alias("least"))
    roots = components(ball_links(prints.select("f")))
    labelled = prints.join(roots, prints["f"] == roots["node"], "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    labelled = cut_lineage(labelled)
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id")).select(F.bitwise_not("root").alias("k"), "component_id")
    known = labelled.select("f", F.bitwise_not("root").alias("k")).join(ids, "k").select(F.bitwise_not("f").alias("k"), "component_id")
    # both sides are exchanged for this join, so a fingerprint of very many copies can be split
    out = rows.withColumn("k", F.bitwise_not("f")).join(known, "k")
    out = out.select("row", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
    return unpacked(out, ["fingerprint", "component_id"])

"""Sharding by balanced label propagation.

Documents of equal text are linked and should share a shard, while shard counts
stay at most one apart (law ``rows``). Links are never listed: a group is a table
of its members per shard. In each round a group asks for the shard where most of
its members are, of those with room for all of it, or else for another with room;
requests are admitted, large ones first, up to the capacity that is left. Only
admitted groups hold places. Rounds end when no group that is left fits a shard;
such groups and documents without links fill every shard to its quota.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberwatch.llm.columns import digest, packed, unpacked
from emberwatch.session import cut_lineage

OVERHEAD = 16
#: Priorities of requests and ranges of ranks; tables of BUCKETS x shards rows reach the driver.
BUCKETS = 1024


def _bucket(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(11)), F.lit(BUCKETS)).cast("int")


def _priority() -> Column:
    """Requests by halves of size, the largest first, and in 32 parts by hash; 32 halves at most."""
    size = F.least(F.floor(F.log2("members")), F.lit(31))
    return ((31 - size) * 32 + F.pmod(F.xxhash64("unit", F.lit(11)), F.lit(32))).cast("int")


def _ranked(df: DataFrame, by: list[str], shards: int) -> DataFrame:
    """Adds ``rank``, gapless from 0 within ``by``: a rank within one of BUCKETS ranges (``bucket``) plus the sizes of the ranges before it."""
    sizes = df.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))  # at most BUCKETS x shards rows
    within = Window.partitionBy(*by, "bucket").orderBy("seq")
    ranked = df.withColumn("place", F.row_number().over(within) - 1)
    return ranked.join(F.broadcast(starts), [*by, "bucket"]).withColumn("rank", F.col("place") + F.col("start")).drop("place", "start", "bucket")


def _choose(counts: DataFrame, spare: np.ndarray, turn: int) -> DataFrame:
    """The wish of each unit: the shard of most of its members among those with room for all of it, else any with room; units that fit nowhere have none."""
    room = F.array(*[F.lit(int(x)) for x in spare])
    free = F.get(room, F.col("shard")) >= F.col("members")
    best = F.max_by("shard", F.when(free, F.struct(F.col("n"), F.xxhash64("unit", "shard", F.lit(turn)))))
    wish = counts.groupBy("unit", "members").agg(F.max(free.cast("int")).alias("own"), best.alias("best"))
    others = F.filter(F.array(*[F.lit(s) for s in range(len(spare))]), lambda s: F.get(room, s) >= F.col("members"))
    wish = wish.withColumn("others", others).where(F.size("others") > 0)
    other = F.get("others", F.pmod(F.xxhash64("unit", F.lit(turn)), F.size("others")).cast("int"))
    return wish.select("unit", "members", F.when(F.col("own") == 1, F.col("best")).otherwise(other).alias("shard"), _priority().alias("bucket"))


def _admitted(wish: DataFrame, spare: np.ndarray) -> DataFrame:
    """Wishes in the order of their buckets as long as a shard has room; the bucket in which the room ends is admitted unit by unit."""
    asked = np.zeros((len(spare), BUCKETS), np.int64)
    for r in wish.groupBy("shard", "bucket").agg(F.sum("members").alias("m")).collect():  # shards x BUCKETS rows at most
        asked[r["shard"], r["bucket"]] = r["m"]
    sums = np.cumsum(asked, axis=1)
    cuts = [int(np.searchsorted(sums[s], spare[s], side="right")) for s in range(len(spare))]
    rest = [int(spare[s] - (sums[s, c - 1] if c else 0)) for s, c in enumerate(cuts)]
    of_shard = lambda x: F.get(F.array(*[F.lit(int(v)) for v in x]), F.col("shard"))
    whole = wish.where(F.col("bucket") < of_shard(cuts))
    order = Window.partitionBy("shard").orderBy(F.xxhash64("unit", F.lit(13)), "unit").rowsBetween(Window.unboundedPreceding, 0)
    part = wish.where(F.col("bucket") == of_shard(cuts)).withColumn("sum", F.sum("members").over(order)).where(F.col("sum") <= of_shard(rest))
    return whole.unionByName(part.drop("sum"))


def shard_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 40) -> DataFrame:
    """Adds ``size`` (UTF-8 bytes plus OVERHEAD), ``text_crc32``, ``law``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Null texts have no bytes, the checksum of an empty text, and are equal to each
    other but not to empty ones. Groups larger than a quarter of a shard are cut
    into units of about that size. Ids may be null or repeated: every row gets a
    place of its own. An empty table gives an empty table.
    """
    t = F.col(f"`{text}`").cast("string")
    h1, h2 = digest(t.isNull(), t)
    src = docs.select(packed(docs, text), F.col(f"`{doc_id}`").alias("id"), (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
                      F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"), h1.alias("h1"), h2.alias("h2"))
    # numbers are given to the stored rows, whose partitions no longer change
    src = cut_lineage(src).withColumn("seq", F.monotonically_increasing_id())
    total = src.count()
    quota = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    first = F.pmod(F.xxhash64("seq", F.lit(5)), F.lit(shards)).cast("int")

    groups = src.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    whole, chunk = max(2, int(quota.max())), max(2, int(quota.min()) * 7 // 8)  # pieces by hash differ in size
    groups = groups.select(F.bitwise_not("h1").alias("g1"), F.bitwise_not("h2").alias("g2"), F.when(F.col("copies") <= whole, F.lit(1)).otherwise(F.ceil(F.col("copies") / chunk)).alias("chunks"))
    # a text of very many copies is split here; both sides have an exchange of their own
    rows = src.withColumns({"g1": F.bitwise_not("h1"), "g2": F.bitwise_not("h2")}).join(groups, ["g1", "g2"], "left")
    unit = F.when(F.col("chunks").isNotNull(), F.xxhash64("g1", "g2", F.pmod(F.xxhash64("seq", F.lit(7)), F.coalesce("chunks", F.lit(1)))))
    rows = cut_lineage(rows.select("row", "size", "text_crc32", "seq", unit.alias("unit"), first.alias("shard")))

    linked = rows.where(F.col("unit").isNotNull())
    counts = linked.groupBy("unit", "shard").agg(F.count(F.lit(1)).alias("n"))
    members = counts.groupBy("unit").agg(F.sum("n").alias("members"))
    counts = cut_lineage(counts.join(members, "unit"))
    spare, settled, turn = quota.copy(), None, 0
    while True:
        wish = cut_lineage(_choose(counts, spare, turn))
        moves = cut_lineage(_admitted(wish, spare).select("unit", "members", "shard"))
        gained = {r["shard"]: r["m"] for r in moves.groupBy("shard").agg(F.sum("members").alias("m")).collect()}
        if not gained:  # a unit with a wish fits, so none has one
            break
        for s in range(shards):
            spare[s] -= gained.get(s, 0)
        settled = moves if settled is None else settled.unionByName(moves)
        counts = cut_lineage(counts.join(moves.select("unit"), "unit", "left_anti"))
        turn += 1
    rows = rows.withColumn("to", F.lit(None).cast("int"))
    if settled is not None:
        to = settled.select(F.bitwise_not("unit").alias("k"), F.col("shard").alias("to"))
        rows = rows.drop("to").withColumn("k", F.bitwise_not("unit")).join(to, "k", "left")
    rows = cut_lineage(rows.select("row", "size", "text_crc32", "seq", "unit", F.col("to").alias("shard")))

    # settled rows keep their shard; all others fill what is left, rows of one unit near each other
    linked = cut_lineage(_ranked(rows.where(F.col("shard").isNotNull()).withColumn("bucket", _bucket("seq")), ["shard"], shards))
    taken = quota - spare
    names = ["row", "size", "text_crc32", "seq"]
    near = F.pmod(F.xxhash64("unit", F.lit(17)), F.lit(BUCKETS // 8)) * 8 + F.pmod(F.xxhash64("seq", F.lit(11)), F.lit(8))
    place = F.when(F.col("unit").isNull(), _bucket("seq")).otherwise(near).cast("int")
    free = rows.where(F.col("shard").isNull()).select(*names, F.lit(0).alias("all"), place.alias("bucket"))
    free = _ranked(free, ["all"], 1)
    ends = np.cumsum(quota - taken)
    shard = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        shard = F.when(F.col("rank") < int(ends[s]), F.lit(s)).otherwise(shard)
    offset = F.array(*[F.lit(int(x)) for x in taken - (ends - (quota - taken))])
    free = free.withColumn("shard", shard.cast("int")).select("row", "size", "text_crc32", "shard", (F.col("rank") + F.get(offset, F.col("shard"))).alias("slot"))
    out = linked.select("row", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("rank").alias("slot")).unionByName(free)
    out = out.select("row", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"))
    return unpacked(out, ["size", "text_crc32", "law", "shard", "slot"])

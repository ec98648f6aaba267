"""Line dedup: lines found in many documents lose all their occurrences.

Lines are exploded and hashed, the documents of each hash are counted, and hashes
over the threshold are joined back to the line positions. Every shuffle carries
hashes, except the last one, which brings the positions to the text. Counting
combines before the shuffle, so a line of every third document is no hot key; the
join on hashes has an exchange of its own on both sides, which adaptive execution
can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.columns import BLANKS, ascii_lower, digest, packed, unpacked


def _keys(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop all lines whose key occurs in at least ``min_docs`` rows.

    A key is the line without blanks at its ends and with A-Z lower-cased; keys of
    fewer than ``min_chars`` code points stay. Adds ``n_lines`` and ``n_dropped``;
    ``text`` holds the lines that are left. Null and empty texts are one empty
    line and come back as an empty text. Every row counts as a document, also when
    it repeats another one. An empty table gives an empty table.
    """
    src = docs.select(packed(docs, text), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    src = src.select("row", "t", *[h.alias(n) for h, n in zip(digest(F.to_json(F.col("row")), F.col("t")), ("r1", "r2"))])
    lowered = F.split(ascii_lower(F.col("t")), "\n", -1)

    h1, h2 = digest(F.col("key"))
    key = (F.length("key") >= min_chars)
    found = src.select(F.explode(F.array_distinct(_keys(lowered))).alias("key")).where(key).select(h1.alias("h1"), h2.alias("h2"))
    frequent = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    # the join key is another expression than the grouping key, so that both sides of the join have an exchange and a hot hash can be split
    frequent = frequent.select(*[F.bitwise_not(c).alias(n) for c, n in (("h1", "j1"), ("h2", "j2"))])

    at = src.select("r1", "r2", F.posexplode(_keys(lowered)).alias("pos", "key")).where(key)
    at = at.select("r1", "r2", "pos", F.bitwise_not(h1).alias("j1"), F.bitwise_not(h2).alias("j2"))
    hits = at.join(frequent, ["j1", "j2"], "left_semi")
    dropped = hits.groupBy("r1", "r2").agg(F.collect_set("pos").alias("dropped"))

    # the lines are split below the join, so that the lambda after it reads an array and does not split again for each line
    whole = src.select("row", "r1", "r2", F.split("t", "\n", -1).alias("lines"))
    joined = whole.join(dropped, ["r1", "r2"], "left")
    last = F.size("lines") - 1
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), last), F.col("dropped")), lambda i: F.get(F.col("lines"), i)))
    out = joined.select(
        "row", F.array_join(kept, "\n").alias(text), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    return unpacked(out, [text, "n_lines", "n_dropped"])

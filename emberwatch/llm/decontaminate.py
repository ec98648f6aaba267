"""Benchmark decontamination as a prefix-filtered set join.

An item window is a set of shingles that a document must hold completely, so one
token of it, the rarest of the collection, is a sufficient prefix. The first pass
counts every shingle of the benchmark over all documents; the second one looks for
prefix tokens only, applies the length and positional bounds, and verifies the
whole window word by word. The benchmark is cut into blocks of bounded size, which
are broadcast one after the other; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.columns import unpacked, packed

WINDOW = 10
#: Bytes of benchmark text per block; a block's tables are about twenty times as large.
BLOCK_BYTES = 4 << 20
#: Shingles have so many words, or all words of a shorter window.
SHINGLE = 3

_letters = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _letters else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, A-Z as a-z, a-z and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Block:
    """Windows of one block: ``ids[first[w]:first[w] + size[w]]`` are the word ids of window w, from 1."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray
    first: np.ndarray
    size: np.ndarray
    items: list[tuple]
    codes: np.ndarray
    window_codes: list[np.ndarray]
    prefix: dict[int, list[tuple[int, int]]] | None = None

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], window: int) -> Block:
        seen: dict[tuple, set] = {}
        for item, text in rows:
            w = words_of(text)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                seen.setdefault(tuple(w[k:k + window]), set()).add(item)
        vocabulary: dict[bytes, int] = {}
        windows = [[vocabulary.setdefault(x, len(vocabulary) + 1) for x in w] for w in seen]
        size = np.array([len(w) for w in windows], np.int64)
        ids = np.array([x for w in windows for x in w], np.int64)
        first = np.cumsum(size) - size
        block = cls(vocabulary, ids, first, size, [tuple(x for x in s if x is not None) for s in seen.values()], np.array([], np.int64), [])
        block.window_codes = [block.code(np.array(w, np.int64), min(len(w), SHINGLE)) for w in windows]
        block.codes = np.unique(np.concatenate(block.window_codes)) if windows else block.codes
        return block

    def code(self, ids: np.ndarray, words: int) -> np.ndarray:
        """One number per position for the next ``words`` words; 0 where one is not a word of the benchmark. Lengths never share numbers."""
        n, base = len(ids) - words + 1, len(self.vocabulary) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(words):
            out = out * base + ids[j:j + n]
            known &= ids[j:j + n] > 0
        return np.where(known, out, 0)

    def lengths(self) -> list[int]:
        return sorted(set(np.minimum(self.size, SHINGLE).tolist()))

    def found(self, text: str | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Word ids of a text, and for each shingle length the positions and indices of benchmark shingles."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        out = []
        for words in self.lengths():
            code = self.code(ids, words)
            at = np.flatnonzero(code)
            index = np.searchsorted(self.codes, code[at])
            ok = index < len(self.codes)
            ok[ok] = self.codes[index[ok]] == code[at][ok]
            out.append((at[ok], index[ok]))
        return ids, out

    def choose(self, counts: dict[int, int]) -> None:
        """The rarest shingle of every window becomes its prefix."""
        self.prefix = {}
        for w, codes in enumerate(self.window_codes):
            index = np.searchsorted(self.codes, codes).tolist()
            offset = min(range(len(index)), key=lambda k: (counts.get(index[k], 0), index[k], k))
            self.prefix.setdefault(index[offset], []).append((w, offset))
        self.is_prefix = np.zeros(len(self.codes), bool)
        self.is_prefix[list(self.prefix)] = True

    def hits(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """Number of words, positions of words within windows that occur, and the items of those windows."""
        ids, found = self.found(text)
        covered, items = np.zeros(len(ids) + 1, np.int64), set()
        for at, index in found:
            chosen = self.is_prefix[index]
            starts: dict[int, list[int]] = {}
            for p, t in zip(at[chosen].tolist(), index[chosen].tolist()):
                for w, offset in self.prefix[t]:
                    if p >= offset and p - offset + self.size[w] <= len(ids):  # positional and length bound
                        starts.setdefault(w, []).append(p - offset)
            for w, s in starts.items():
                n, first = int(self.size[w]), int(self.first[w])
                s = np.array(s, np.int64)
                s = s[(ids[s[:, None] + np.arange(n)] == self.ids[first:first + n]).all(axis=1)]
                if len(s):
                    items.update(self.items[w])
                    np.add.at(covered, s, 1)
                    np.add.at(covered, s + n, -1)
        return len(ids), np.flatnonzero(np.cumsum(covered)[:-1] > 0), items


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of about ``block_bytes``; one block at a time reaches the driver."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).where(F.octet_length("t") > 0).collect()]


def _counting(shared: Broadcast):
    """Occurrences of the block's shingles in a stream of texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        n = np.zeros(len(block.codes), np.int64)
        for pdf in batches:
            for t in pdf["t"]:
                for _, index in block.found(t)[1]:
                    np.add.at(n, index, 1)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"shingle": at, "n": n[at]})

    return count


def _searching(shared: Broadcast):
    @F.pandas_udf("struct<n_words long, hit array<int>, found array<string>>")
    def search(texts: pd.Series) -> pd.DataFrame:
        got = [shared.value.hits(t) for t in texts]
        return pd.DataFrame({"n_words": [g[0] for g in got], "hit": [g[1].astype(np.int32) for g in got], "found": [sorted(g[2]) for g in got]})

    return search


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``n_words``, ``n_hit`` (words inside an occurrence of a window) and ``items`` (sorted ids as strings).

    A window is ``window`` consecutive words of an item, or the whole of a shorter
    one. Null and empty texts have no words; items without words match nothing; a
    null item id is not listed, but its windows count as hits. Equal items are all
    listed. An empty benchmark leaves all documents without hits.
    """
    spark = docs.sparkSession
    src = docs.select(packed(docs, text), F.col(f"`{text}`").alias("original"), F.col(f"`{text}`").cast("string").alias("t"),
                      F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("found"), F.lit(0).cast("long").alias("n_words"))
    plain = src.select("t")
    empty = True
    for rows in _blocks(benchmark, item_id, item_text, block_bytes):
        block = Block.of(rows, window)
        if not len(block.size):
            continue
        empty = False
        shared = spark.sparkContext.broadcast(block)

        tally = plain.mapInPandas(_counting(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        block.choose({r[0]: r[1] for r in tally.collect()})  # as many rows as the block has shingles
        chosen = spark.sparkContext.broadcast(block)

        src = src.withColumn("s", _searching(chosen)("t")).select(
            "row", "original", "t", F.array_union("hit", "s.hit").alias("hit"), F.array_union("found", "s.found").alias("found"), F.col("s.n_words").alias("n_words"))
    if empty:
        @F.pandas_udf("long")
        def count_words(texts: pd.Series) -> pd.Series:
            return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

        src = src.withColumn("n_words", count_words("t"))
    out = src.select("row", F.col("original").alias(text), "n_words", F.size("hit").cast("long").alias("n_hit"), F.sort_array("found").alias("items"))
    return unpacked(out, [text, "n_words", "n_hit", "items"])

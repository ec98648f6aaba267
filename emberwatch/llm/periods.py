"""Periodic runs of words, found by descending common prefixes.

Suffixes of a text that begin alike form classes: at threshold l all suffixes whose
common prefix has at least l words. Lowering l from the longest common prefix on unites
classes, as Kruskal's algorithm unites trees, along the edges between neighbours in
suffix order. Every class keeps its positions in order. Where a union makes two
positions i < j neighbours, their common prefix is exactly l; if their distance d = j - i
is at most l, the words from i to j + l repeat with period d, and no shorter period is
possible, since a position between them would have been in the class before.

Suffix order comes from prefix doubling over many texts at once; only positions that are
still tied are sorted again. A text is one row, and all work on it stays in its row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.columns import packed, unpacked

#: Words whose suffixes are sorted together.
_BLOCK = 1 << 17
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def suffix_levels(ids: np.ndarray, text: np.ndarray, shared: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """Prefix doubling within texts.

    ``ids`` are word numbers, ``text`` the number of the text of each. Returns ranks per
    level and, in suffix order, at least the positions whose next ``shared`` words occur
    again in their text. Two positions have the same rank at level k if they share a text
    and 2**k words.
    """
    n = len(ids)
    key = text * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    rank[n] = -1
    levels, tied, width = [rank], np.sort(order[_tied(new)]), 1
    pairs = tied
    while len(tied):
        behind = tied + width
        inside = (behind < n) & (text[np.minimum(behind, n - 1)] == text[tied])
        second = np.where(inside, rank[np.minimum(behind, n)], -1) + 1
        key = rank[tied] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        at, key = tied[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.ones(len(at), bool)
        group[1:] = rank[at[1:]] != rank[at[:-1]]
        start, head = np.flatnonzero(new), np.flatnonzero(group)
        # a subgroup's rank: that of its group and the group's members in front of it
        offset = np.repeat(start, np.diff(np.append(start, len(at)))) - np.repeat(head, np.diff(np.append(head, len(at))))
        rank = rank.copy()
        rank[at] += offset
        levels.append(rank)
        tied = np.sort(at[_tied(new)])
        width *= 2
        if width <= shared:
            pairs = tied
    return levels, pairs[np.argsort(rank[pairs], kind="stable")]


def _tied(new: np.ndarray) -> np.ndarray:
    """Members of groups of more than one, where ``new`` marks the first member of each."""
    return ~(new & np.append(new[1:], True)) if len(new) else new


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` share."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        out += np.where(rank[a + out] == rank[b + out], 1 << k, 0)
    return out


class Classes:
    """Union-find over ordered position sets. ``unite`` returns the neighbours that a union made."""

    def __init__(self):
        self.set_of: dict[int, int] = {}
        self.sets: dict[int, list[int]] = {}

    def _find(self, i: int) -> int:
        s = self.set_of.get(i)
        if s is None:
            s = self.set_of[i] = i
            self.sets[i] = [i]
        return s

    def unite(self, i: int, j: int) -> list[tuple[int, int]]:
        s, t = self._find(i), self._find(j)
        if s == t:
            return []
        if len(self.sets[s]) < len(self.sets[t]):
            s, t = t, s
        large, small, set_of, made = self.sets[s], self.sets.pop(t), self.set_of, []
        if 8 * len(small) > len(large):
            self.sets[s] = merged = sorted(large + small)
            of = [set_of[x] for x in merged]
            made = [(a, b) for a, b, p, q in zip(merged, merged[1:], of, of[1:]) if p != q]
        else:
            for x, follower in zip(small, [*small[1:], None]):
                k = bisect_left(large, x)
                if k and set_of[large[k - 1]] == s:
                    made.append((large[k - 1], x))
                if k < len(large) and (follower is None or follower > large[k]):
                    made.append((x, large[k]))
                large.insert(k, x)
        for x in small:
            set_of[x] = s
        return made

    def neighbours(self, i: int, j: int) -> bool:
        members = self.sets[self.set_of[i]]
        k = bisect_left(members, i) + 1
        return k < len(members) and members[k] == j


def runs_of(texts: list[list[bytes]], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """Per text the maximal runs (start, length, period) of at least ``least`` words and ``times`` periods (two or more), by start and period."""
    size = np.array([len(w) for w in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    n = int(size.sum())
    if not n:
        return out
    number = dict(zip(dict.fromkeys(chain.from_iterable(texts)), count()))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, n)
    text = np.repeat(np.arange(len(texts)), size)
    first = np.cumsum(size) - size
    # a run of d-word periods needs a common prefix of (times - 1) * d and of least - d words
    needed = min(max((times - 1) * d, least - d) for d in range(1, least + 1))
    levels, order = suffix_levels(ids, text, needed)
    if len(order) < 2:
        return out
    prefix = common_prefixes(levels, order[:-1], order[1:])
    del levels
    edges = np.flatnonzero(prefix >= needed)
    edges = edges[np.argsort(-prefix[edges], kind="stable")]
    classes, seeds, level = Classes(), [], None
    steps = zip(order[edges].tolist(), order[edges + 1].tolist(), prefix[edges].tolist())
    for i, j, shared in chain(steps, [(0, 0, -1)]):
        if shared != level:
            # neighbours count when all edges of a level are in
            for a, b in seeds:
                if classes.neighbours(a, b):
                    t = int(text[a])
                    start = int(first[t])
                    if a == start or ids[a - 1] != ids[b - 1]:
                        out[t].append((a - start, b - a + level, b - a))
            seeds, level = [], shared
            if shared < 0:
                break
        seeds += [(a, b) for a, b in classes.unite(i, j) if (times - 1) * (b - a) <= shared and b - a + shared >= least]
    return [sorted(set(r)) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    return b" ".join([words[k] for k in keep.tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """Adds ``runs`` (start, length, period in words, by start and period) and ``collapsed``.

    A run is a stretch of words with smallest period ``period`` and at least
    ``max(least, times * period)`` words that no neighbouring word extends with that
    period. ``collapsed`` has the words outside of all runs and the first period of each
    run, joined by one space; a word that another run holds after its first period goes.

    Null, empty and blank texts have no words: no runs, an empty ``collapsed``. Rows
    are independent, so repeated rows stay repeated and an empty table gives an empty
    one. A very long text is sorted alone, in memory in proportion to its words. Result
    columns win over input columns of the same name.
    """

    def found(texts: list[str | None]) -> Iterator[tuple[int, list, list[bytes]]]:
        held: list[list[bytes]] = []
        size = 0
        for k, t in enumerate(texts, 1):
            held.append(words_of(t))
            size += len(held[-1])
            if size >= _BLOCK or k == len(texts):
                runs = runs_of(held, least, times)
                yield k, runs, [collapsed(w, r) for w, r in zip(held, runs)]
                held, size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            texts, done = batch.column("t"), 0
            for end, runs, left in found(texts.to_pylist()):
                rows = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], kind)
                part = slice(done, end)
                yield pa.RecordBatch.from_arrays([batch.column("row")[part], texts[part], rows, pa.array(left, pa.binary()).cast(pa.string())], ["row", "t", "runs", "collapsed"])
                done = end

    src = docs.select(packed(docs, text), F.col(f"`{text}`").cast("string").alias("t"))
    out = src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, t string, runs {RUNS}, collapsed string")
    return unpacked(out.withColumnRenamed("t", text), [text, "runs", "collapsed"])

"""Exact ranked lexical search over sparse ball trees.

A document is a sparse vector over the terms of the queries, its score the inner product
with a query's term weights. Every task builds ball trees over the documents it holds: a
node keeps the centroid of its documents and how far they lie from it. Since a query
meets only the coordinates of its own terms, the coordinates are dealt into groups and a
node has one radius per group; by Cauchy and Schwarz no document below it scores above

    sum of w * centroid  +  sum over groups of |w of the group's terms below the node| * radius.

Bounds are raised by more than their rounding errors. Nodes are opened best first, only
for the queries whose bound reaches their k-th best score so far, and leaves are scored in
integers. A first search of a fixed share of the documents gives every query a score that
k documents reach, which the whole search starts from; it prunes, and it keeps the rows
that leave a task to those that can still be among the best.

Queries are taken in blocks of bounded size against all documents. Documents are read once
per block, are never shuffled, and reach no other task.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.session import cut_lineage

#: Queries and bytes of query text per block: bounds the weights every task holds (terms x queries).
BLOCK_ITEMS, BLOCK_BYTES = 512, 1 << 18
#: Documents of one tree and of one leaf, groups of coordinates.
TREE, LEAF, GROUPS = 4096, 32, 256
#: The first search reads every SHARE-th document by hash.
SHARE = 64
SCALE = 1_000_000_000

_term = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _term else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, A-Z as a-z, a-z and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Queries:
    """Weights of a block of queries over their terms; ``floor`` is the least score a document needs per query."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray, k: int, floor: np.ndarray):
        self.k, self.floor, self.n_terms = k, floor, len(weights)
        self.w = np.zeros((len(weights), len(terms)), np.int64)  # terms x queries
        for q, t in enumerate(terms):
            self.w[t, q] = weights[t]
        # terms of one query are dealt to different groups
        seen = list(dict.fromkeys(t for q in terms for t in q))
        self.group = np.zeros(len(weights), np.int64)
        self.group[seen] = np.arange(len(seen)) % GROUPS
        flat = [(q, int(self.group[t]), t) for q, ts in enumerate(terms) for t in ts]
        flat.sort()
        self.q, self.g, self.t = (np.array(x, np.int64) for x in zip(*flat)) if flat else (np.zeros(0, np.int64),) * 3
        self.by_group = np.flatnonzero(np.diff(self.q * GROUPS + self.g, prepend=-1))
        self.by_query = np.flatnonzero(np.diff(self.q[self.by_group], prepend=-1))
        self.of_query = self.q[self.by_group][self.by_query]
        self.flat_w = weights[self.t].astype(float) if flat else np.zeros(0)

    def bounds(self, centre: np.ndarray, radius: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Node by query: no document of the node scores more."""
        out = np.zeros((len(centre), self.w.shape[1]))
        if not len(self.t):
            return out
        inner = np.add.reduceat(centre[:, self.t] * self.flat_w, self.by_group, axis=1)
        norm = np.sqrt(np.add.reduceat(below[:, self.t] * self.flat_w ** 2, self.by_group, axis=1))
        reach = inner + norm * radius[:, self.g[self.by_group]]
        out[:, self.of_query] = np.add.reduceat(reach, self.by_query, axis=1)
        # all terms are sums of positive numbers: the relative error is some thousand units in the last place at most
        return out * (1 + 1e-9) + 1


class Vectors:
    """Sparse rows: entries ``first[d]:first[d + 1]`` of ``term`` and ``x`` belong to document d, none is empty."""

    def __init__(self, first: np.ndarray, term: np.ndarray, x: np.ndarray):
        self.first, self.term, self.x = first, term, x

    def take(self, docs: np.ndarray) -> Vectors:
        size = self.first[docs + 1] - self.first[docs]
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.first[docs] - first[:-1], size) + np.arange(first[-1])
        return Vectors(first, self.term[at], self.x[at])

    def __len__(self) -> int:
        return len(self.first) - 1

    def dot(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.x * v[self.term], self.first[:-1])

    def mean(self, n_terms: int) -> np.ndarray:
        return np.bincount(self.term, self.x, n_terms) / len(self)

    def dense(self, d: int, n_terms: int) -> np.ndarray:
        out = np.zeros(n_terms)
        out[self.term[self.first[d]:self.first[d + 1]]] = self.x[self.first[d]:self.first[d + 1]]
        return out


class Tree:
    """Ball tree over ``vectors``; ``rows[a:b]`` are the documents of a node with ``span`` (a, b)."""

    def __init__(self, vectors: Vectors, group: np.ndarray, n_terms: int):
        self.rows, self.span, self.children = np.arange(len(vectors)), [], []
        self.vectors, self.group, self.n_terms = vectors, group, n_terms
        centre, radius, below = [], [], []
        todo = [(0, len(vectors), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.span)
            if parent >= 0:
                self.children[parent].append(node)
            self.span.append((a, b))
            self.children.append([])
            part = vectors.take(self.rows[a:b])
            c = part.mean(n_terms)
            centre.append(c)
            radius.append(self._radius(part, c))
            below.append(np.bincount(part.term, minlength=n_terms) > 0)
            if b - a > LEAF:
                self.rows[a:b] = self.rows[a:b][self._order(part, c)]
                middle = (a + b + 1) // 2
                todo += [(a, middle, node), (middle, b, node)]
        self.centre, self.radius, self.below = np.array(centre), np.array(radius), np.array(below)

    def _radius(self, part: Vectors, c: np.ndarray) -> np.ndarray:
        """Per group of coordinates the largest distance of a document from the centroid, rounded up."""
        doc = np.repeat(np.arange(len(part)), np.diff(part.first))
        own, there = part.x - c[part.term], c[part.term]
        rest = np.bincount(self.group, c * c, GROUPS)  # distance of a document without any term
        # the sum of what each present term changes; magnitudes on both sides bound the rounding error
        change = np.bincount(doc * GROUPS + self.group[part.term], own * own - there * there, len(part) * GROUPS).reshape(len(part), GROUPS)
        largest = np.zeros(self.n_terms)
        np.maximum.at(largest, part.term, part.x)
        error = 1e-9 * (rest + np.bincount(self.group, largest * largest, GROUPS))
        return np.sqrt(np.maximum(rest + change.max(axis=0), 0) + error) * (1 + 1e-9)

    @staticmethod
    def _order(part: Vectors, c: np.ndarray) -> np.ndarray:
        """Documents from one far pole to the other."""
        size = len(c)
        norm = np.add.reduceat(part.x * part.x, part.first[:-1])
        one = part.dense(int(np.argmax(norm - 2 * part.dot(c))), size)
        other = part.dense(int(np.argmax(norm - 2 * part.dot(one))), size)
        return np.argsort(part.dot(other - one), kind="stable")


class Best:
    """The k best documents of every query so far, ties by id, null ids last."""

    def __init__(self, queries: Queries):
        self.queries = queries
        self.lists: list[list[tuple]] = [[] for _ in queries.floor]
        self.reach = np.maximum(queries.floor, 1).astype(np.int64)

    def search(self, vectors: Vectors, ids: list) -> None:
        """Take in the documents of one tree."""
        q = self.queries
        tree = Tree(vectors, q.group, q.n_terms)
        bound = q.bounds(tree.centre, tree.radius, tree.below.astype(float))
        heap = [(-float((bound[0] / self.reach).max(initial=0)), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            open_for = np.flatnonzero(bound[node] >= self.reach)
            if not len(open_for):
                continue
            children = tree.children[node]
            if children:
                for child in children:
                    np.minimum(bound[child], bound[node], out=bound[child])
                    heapq.heappush(heap, (-float((bound[child][open_for] / self.reach[open_for]).max()), child))
                continue
            a, b = tree.span[node]
            docs = tree.rows[a:b]
            part = vectors.take(docs)
            scores = np.add.reduceat(q.w[part.term[:, None], open_for[None, :]] * part.x.astype(np.int64)[:, None], part.first[:-1], axis=0)
            hit_doc, hit_query = np.nonzero(scores >= self.reach[open_for])
            for d, k in zip(hit_doc.tolist(), hit_query.tolist()):
                self._add(int(open_for[k]), int(scores[d, k]), ids[docs[d]])

    def _add(self, query: int, score: int, doc) -> None:
        if score < self.reach[query]:
            return
        best, k = self.lists[query], self.queries.k
        insort(best, (-score, doc is None, 0 if doc is None else doc))
        del best[k:]
        if len(best) == k:
            self.reach[query] = max(self.reach[query], -best[-1][0])

    def rows(self) -> list[tuple]:
        return [(q, -s, None if none else d) for q, best in enumerate(self.lists) for s, none, d in best]


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The queries in blocks of bounded size; one block at a time reaches the driver."""
    src = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where(F.octet_length("t") > 0)
    total = src.agg(F.count(F.lit(1)), F.sum(F.octet_length("t"))).first()
    if not total[0]:
        return
    n = max(-(-total[0] // BLOCK_ITEMS), -(-total[1] // BLOCK_BYTES))
    # dealt by position, since equal queries share every hash
    dealt = cut_lineage(src.select("i", "t", F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("b")))
    for k in range(n):
        yield [tuple(r) for r in dealt.where(F.col("b") == k).select("i", "t").collect()]


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``d``, number of terms ``n``, and the query terms of each document with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            n, first, term, tf = [], [0], [], []
            for t in batch.column("t").to_pylist():
                words = terms_of(t)
                found = Counter(map(get, words))
                found.pop(None, None)
                n.append(len(words))
                term.extend(found.keys())
                tf.extend(found.values())
                first.append(len(term))
            ends = pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))],
                ["d", "n", "term", "tf"])

    return docs.mapInArrow(run, f"d {kind}, n long, term array<int>, tf array<long>")


def _searched(vectors: DataFrame, queries: Queries, n_docs: int, n_terms: int) -> DataFrame:
    """The best documents of every task: ``q``, ``score``, ``d``."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)
    kind = vectors.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value)
        schema = None
        for batch in batches:
            schema = batch.schema
            ids, term, tf = batch.column("d"), batch.column("term"), batch.column("tf")
            n = batch.column("n").to_numpy()
            for a in range(0, len(n), TREE):
                t, f = term.slice(a, TREE), tf.slice(a, TREE)
                first = np.concatenate([[0], np.cumsum(pc.list_value_length(t).to_numpy(zero_copy_only=False))]).astype(np.int64)
                size = n[a:a + TREE]
                m = 50 + (50 * size * n_docs) // n_terms
                occurs = f.flatten().to_numpy().astype(np.int64)
                x = (SCALE * occurs) // (1000 * occurs + 20 * np.repeat(m, np.diff(first)))
                best.search(Vectors(first, t.flatten().to_numpy().astype(np.int64), x.astype(float)), ids.slice(a, TREE).to_pylist())
        rows = best.rows()
        if rows:
            q, s, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.int64()), pa.array(d, schema.field("d").type)], ["q", "score", "d"])

    return vectors.select("d", "n", "term", "tf").mapInArrow(run, f"q int, score long, d {kind}")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("d").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest score above 0 for every item.

    Terms are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII. With N
    documents that have terms, L terms in them and df documents holding a term, its weight is
    ``floor(1000 * ln((2N + 2) / (2 df + 1)))``; a document of n terms scores the sum over the
    item's distinct terms of ``weight * (1e9 tf div (1000 tf + 20 m))``, ``m = 50 + 50 n N div L``.

    Equal scores rank by ascending id, null ids last; rows with the same id are documents of
    their own. Null and empty texts match nothing, nor do items without terms; equal items each
    have their rows. Without documents or items the result is empty. Other columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    item_type = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {src.schema['d'].dataType.simpleString()}, score long")
    size = None
    for block in _blocks(items, item_id, item_text):
        vocabulary: dict[bytes, int] = {}
        terms = [sorted({vocabulary.setdefault(w, len(vocabulary)) for w in terms_of(t)}) for _, t in block]
        if not vocabulary:
            continue
        vectors = cut_lineage(_vectors(src, vocabulary))
        if size is None:
            size = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        n_docs, n_terms = size
        if not n_docs:
            break
        vectors = vectors.where(F.size("term") > 0)
        df = vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        known = dict(df.collect())  # as many rows as the block has terms
        weights = np.array([weight(n_docs, known.get(t, 0)) for t in range(len(vocabulary))], np.int64)

        floor = np.zeros(len(block), np.int64)
        sample = vectors.where(F.pmod(F.xxhash64("d"), F.lit(SHARE)) == 0)
        first = _ranked(_searched(sample, Queries(terms, weights, k, floor), n_docs, n_terms), k).where(F.col("rank") == k)
        for q, score in first.select("q", "score").collect():  # one row per query
            floor[q] = score
        best = _ranked(_searched(vectors, Queries(terms, weights, k, floor), n_docs, n_terms), k)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"q int, item_id {item_type}")
        out = out.unionByName(best.join(F.broadcast(names), "q").select("item_id", "rank", F.col("d").alias("doc_id"), "score"))
    return out

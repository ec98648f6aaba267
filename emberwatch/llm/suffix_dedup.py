"""Exact substring dedup by a column-wise construction of suffix orders.

Every window of ``length`` bytes has an anchor, its k-gram of the smallest hash;
equal windows have equal anchors at equal offsets. Consecutive windows of one
anchor form a piece. Spark counts anchors and pieces by their hashes: anchors that
occur once are done, and so are pieces that occur twice (all their windows repeat).
The other pieces of repeated anchors are brought together by anchor, and each task
builds the order of their suffixes column by column: every round inserts one symbol
per piece in front of its suffix, from the last column to the first, and updates the
order (the Burrows-Wheeler column is the row of inserted symbols) and the common
prefixes of neighbours. A window repeats if it shares ``length`` bytes with a
neighbour. Pieces are read as a sorted stream in blocks of whole anchors; an anchor
of very many pieces is cut into several blocks, whose open windows are compared by
a digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.llm.columns import packed, unpacked
from emberwatch.session import cut_lineage

LENGTH = 200
#: Bytes of an anchor. Shorter ones make fewer pieces, longer ones repeat by chance less often.
ANCHOR = 48
#: Pieces whose suffixes are ordered together.
BLOCK = 4096
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def pieces_of(raw: bytes, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hash, first window, last window and anchor position of every piece, in parts of bounded size."""
    n = len(raw)
    octets = np.frombuffer(raw, np.uint8)
    spots = length - k + 1  # anchors to choose from in a window
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    for at in range(0, n - length + 1, _CHUNK):
        part = octets[at:at + _CHUNK + length - 1].astype(np.uint64)
        with np.errstate(over="ignore"):
            up = np.ones(len(part) + 1, np.uint64)
            up[1:] = np.cumprod(np.full(len(part), np.uint64(_BASE)))
            down = np.cumprod(np.full(len(part), inverse))
            sums = np.concatenate([[np.uint64(0)], np.cumsum((part + np.uint64(1)) * down)])
            grams = _mixed((sums[k:] - sums[:-k]) * up[:len(sums) - k])
        key = (grams >> np.uint64(22) << np.uint64(22)) | np.arange(len(grams), dtype=np.uint64)
        low, width = key, 1
        while width * 2 <= spots:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < spots:
            rest = spots - width
            low = np.minimum(low[:-rest], low[rest:])
        anchor = (low & np.uint64((1 << 22) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        yield grams[anchor[first]].view(np.int64), first + at, last + at, anchor[first] + at


def repeated_windows(pieces: list[tuple[object, bytes, int]], length: int) -> list[np.ndarray]:
    """For pieces (group, bytes, offset of the anchor): which of their windows also occur in another piece of the group.

    ``pieces`` are sorted by group. One symbol per piece is inserted in each round.
    """
    m = len(pieces)
    sizes = np.array([len(p[1]) for p in pieces], np.int64)
    front = np.array([p[2] for p in pieces], np.int64)
    group = np.zeros(m, np.int64)
    for i in range(1, m):
        group[i] = group[i - 1] + (pieces[i][0] != pieces[i - 1][0])
    flat = np.frombuffer(b"".join(p[1] for p in pieces), np.uint8)
    begin = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    out = [np.zeros(w, bool) for w in windows.tolist()]
    found_piece, found_window = [], []
    order, common = np.arange(m), np.zeros(m + 1, np.int64)  # common[r]: prefix shared by the suffixes at r - 1 and r
    for x in range(int((sizes - front).max(initial=0)) - 1, -int(front.max(initial=0)) - 1, -1):
        place = front[order] + x
        inside = (place >= 0) & (place < sizes[order])
        symbol = np.zeros(m, np.int64)  # 0: nothing of this piece in this column
        symbol[inside] = flat[begin[order[inside]] + place[inside]].astype(np.int64) + 1
        key = group[order] * 257 + symbol
        step = np.argsort(key, kind="stable")
        key, held = key[step], symbol[step] > 0
        same = np.flatnonzero((key[1:] == key[:-1]) & held[1:]) + 1
        shared = np.zeros(m + 1, np.int64)
        if len(same):
            # the shortest common prefix between the two former places, one symbol longer
            spans = np.column_stack([step[same - 1] + 1, step[same] + 1]).ravel()
            shared[same] = np.minimum.reduceat(common, spans)[::2] + 1
        order, common = order[step], shared
        if x <= 0:
            start = front[order] + x
            ok = held & (start >= 0) & (start < windows[order]) & (np.maximum(common[:-1], common[1:]) >= length)
            found_piece.append(order[ok])
            found_window.append(start[ok])
    for p, w in zip(np.concatenate([*found_piece, np.zeros(0, np.int64)]).tolist(), np.concatenate([*found_window, np.zeros(0, np.int64)]).tolist()):
        out[p][w] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


_FOUND = "digest binary, id long, rid long, start long, stop long"


def _compare(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Marks (start, stop) of repeated windows; of anchors cut into several blocks also the digests of windows that are open or stand for a class."""
    held: list[tuple] = []

    def flush(rows: list[tuple]) -> pd.DataFrame:
        flags = repeated_windows([((r[0], r[1]), r[8], r[6]) for r in rows], length)
        out: list[tuple] = []
        for r, f in zip(rows, flags):
            if r[7] == 1:  # a piece that occurs more often is marked already
                out += [(None, r[3], r[4], r[5] + a, r[5] + b - 1 + length) for a, b in _runs(f)]
        told: set[tuple] = set()  # a class speaks once for each block of an anchor
        for r, f in zip(rows, flags):
            if r[2] > 1:
                for w in range(len(f)):
                    d = xxhash.xxh3_128_digest(r[8][w:w + length])
                    if (r[1], d) not in told:
                        told.add((r[1], d))
                        closed = f[w] or r[7] > 1
                        out.append((d, None, None, None, None) if closed else (d, r[3], r[4], r[5] + w, r[5] + w + length))
        return pd.DataFrame(out, columns=["digest", "id", "rid", "start", "stop"], dtype=object)  # numbers beside nulls stay exact

    for pdf in batches:
        for r in pdf[["anchor", "salt", "salts", "id", "rid", "first", "front", "n", "piece"]].itertuples(index=False, name=None):
            if len(held) >= BLOCK and (r[0], r[1]) != (held[-1][0], held[-1][1]):
                yield flush(held)
                held = []
            held.append(r)
    if held:
        yield flush(held)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else in the table.

    Adds ``n_bytes``, ``n_removed``, ``spans`` (start, end of the maximal removed runs)
    and ``kept`` (remaining bytes, binary) in place of the text. Matches lie within one
    document; the same document counts as elsewhere, and overlaps count. Null texts are
    empty; texts shorter than ``length`` stay whole. Repeated rows repeat each other.
    """
    if not 0 < anchor <= length < anchor + 1024:
        raise ValueError("length must be at least anchor, and less than anchor + 1024")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    integral = isinstance(docs.schema[doc_id].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    number = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(0)) if integral else F.xxhash64(F.col(f"`{doc_id}`"))
    src = docs.select(number.alias("id"), F.xxhash64(F.to_json(packed(docs, text)), t).alias("rid"), F.struct(packed(docs, text), t.alias("t")).alias("d"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r, t in zip(batch["id"].to_pylist(), batch["rid"].to_pylist(), batch["t"]):
                raw = t.as_py()
                for grams, first, last, at in pieces_of(raw, length, anchor):
                    sums = [xxhash.xxh64_intdigest(raw[a:b + length], o) for a, b, o in zip(first.tolist(), last.tolist(), (at - first).tolist())]
                    n = len(grams)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(grams), pa.array(np.array(sums, np.uint64).view(np.int64)), pa.array(np.full(n, i)), pa.array(np.full(n, r)),
                        pa.array((first << 20) | (last - first) << 10 | (at - first))], ["anchor", "sum", "id", "rid", "at"])

    # at: first window, windows behind it and offset of the anchor in one number
    all_pieces = src.select("id", "rid", F.col("d.t").alias("t")).mapInArrow(cut, "anchor long, sum long, id long, rid long, at long")
    twice = all_pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("sum").alias("a"), F.max("sum").alias("b")).where("n > 1")
    twice = twice.select(F.bitwise_not("anchor").alias("k"), (F.col("a") != F.col("b")).alias("mixed"))
    # both sides have an exchange of their own, so an anchor of very many documents is split
    again = cut_lineage(all_pieces.withColumn("k", F.bitwise_not("anchor")).join(twice, "k").drop("k"))

    kinds = again.groupBy("anchor", "sum").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "rid", "at")).alias("one"), F.max("mixed").alias("mixed"))
    kinds = cut_lineage(kinds)
    first, more, front = F.expr("shiftright(at, 20)"), F.expr("shiftright(at, 10) & 1023L"), F.expr("at & 1023L")
    whole = kinds.where("n > 1").select(F.bitwise_not("anchor").alias("k1"), F.bitwise_not("sum").alias("k2"))
    whole = again.withColumns({"k1": F.bitwise_not("anchor"), "k2": F.bitwise_not("sum")}).join(whole, ["k1", "k2"], "left_semi")
    whole = whole.select("id", "rid", first.alias("start"), (first + more + length).alias("stop"))

    mixed = kinds.where("mixed")
    many = mixed.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("salts")).select(F.bitwise_not("anchor").alias("k"), "salts")
    chosen = mixed.withColumn("k", F.bitwise_not("anchor")).join(many, "k")
    chosen = chosen.select("anchor", F.pmod("sum", "salts").alias("salt"), "salts", "n", "one.id", "one.rid", F.col("one.at").alias("at"))
    wanted = chosen.groupBy("id", "rid").agg(F.collect_list(F.struct("anchor", "salt", "salts", "n", first.alias("first"), more.alias("more"), front.alias("front"))).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, r, d, wanted in zip(batch["id"].to_pylist(), batch["rid"].to_pylist(), batch["d"], batch["wanted"].to_pylist()):
                raw = d["t"].as_py()
                seen = {(w["first"], w["more"], w["salt"], w["anchor"]): w for w in wanted}.values()
                rows += [(w["anchor"], w["salt"], w["salts"], i, r, w["first"], w["front"], w["n"], raw[w["first"]:w["first"] + w["more"] + length]) for w in seen]
                while len(rows) >= 8192:
                    yield _batch(rows[:8192])
                    rows = rows[8192:]
            yield _batch(rows)

    kind = "anchor long, salt long, salts long, id long, rid long, first long, front long, n long, piece binary"
    texts = src.join(wanted, ["id", "rid"]).mapInArrow(fetch, kind)
    texts = texts.repartition(F.col("anchor"), F.col("salt")).sortWithinPartitions("anchor", "salt")
    found = cut_lineage(texts.mapInPandas(lambda batches: _compare(batches, length), _FOUND))
    marks = found.where("start is not null and digest is null").select("id", "rid", "start", "stop")
    open_windows = found.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("id", "rid", "start", "stop")).alias("all"))
    late = open_windows.where("n > 1").select(F.explode("all").alias("w")).where("w.start is not null").select("w.*")
    marks = marks.unionByName(whole).unionByName(late).groupBy("id", "rid").agg(F.collect_set(F.struct("start", "stop")).alias("marks"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, sizes = [], [], []
            for d, marked in zip(batch["d"], batch["marks"].to_pylist()):
                raw, runs = d["t"].as_py(), []
                for m in sorted((m["start"], m["stop"]) for m in marked or []):
                    if runs and m[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], m[1])
                    else:
                        runs.append(list(m))
                edges = [0, *[x for run in runs for x in run], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "end": b} for a, b in runs])
                sizes.append(len(raw))
            row = batch["d"].field("row") if isinstance(batch["d"], pa.StructArray) else pa.array([])
            yield pa.RecordBatch.from_arrays([
                row, pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["row", "n_bytes", "spans", "kept"])

    schema = T.StructType([T.StructField("row", src.schema["d"].dataType["row"].dataType), *T._parse_datatype_string(
        "n_bytes long, spans array<struct<start: long, end: long>>, kept binary").fields])
    out = src.join(marks, ["id", "rid"], "left").select("id", "rid", "d", "marks").mapInArrow(remove, schema)
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]), F.lit(0)).cast("long")
    return unpacked(out.withColumn("n_removed", removed).select("row", "n_bytes", "n_removed", "spans", "kept"), ["n_bytes", "n_removed", "spans", "kept"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["anchor", "salt", "salts", "id", "rid", "first", "front", "n"]
    return pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], pa.int64()) for k in range(8)], pa.array([r[8] for r in rows], pa.binary())], [*names, "piece"])

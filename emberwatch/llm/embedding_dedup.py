"""Embedding near-dedup by collision-counting projections.

Vectors of one label are sorted into overlapping windows of a few one-dimensional
projections (cells), so that a close pair shares a cell. Within a cell every pair
counts its collisions: projections in which one vector lies in the window centred
on the other. Pairs that reach a count calibrated for recall are verified by their
cosine in double precision. Cells are cut into tiles of bounded size and every
pair of tiles is a task; a task returns link counts and a spanning forest of its
links, never the links themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.columns import packed, unpacked
from emberwatch.llm.components import components
from emberwatch.session import cut_lineage

COSINE = 0.98
#: Distinct vectors of a cell before another projection splits it, and of a tile.
CELL = 2048
TILE = 1024
#: Projections that may split, and projections whose collisions are counted.
SPLITS = 24
COUNTED = 24
#: Half widths in standard deviations of the difference of a pair at the threshold.
MARGIN = 1.25
WINDOW = 2.5
#: Share of pairs at the threshold that may miss the count.
MISSED = 1e-6


def spread(cosine: float) -> float:
    """Standard deviation of the difference of two projections for unit vectors of this cosine."""
    return math.sqrt(2 * (1 - cosine))


def needed(counted: int = COUNTED, window: float = WINDOW, missed: float = MISSED) -> int:
    """The largest collision count that all but ``missed`` of the pairs at the threshold reach."""
    p = math.erf(window / math.sqrt(2))
    below, t = 0.0, 0
    while True:
        below += math.comb(counted, t) * p ** t * (1 - p) ** (counted - t)
        if below > missed:
            return t
        t += 1


def directions(dim: int) -> np.ndarray:
    """Random directions; the same for every vector of a dimension."""
    return np.random.default_rng(7919 + dim).standard_normal((SPLITS + COUNTED, dim))


def _unit(vectors) -> np.ndarray:
    """Vectors of length one. Each is brought near one by a power of two first, which rounds nothing, so that no norm overflows or vanishes."""
    x = np.array(list(vectors), np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest reachable index (rows first) for the rows and the columns of a link matrix."""
    n, far = link.shape[0], link.shape[0] + link.shape[1]
    rows, cols = np.arange(n), np.arange(n) if same else np.arange(n, far)
    while True:
        new_cols = np.minimum(cols, np.where(link, rows[:, None], far).min(axis=0))
        new_rows = np.minimum(rows, np.where(link, new_cols[None, :], far).min(axis=1))
        if same:
            new_cols = new_rows = np.minimum(new_rows, new_cols)
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def compare_tiles(a: pd.DataFrame, b: pd.DataFrame, cell: int, splits: int, same: bool, cosine: float) -> pd.DataFrame:
    """Weighted link counts of the rows of two tiles and edges that connect what is linked."""
    xa, xb = _unit(a["v"]), _unit(b["v"])
    counted = directions(xa.shape[1])[SPLITS:]
    pa, pb = (xa @ counted.T).astype(np.float32), (xb @ counted.T).astype(np.float32)
    half, least = WINDOW * spread(cosine), needed()
    link = np.zeros((len(a), len(b)), bool)
    la, lb = a["lower"].to_numpy(np.int64), b["lower"].to_numpy(np.int64)
    full = (1 << splits) - 1
    for at in range(0, len(a), 128):
        part = slice(at, at + 128)
        hits = np.zeros((len(pa[part]), len(b)), np.int8)
        for k in range(COUNTED):
            hits += np.abs(pa[part, k, None] - pb[None, :, k]) <= half
        candidate = hits >= least
        if candidate.any():
            close = candidate & (xa[part] @ xb.T >= cosine)
            # a pair of several cells counts in the first of them
            close &= ((~(la[part, None] & lb[None, :])) & full) == cell
            link[part] = close
    if same:
        np.fill_diagonal(link, False)
    if not link.any():
        return pd.DataFrame({"node": [], "links": [], "other": []})
    na, nb = a["n"].to_numpy(np.int64), b["n"].to_numpy(np.int64)
    out = [(a["node"].to_numpy(np.int64), link @ nb)] + ([] if same else [(b["node"].to_numpy(np.int64), na @ link)])
    node, links = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    rows, cols = _forest(link, same)
    names = node if not same else a["node"].to_numpy(np.int64)
    root = names[rows if same else np.concatenate([rows, cols])]
    linked = links > 0
    return pd.DataFrame({"node": node[linked], "links": links[linked], "other": root[linked]})


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """Adds ``n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable) and ``kept``.

    Only vectors of equal, not null label and equal length are compared. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing and
    are their own component. Equal vectors are compared once and counted as often as
    they occur. Null ids are never the smallest. An empty table gives an empty table.
    """
    e, lab = F.col(f"`{embedding}`"), F.col(f"`{label}`")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = lab.isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~odd & F.exists(e, lambda x: x != 0)
    src = vectors.select(packed(vectors), F.col(f"`{vec_id}`").alias("id"), F.coalesce(valid, F.lit(False)).alias("ok"),
                         F.xxhash64(lab.cast("string"), e).alias("node"), F.xxhash64(F.lit(1), lab.cast("string"), F.size(e)).alias("part"), e.alias("v"))
    distinct = src.where("ok").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("part").alias("part"),
                                                   F.first("v").alias("v"))
    distinct = cut_lineage(distinct)

    def centres(batches):
        for pdf in batches:
            for part, g in pdf.groupby("part"):
                x = _unit(g["v"])
                yield pd.DataFrame({"part": [part], "n": [len(x)], "s": [(x @ directions(x.shape[1])[:SPLITS].T).sum(axis=0)]})

    sums = distinct.select("part", "v").mapInPandas(centres, "part long, n long, s array<double>")
    middle = sums.groupBy("part").agg(F.sum("n").alias("members"), F.array(*[F.sum(F.get("s", i)) / F.sum("n") for i in range(SPLITS)]).alias("centre"))
    # each split leaves about six tenths of a cell
    splits = F.least(F.lit(SPLITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("members") / CELL) / 0.75))).cast("int")
    middle = middle.where(F.col("members") > 1).select(F.bitwise_not("part").alias("k"), "centre", splits.alias("splits"))
    placed = distinct.withColumn("k", F.bitwise_not("part")).join(middle, "k").select("part", "node", "n", "v", "centre", "splits")
    margin = MARGIN * spread(cosine)

    def cells(batches):
        for pdf in batches:
            for _, g in pdf.groupby("part"):
                splits = int(g["splits"].iloc[0])
                x = _unit(g["v"])
                away = x @ directions(x.shape[1])[:splits].T - np.array(g["centre"].iloc[0])[:splits]
                power = 1 << np.arange(splits, dtype=np.int64)
                lower, upper = ((away <= margin) * power).sum(axis=1), ((away > -margin) * power).sum(axis=1)
                at, cell = np.arange(len(x)), np.zeros(len(x), np.int64)
                for k in range(splits):
                    up, down = (upper[at] >> k) & 1 == 1, (lower[at] >> k) & 1 == 1
                    at, cell = np.concatenate([at[down], at[up]]), np.concatenate([cell[down], cell[up] | (1 << k)])
                out = g[["part", "node", "n", "v", "splits"]].iloc[at].copy()
                out["cell"], out["lower"] = cell, lower[at]
                yield out

    held = cut_lineage(placed.mapInPandas(cells, "part long, node long, n long, v array<double>, splits int, cell long, lower long"))
    tiles = held.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    tiles = tiles.select(F.xxhash64("part", "cell").alias("k"), F.ceil(F.col("rows") / TILE).cast("int").alias("tiles"))
    rows = held.withColumn("k", F.xxhash64("part", "cell")).join(tiles, "k")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        cell, splits, i, j = int(first["cell"]), int(first["splits"]), int(first["i"]), int(first["j"])
        a = pdf[pdf["tile"] == i]
        b = a if i == j else pdf[pdf["tile"] == j]
        return compare_tiles(a, b, cell, splits, i == j, cosine) if len(a) and len(b) else pd.DataFrame({"node": [], "links": [], "other": []})

    found = cut_lineage(rows.groupBy("part", "cell", "i", "j").applyInPandas(compare, "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    known = distinct.select("node", "n", "least").join(links, "node", "left").join(roots, "node", "left")
    known = cut_lineage(known.select("node", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))
    ids = known.groupBy("root").agg(F.min("least").alias("component")).select(F.bitwise_not("root").alias("r"), "component")
    known = known.withColumn("r", F.bitwise_not("root")).join(ids, "r").select(F.bitwise_not("node").alias("k"), "n", "links", "component")
    out = src.withColumn("k", F.when(F.col("ok"), F.bitwise_not("node"))).join(known, "k", "left")
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("id"))
    out = out.select("row", F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                     F.col("id").eqNullSafe(component).alias("kept"))
    return unpacked(out, ["n_links", "component_id", "kept"])

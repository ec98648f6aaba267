"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logit that is linear in its
words and their beginnings, and the document's probability is the noisy-or of its
sentences, so document labels train sentence scores, and the sentences that carry
the score can be pointed out. The fit runs on a bounded sample of labelled rows:
Spark counts features by label and keeps those that tell the labels apart; their
weights are fitted by gradient steps. Scoring is a map over all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.columns import packed, unpacked

#: The fit reads at most so many labelled rows, those of the smallest id hashes, and of them texts of up to FIT_CHARS characters.
FIT_ROWS = 8000
FIT_CHARS = 100_000
#: Features kept: of at least MIN_DOCS documents, MIN_Z standard errors between the labels, the MAX_FEATURES furthest apart.
MIN_DOCS, MIN_Z, MAX_FEATURES = 5, 4.5, 20_000
#: A word counts as itself and with so many of its first bytes.
BEGINNINGS = (4, 5, 6)
#: A sentence is reported from this score on.
OFFENDING = 0.5
THRESHOLD = 0.7

_word = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)) + b"'"
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _word else 0x0A if c in b".!?\n" else 0x20 for c in range(256))
_CACHE = 1 << 18


def sentences_of(text: str | None) -> list[bytes]:
    """Lower-cased sentences with one byte for each byte of the text; they end at ``.``, ``!``, ``?`` and line ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b"\n")


def features_of(word: bytes) -> list[int]:
    """Hashes of a word and its beginnings; the two never share a number on purpose."""
    return [zlib.crc32(word), *[zlib.crc32(word[:k], 1) for k in BEGINNINGS if len(word) > k]]


@dataclass
class Model:
    """``weights`` of the kept features and the logit ``bias`` of a sentence without any."""

    weights: dict[int, float]
    bias: float

    def weight(self, word: bytes) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features_of(word)])

    def score(self, text: str | None, memo: dict[bytes, float]) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over the sentences, and (start, end, score) in bytes of those from OFFENDING on."""
        total, at, found = 0.0, 0, []
        for s in sentences_of(text):
            words = set(s.split())
            if words:
                z = self.bias
                for w in words:
                    x = memo.get(w)
                    if x is None:
                        if len(memo) >= _CACHE:
                            memo.clear()
                        x = memo[w] = self.weight(w)
                    z += x
                total += np.log1p(np.exp(z)) if z < 30 else z
                if z >= 0:
                    p = 1 / (1 + np.exp(-z))
                    if p >= OFFENDING:
                        found.append((at, at + len(s), float(p)))
            at += len(s) + 1
        return float(-np.expm1(-total)), found


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS,
        chars: int = FIT_CHARS, rounds: int = 150) -> Model:
    """Fit on up to ``rows`` labelled documents (see FIT_ROWS). Without labels of both kinds every score is the share of label 1, or 0.5 without any."""
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).where(F.length("t") <= chars)
    bags = texts.join(F.broadcast(chosen), "id").select("y", "t")  # at most ``rows`` ids

    def count(batches):
        for pdf in batches:
            seen = [Counter(), Counter()]
            for y, t in zip(pdf["y"], pdf["t"]):
                words = {w for s in sentences_of(t) for w in s.split()}
                seen[y].update({f for w in words for f in features_of(w)})
            for y in (0, 1):
                yield pd.DataFrame({"f": list(seen[y]), "y": y, "n": list(seen[y].values())})

    size = {r["y"]: r["n"] for r in bags.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)
    if not clean or not toxic:
        p = min(max(toxic / (clean + toxic) if clean + toxic else 0.5, 1e-4), 1 - 1e-4)
        return Model({}, float(np.log(p / (1 - p))))
    tally = bags.mapInPandas(count, "f long, y int, n long").groupBy("f").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
    both = (F.col("p") + F.col("q")) / (clean + toxic)
    error = F.sqrt(both * (1 - both) * (1 / clean + 1 / toxic) + 1e-12)
    z = F.abs(F.col("p") / toxic - F.col("q") / clean) / error
    kept = tally.where(F.col("p") + F.col("q") >= MIN_DOCS).withColumn("z", z).where(F.col("z") >= MIN_Z)
    names = sorted(r["f"] for r in kept.orderBy(F.desc("z"), "f").limit(MAX_FEATURES).select("f").collect())
    place = {f: i for i, f in enumerate(names)}

    def featurise(batches):
        for pdf in batches:
            words, ends = [], []
            for t in pdf["t"]:
                bag = [sorted({place[f] for w in s.split() for f in features_of(w) if f in place}) for s in sentences_of(t) if s.strip()]
                words.append(np.array([x for s in bag for x in s], np.int32))
                ends.append(np.cumsum([len(s) for s in bag]).astype(np.int32))
            yield pd.DataFrame({"y": pdf["y"], "words": words, "ends": ends})

    got = bags.mapInPandas(featurise, "y int, words array<int>, ends array<int>").limit(2 * rows).toPandas()
    weights, bias = _train(got["y"].to_numpy(np.float64), list(got["words"]), list(got["ends"]), len(names), rounds)
    return Model(dict(zip(names, weights.tolist())), bias)


def _train(y: np.ndarray, words: list[np.ndarray], ends: list[np.ndarray], size: int, rounds: int, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Gradient steps on the noisy-or likelihood; ``words`` are the features of all sentences of a document, ``ends`` where each sentence ends."""
    sizes = [np.diff(np.concatenate([[0], e])) for e in ends]
    lengths = np.concatenate([*sizes, np.zeros(0)]).astype(np.int64)
    doc = np.repeat(np.arange(len(y)), [len(s) for s in sizes])
    col = np.concatenate([*words, np.zeros(0)]).astype(np.int64)
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    w, b = np.zeros(size), float(np.log(y.mean() / max(1.0, len(lengths) / len(y))))
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(sentence, w[col], minlength=len(lengths))
        lam = np.bincount(doc, np.logaddexp(0, z), minlength=len(y))  # P(clean) = exp(-lam)
        # d loss / d lam: 1 for label 0, -exp(-lam) / (1 - exp(-lam)) for label 1
        slope = np.where(y > 0, -1 / np.expm1(np.clip(lam, 1e-6, 50)), 1.0) / len(y)
        g_z = slope[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        g = np.bincount(col, g_z[sentence], minlength=size) + penalty * w
        g_b = g_z.sum()
        rate = 0.15 if t < rounds * 2 // 3 else 0.05
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * g_b, 0.99 * sb + 0.01 * g_b * g_b
        fix1, fix2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        w -= rate * (m / fix1) / (np.sqrt(s / fix2) + 1e-7)
        b -= rate * (mb / fix1) / (np.sqrt(sb / fix2) + 1e-7)
    return w, float(b)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``offending``: start, end (bytes of the UTF-8 text) and score of each sentence from OFFENDING on.

    Null, empty and wordless texts score 0 without a sentence. The whole text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score double, offending array<struct<start int, end int, score double>>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        memo = scored_memo
        got = [shared.value.score(t, memo) for t in texts]
        return pd.DataFrame({"score": [g[0] for g in got], "offending": [[{"start": a, "end": b, "score": p} for a, b, p in g[1]] for g in got]})

    scored_memo: dict[bytes, float] = {}
    src = docs.select(packed(docs, text), F.col(f"`{text}`").alias(text), scored(F.col(f"`{text}`").cast("string")).alias("s"))
    out = src.select("row", text, F.col("s.score").alias("score"), F.col("s.offending").alias("offending"))
    return unpacked(out, [text, "score", "offending"])

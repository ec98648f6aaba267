"""Quality classifier: regularised quadratic discriminant over document statistics.

The statistics of all documents come from one map and are kept; class moments are
sums over every labelled training row, taken by Spark. Both covariances are shrunk
towards their common one and its diagonal; the score is the logistic of the
difference of two Mahalanobis log densities, with inverse Cholesky factors kept in
the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.columns import packed, unpacked

STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "symbols", "repeated_words", "repeated_pairs", "repeated_lines",
    "words_with_marks", "line_length", "word_length_spread", "mark_pairs", "bars",
]
THRESHOLD = 0.3
_UPPER = np.arange(0x41, 0x5B)
_DIGIT = np.arange(0x30, 0x3A)
_MARK = np.array([c for c in range(0x21, 0x7F) if not chr(c).isalnum()])
_SYMBOL = np.array([c for c in map(ord, "#$%&*+/<=>@\\^_`{|}~")])


def _square(share: float) -> float:
    """Spreads small shares; their variance then hardly depends on their mean."""
    return float(np.sqrt(max(share, 0.0)))


def statistics_of(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; all zero without any word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    octets = np.frombuffer(raw, np.uint8)
    counts = np.bincount(octets, minlength=256)
    letters = max(1, size - int(counts[[0x20, 0x0A, 0x0D, 0x09]].sum()))
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    is_mark = np.isin(octets, _MARK)
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(np.log1p(lengths.mean())), _square(counts[_UPPER].sum() / letters),
        _square(counts[_DIGIT].sum() / letters), _square(counts[_MARK].sum() / letters), _square(counts[_SYMBOL].sum() / letters),
        _square(1 - len(set(words)) / n), _square(1 - pairs / (n - 1)) if n > 1 else 0.0, _square(1 - len(set(lines)) / len(lines)),
        _square(np.isin(last, _MARK).sum() / n), float(np.log1p(size / len(lines))), float(np.log1p(lengths.std())),
        _square((is_mark[1:] & is_mark[:-1]).sum() / letters), _square(words.count(b"|") / n),
    ]


def statistics(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics_of(t) for t in texts], dtype=object)

    return measured(text)


@dataclass
class Model:
    means: np.ndarray  # class, statistic
    factors: np.ndarray  # inverse Cholesky factors of the covariances
    constants: np.ndarray  # log prior - log determinant / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means.size:
            return np.full(len(x), 1 / (1 + np.exp(-(self.constants[1] - self.constants[0]))))
        log = [self.constants[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -60, 60)))


def fit(measured: DataFrame, shrink_common: float = 0.1, shrink_diagonal: float = 0.05) -> Model:
    """Fit from ``y`` (0 or 1) and ``x`` (statistics) of all training rows; only class sums reach the driver.

    A class of fewer than two rows leaves the share of label 1 as the score of everything (0.5 without labels).
    """
    d = len(STATISTICS)
    x = [F.get("x", i) for i in range(d)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = {r["y"]: r for r in measured.where("y in (0, 1)").groupBy("y").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    n = np.array([float(rows[k]["n"]) if k in rows else 0.0 for k in (0, 1)])
    prior = np.log((n + 0.5) / (n.sum() + 1))
    if n.min() < 2:
        return Model(np.zeros((2, 0)), np.zeros((2, 0, 0)), prior)
    means, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        means[k] = [rows[k][f"s{i}"] / n[k] for i in range(d)]
        for i in range(d):
            for j in range(i + 1):
                scatter[k, i, j] = scatter[k, j, i] = rows[k][f"p{i}_{j}"] / n[k] - means[k, i] * means[k, j]
    common = (n[:, None, None] * scatter).sum(axis=0) / n.sum()
    scale = np.diag(np.diag(common) + 1e-6)
    factors, constants = np.zeros_like(scatter), np.zeros(2)
    for k in (0, 1):
        # few rows of a class: rely more on the common covariance
        a = max(shrink_common, d / (d + n[k]))
        cov = (1 - a) * scatter[k] + a * common
        cov = (1 - shrink_diagonal) * cov + shrink_diagonal * scale
        lower = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
        factors[k] = np.linalg.inv(lower)
        constants[k] = prior[k] - np.log(np.diag(lower)).sum()
    return Model(means, factors, constants)


def scored(measured: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` to rows with their statistics in ``x``."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def by_density(xs: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array(xs.tolist(), np.float64).reshape(-1, len(STATISTICS))))

    return measured.withColumn("score", by_density("x"))


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score``, the probability of good quality. Null and empty texts have statistics of zero and are scored like any other."""
    src = docs.select(packed(docs, text), F.col(f"`{text}`").alias(text), statistics(F.col(f"`{text}`").cast("string")).alias("x"))
    return unpacked(scored(src, model), [text, "score"])

"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text is turned into a dozen transformed statistics of its form. Class means and
covariances come from sums over all labelled rows, gathered by one distributed aggregate of
fixed size; covariances are shrunk; a score is the difference of the two Gaussian log
densities, as Mahalanobis distances through Cholesky factors computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresift.llm.store import materialize

THRESHOLD = 0.7
#: Weight of the scaled identity in each class covariance, and of the pooled covariance before that.
SHRINK, POOL = 0.02, 0.3
#: Standard deviation below which a statistic counts as constant.
LEAST_SPREAD = 1e-3
#: Observations that a text's shares are drawn towards their usual values by.
PSEUDO = 20
HELD_OUT = 2

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = b".,'\"-"
_SYMBOLS = bytes(sorted(set(range(33, 127)) - set(_UPPER + _LOWER + _DIGITS + _MARKS)))
STATISTICS = (
    "words", "word_bytes", "upper", "digits", "symbols", "marks", "bare",
    "variety", "pairs", "again", "lines", "line_words", "capitalised",
)


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def _logit(part: float, whole: float, usual: float) -> float:
    """Log odds of a share, drawn towards its usual value as if by PSEUDO more observations: short texts stay near it."""
    return float(np.log((part + PSEUDO * usual) / (max(whole - part, 0) + PSEUDO * (1 - usual))))


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one whole text in UTF-8; an empty text has defined ones too."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, size = len(words), len(data)
    upper, lower = _without(data, _UPPER), _without(data, _LOWER)
    again = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    solid = size - _without(data, _SPACE)
    return [
        float(np.log1p(n)),
        float(np.log1p(solid / n)) if n else 0.0,
        _logit(upper, upper + lower, 0.04),
        _logit(_without(data, _DIGITS), size, 0.01),
        _logit(_without(data, _SYMBOLS), size, 0.01),
        _logit(_without(data, _MARKS), size, 0.03),
        _logit(sum(1 for w in words if not (w.isalnum() or w[:1].isalnum() or w[0] > 127)), n, 0.02),
        float(np.log1p(len(set(words))) / np.log1p(n)) if n else 1.0,
        _logit(len(set(zip(words, words[1:], strict=False))), max(n - 1, 0), 0.98),
        _logit(again, max(n - 1, 0), 0.01),
        _logit(len(lines) - len(set(lines)), len(lines), 0.03),
        float(np.log1p(n / len(lines))) if lines else 0.0,
        _logit(sum(map(bytes.istitle, words)), n, 0.12),
    ]


def with_statistics(text: str | Column) -> Column:
    """Array of the statistics; a null text counts as empty."""

    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t or b"") for t in texts.to_pylist()], pa.list_(pa.float64()))

    column = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(compute, T.ArrayType(T.DoubleType()))(column.cast("binary"))


@dataclass
class Discriminant:
    """Two Gaussians over standardised statistics; rows of ``whiten`` are inverse Cholesky factors."""

    prior: float
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    log_dets: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        bad, good = (
            -0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) - 0.5 * d
            for m, w, d in zip(self.means, self.whiten, self.log_dets, strict=True)
        )
        odds = np.clip(good - bad + np.log(self.prior / (1 - self.prior)), -700, 700)
        return 1 / (1 + np.exp(-odds))


def fit(rows: DataFrame) -> Discriminant:
    """Fit on rows (quality 0 or 1, stats). Only sums leave the executors: two rows of d*d numbers.

    With no rows at all every score is 0.5; with a single class present it is that class's share.
    """
    d = len(STATISTICS)
    x = [F.col("stats")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(c) for c in x] + [F.sum(x[i] * x[j]) for i, j in pairs]
    got = {r[0]: r for r in rows.groupBy("quality").agg(F.count("*"), F.array(*sums)).collect()}
    n = [got[c][1] if c in got else 0 for c in (0, 1)]
    if min(n) == 0:
        return Discriminant(n[1] / sum(n) if sum(n) else 0.5, np.zeros(d), np.ones(d), [], [], [])
    means, covs = [], []
    for c in (0, 1):
        values = np.array(got[c][2], dtype=float) / n[c]
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, values[d:], strict=True):
            second[i, j] = second[j, i] = v
        means.append(values[:d])
        covs.append(second - np.outer(values[:d], values[:d]))
    weights = np.array(n) / sum(n)
    centre = weights @ np.array(means)
    within = weights[0] * covs[0] + weights[1] * covs[1]
    spread = within + sum(w * np.outer(m - centre, m - centre) for w, m in zip(weights, means, strict=True))
    scale = np.sqrt(np.maximum(np.diag(spread), LEAST_SPREAD**2))
    whiten, log_dets = [], []
    for c in (0, 1):
        cov = ((1 - POOL) * covs[c] + POOL * within) / np.outer(scale, scale)
        values, vectors = np.linalg.eigh(cov)  # sums of squares cancel: no direction may have less than no variance
        cov = (vectors * np.maximum(values, 0)) @ vectors.T
        cov = (1 - SHRINK) * cov + SHRINK * (np.trace(cov) / d + LEAST_SPREAD) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        log_dets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(float(weights[1]), centre, scale, [(m - centre) / scale for m in means], whiten, log_dets)


def remainder(doc_id: str | Column) -> Column:
    """crc32 of the id as text, mod 4; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 4


def score(model: Discriminant, stats: str) -> Column:
    def compute(values: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(STATISTICS))
        return pa.array(model.scores(x), pa.float64())

    return F.arrow_udf(compute, T.DoubleType())(F.col(stats))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Empty and null texts are scored by the statistics of the empty text. Labels that are null or
    neither 0 nor 1 teach nothing; a document labelled twice teaches twice. Very long texts count
    whole, repeated rows get equal scores, an empty table gives no rows, and other columns of docs,
    of any name, are not read.
    """
    rows = materialize(docs.select("doc_id", with_statistics("text").alias("stats")), "stats")
    model = learn(rows, labels)
    return rows.select(
        "doc_id", (remainder("doc_id") == HELD_OUT).alias("held_out"), score(model, "stats").alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def learn(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the labelled of rows (doc_id, stats), leaving out those held out."""
    taught = labels.where(F.col("quality").isin(0, 1) & (remainder("doc_id") != HELD_OUT)).select("doc_id", "quality")
    return fit(rows.join(taught, "doc_id"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier predicts to be of quality 1.

    Rows are stored with their statistics: labels meet these alone, and texts are looked at once and not moved.
    """
    rows = materialize(docs.select(F.struct("*").alias("row"), "doc_id", with_statistics("text").alias("stats")), "scored")
    model = learn(rows.select("doc_id", "stats"), labels)
    return rows.where(score(model, "stats") >= THRESHOLD).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

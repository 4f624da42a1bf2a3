"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

Statistics of all documents are computed once and kept as a narrow table. Class means and covariances come from sums over
every labelled row outside the held-out fold; covariances shrink towards their pooled form and its diagonal. A score is
the logistic of the difference of Mahalanobis log-densities, from Cholesky factors that are computed once and broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import doc_bytes, documents, materialise, tuned

FOLDS, HELD_OUT = 3, 1
#: Shares of the pooled covariance and of its diagonal in each class's covariance, and what is added to every variance.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.1, 0.1, 1e-2
_SYMBOLS = [bytes([c]) for c in b"#*$%&|<>~^_{}[]@="]
STATISTICS = ("bytes", "words", "word_length", "line_length", "upper", "digits", "symbols", "exclamation", "other_punctuation", "non_ascii", "spaces", "distinct_words", "distinct_pairs", "duplicate_lines", "top_word", "one_letter", "compression")


def _logit(share: float, n: int) -> float:
    """Of a share of n things, drawn in from 0 and 1 so that few things tell less."""
    return float(np.log((share * n + 0.5) / (n - share * n + 0.5)))


def statistics(text: bytes, zip_: zstandard.ZstdCompressor) -> list[float]:
    n, words, lines = len(text), text.split(), text.split(b"\n")
    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    m, kinds, pairs = len(words), set(words), set(zip(words, words[1:], strict=False))
    often: dict[bytes, int] = {}
    if len(kinds) < m:
        for w in words:
            often[w] = often.get(w, 0) + 1
    return [
        np.log1p(n),
        np.log1p(m),
        np.log1p(n / (m + 1)),
        np.log1p(n / len(lines)),
        _logit(raw[65:91].sum() / (n + 1), n + 1),
        _logit(raw[48:58].sum() / (n + 1), n + 1),
        _logit(min(n, sum(map(text.count, _SYMBOLS))) / (n + 1), n + 1),
        _logit(raw[33] / (n + 1), n + 1),
        _logit(raw[[34, 39, 40, 41, 44, 45, 46, 47, 58, 59, 63]].sum() / (n + 1), n + 1),
        _logit(raw[128:].sum() / (n + 1), n + 1),
        _logit(raw[[9, 10, 11, 12, 13, 32]].sum() / (n + 1), n + 1),
        _logit(len(kinds) / (m + 1), m + 1),
        _logit(len(pairs) / (m + 1), m + 1),
        _logit(1 - len(set(lines)) / len(lines), len(lines)),
        _logit(max(often.values(), default=min(m, 1)) / (m + 1), m + 1),
        _logit(sum(len(w) == 1 for w in words) / (m + 1), m + 1),
        np.log((len(zip_.compress(text)) + 1) / (n + 1)),
    ]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document, kept as a table."""

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = [statistics(t, zip_) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "x"])

    return materialise(doc_bytes(docs).mapInArrow(run, "doc_id long, x array<float>"), "statistics")


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor of the covariance, and half its log-determinant."""

    centre: np.ndarray
    scale: np.ndarray
    parts: list[tuple[float, np.ndarray, np.ndarray, float]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), 0.5)
        z = (x - self.centre) / self.scale
        logs = []
        for prior, mean, inverse, half in self.parts:
            y = (z - mean) @ inverse.T
            logs.append(prior - half - 0.5 * (y * y).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """sums: of each class the number of rows, the sum of x and the sum of x x^T."""
    d = len(STATISTICS)
    sums = {c: s for c, s in sums.items() if s[0] > 1}
    if len(sums) < 2:
        return Discriminant(np.zeros(d), np.ones(d), [])
    total = sum(s[0] for s in sums.values())
    means = {c: s[1] / s[0] for c, s in sums.items()}
    own = {c: s[2] / s[0] - np.outer(means[c], means[c]) for c, s in sums.items()}
    pooled = sum(sums[c][0] * own[c] for c in sums) / total
    centre, scale = sum(s[1] for s in sums.values()) / total, np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    pooled = pooled / np.outer(scale, scale)
    parts = []
    for c in (0, 1):
        cov = (1 - TO_POOLED - TO_DIAGONAL) * own[c] / np.outer(scale, scale) + TO_POOLED * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + RIDGE * np.eye(d)
        root = np.linalg.cholesky(cov)
        parts.append((float(np.log(sums[c][0] / total)), (means[c] - centre) / scale, np.linalg.inv(root), float(np.log(np.diag(root)).sum())))
    return Discriminant(centre, scale, parts)


def fit(described: DataFrame, labels: DataFrame) -> Discriminant:
    """From all labelled rows outside the held-out fold; each task adds up its own rows, so 2 * (1 + d + d * d) sums meet."""
    d = len(STATISTICS)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD_OUT)

    def add(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.indices(sums.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(sums.ravel())], names=["label", "k", "v"])

    rows = described.join(known, "doc_id").select("quality", "x").mapInArrow(add, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros((2, 1 + d + d * d))
    sums[rows.label, rows.k] = rows.v
    return discriminant({c: (sums[c, 0], sums[c, 1 : d + 1], sums[c, d + 1 :].reshape(d, d)) for c in (0, 1)})


def classify(described: DataFrame, model: Discriminant) -> DataFrame:
    sent = described.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = sent.value.probabilities(np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return described.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null or empty text is scored by its statistics like any other; without labels of both classes every score is 0.5;
    every row is scored, repeated ones alike; a null doc_id is never held out; an empty table gives no rows; other columns
    are ignored. Texts are read whole, once.
    """
    tuned(docs.sparkSession)
    described = describe(docs)
    return classify(described, fit(described, labels))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Operator 6, quality classifier: regularised quadratic discriminant.

Documents become a short vector of transformed statistics.  Each class has a mean and a covariance that is shrunk towards
the pooled one and then towards its diagonal; its Cholesky factor is computed once and shipped with the scoring function.
The score is the logistic function of the difference of log densities (Mahalanobis distances and determinants) plus the
log ratio of class shares.

The moments are sums over all labelled rows, combined before the exchange, so the fit takes one pass and the driver sees
one row a class.  Labels, lang, source and doc_id are never inputs.

Defined cases: null text counts as empty, and empty texts get a score like any other.  Rows with a null label, and label
rows without a document, take no part in the fit.  If a document has several labels, each takes part.  With no labels the
score is 0.5; with labels of one class only it is that class.  Repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .batches import slices
from .common import cut, table
from .quality import measure

FEATURES = ["log_words", "log_mean_word", "symbols", "repeats", "dup_lines", "line_density", "upper", "bangs", "pipes", "stops", "digits", "log_lines"]
_CLASSES = {}
for _name, _chars in (("bangs", b"!"), ("pipes", b"|"), ("stops", b".,;:?"), ("digits", b"0123456789")):
    _CLASSES[_name] = np.zeros(256, dtype=np.int64)
    _CLASSES[_name][list(_chars)] = 1


def vectors(texts: pa.Array) -> np.ndarray:
    """FEATURES of each text as float64 columns."""
    from .words import text_bytes

    words, chars, symbols, dup, repeat, lines, upper = (x.astype(float) for x in measure(texts))
    data, at = text_bytes(texts)
    per = {k: np.add.reduceat(v[data], at[:-1]).astype(float) for k, v in _CLASSES.items()}
    w, l, c = np.maximum(words, 1), np.maximum(lines, 1), np.maximum(chars, 1)
    return np.column_stack([
        np.log1p(words), np.log1p(chars / w), np.sqrt(symbols / w), np.sqrt(repeat / w), np.sqrt(dup / l), np.sqrt(lines / w),
        np.sqrt(upper / c), np.sqrt(per["bangs"] / w), np.sqrt(per["pipes"] / w), np.sqrt(per["stops"] / w), np.sqrt(per["digits"] / w), np.log1p(lines),
    ])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES, a row for every row of docs."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for b in slices(batch, 1):
                x = vectors(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, i]) for i in range(x.shape[1])]], names=["doc_id", *FEATURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes; share is that of class 1."""

    mean: list[np.ndarray]
    inverse: list[np.ndarray]
    log_det: list[float]
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.mean:
            return np.full(len(x), self.share)
        part = []
        for m, inv, det in zip(self.mean, self.inverse, self.log_det):
            z = (x - m) @ inv.T
            part.append(-0.5 * (z * z).sum(axis=1) - 0.5 * det)
        d = part[1] - part[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def fit(labelled: DataFrame, label: str = "label", to_pooled: float = 0.1, to_diagonal: float = 0.1, ridge: float = 1e-3) -> Discriminant:
    """Fit on rows with FEATURES and a 0/1 label."""
    d = len(FEATURES)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    row = labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in upper],
    ).collect()  # at most two rows
    by = {int(r[label]): r for r in row}
    if len(by) < 2:
        return Discriminant([], [], [], float(next(iter(by))) if by else 0.5)
    mean, cov, n = [], [], []
    for k in (0, 1):
        r = by[k]
        m = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        c = np.zeros((d, d))
        for i, j in upper:
            c[i, j] = c[j, i] = r[f"p{i}_{j}"] / r["n"] - m[i] * m[j]
        mean.append(m)
        cov.append(c)
        n.append(r["n"])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    inverse, log_det = [], []
    for c in cov:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + ridge * np.eye(d)
        low = np.linalg.cholesky(c)
        inverse.append(np.linalg.solve(low, np.eye(d)))
        log_det.append(float(2 * np.log(np.diag(low)).sum()))
    return Discriminant(mean, inverse, log_det, n[1] / (n[0] + n[1]))


def held_out(doc_id=None):
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    c = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for every row of docs."""
    x = cut(features(docs), "features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where("label in (0, 1)").dropDuplicates()
    model = fit(x.where(~held_out()).join(known, "doc_id"))

    def run(batches):
        for b in batches:
            score = model.score(np.column_stack([b.column(i + 1).to_numpy() for i in range(len(FEATURES))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}

"""A quality classifier: regularised quadratic discriminant analysis.

Transformed document statistics are taken as normal within each class.  Class
covariances are shrunk to the pooled one and to a multiple of the identity; a
score is the difference of two log densities, whose Mahalanobis terms use each
class's Cholesky factor, computed once.

Defined results: a null or empty text has all statistics zero and gets a score
like any other; a text of any length is read whole; equal texts get equal
scores; a score of exactly one half is predicted 1; a constant statistic has
the variance that shrinkage gives it; with labels of fewer than two classes every score is the share
of class 1 (a half without labels); repeated label rows count each; a null
label counts for nothing; an empty table gives an empty table; other columns
aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, utf8
from .quality_rules import TextStats
from .scratch import Scratch

_DIGITS, _MARKS, _ENDS = b"0123456789", b"!?;:\"'()[]{}-_=+~^@/\\", b".,"
FEATURES = 16


def features(text: bytes | None) -> list[float]:
    """Log, square-root and ratio transforms of a text's statistics."""
    s = TextStats(text)
    n, chars, lines, size = max(s.n_words, 1), max(s.word_chars, 1), max(len(s.lines), 1), max(len(s.text), 1)
    count = lambda some: size - len(s.text.translate(None, some)) if s.text else 0
    distinct = len(set(s.words))
    letters = max(s.n_upper + s.n_lower, 1)
    return [
        np.log1p(s.n_words),
        np.log1p(s.word_chars / n),
        (s.n_symbols / chars) ** 0.5,
        (s.n_dup_lines / lines) ** 0.5,
        (s.n_repeat_words / n) ** 0.5,
        (s.n_upper / letters) ** 0.5,
        (count(_DIGITS) / chars) ** 0.5,
        (count(_MARKS) / chars) ** 0.5,
        (count(_ENDS) / chars) ** 0.5,
        (count(b"!") / chars) ** 0.5,
        np.log1p(len(s.lines)),
        np.log1p(s.n_words / lines),
        np.log((distinct + 1) / (n + 1)),
        (count(b"@") / chars) ** 0.5,
        (count(b":/") / chars) ** 0.5,
        np.log1p(max(map(len, s.words), default=0)),
    ]


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>)."""

    def run(batches):
        for batch in pieces(batches):
            x = [features(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() :].reshape(len(column), -1) if len(column) else np.zeros((0, FEATURES))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, sum of x and sum of x x', each task's sums added up on the executors."""

    def run(batches):
        total = {0: np.zeros((FEATURES + 1, FEATURES + 1)), 1: np.zeros((FEATURES + 1, FEATURES + 1))}
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
            x = np.hstack([np.ones((len(x), 1)), x])
            for k in total:
                total[k] += x[y == k].T @ x[y == k]
        k, i = np.repeat([0, 1], total[0].size), np.tile(np.arange(total[0].size), 2)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(np.concatenate([total[0].ravel(), total[1].ravel()]))], ["y", "i", "v"])

    rows = labelled.select("x", "y").mapInArrow(run, "y long, i long, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in (0, 1):
        m = np.zeros((FEATURES + 1) ** 2)
        for r in rows:
            if r["y"] == k:
                m[r["i"]] = r["v"]
        m = m.reshape(FEATURES + 1, FEATURES + 1)
        out[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


@dataclass(frozen=True)
class Discriminant:
    mean: np.ndarray
    scale: np.ndarray
    centre: tuple
    inverse_factor: tuple  # of each class's Cholesky factor
    log_det: tuple
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        if not self.centre:
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        z, density = (x - self.mean) / self.scale, []
        for centre, inverse, log_det in zip(self.centre, self.inverse_factor, self.log_det, strict=True):
            d = (z - centre) @ inverse.T
            density.append(-0.5 * (d * d).sum(axis=1) - 0.5 * log_det)
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


def fit(m: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = 0.2, to_identity: float = 0.02) -> Discriminant:
    n = {k: m[k][0] for k in (0, 1)}
    if min(n.values()) < 2:
        share = np.clip((n[1] / sum(n.values())) if sum(n.values()) else 0.5, 1e-6, 1 - 1e-6)
        return Discriminant(np.zeros(FEATURES), np.ones(FEATURES), (), (), (), float(np.log(share / (1 - share))))
    rows = n[0] + n[1]
    mean = (m[0][1] + m[1][1]) / rows
    spread = np.diag(m[0][2] + m[1][2]) / rows - mean**2
    scale = np.sqrt(np.maximum(spread, 1e-8))
    centre = {k: m[k][1] / n[k] for k in n}
    cov = {k: (m[k][2] / n[k] - np.outer(centre[k], centre[k])) / np.outer(scale, scale) for k in n}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / rows
    factors, dets = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * cov[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / FEATURES, 1e-3) * np.eye(FEATURES)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(mean, scale, tuple((centre[k] - mean) / scale for k in (0, 1)), tuple(factors), tuple(dets), float(np.log(n[1] / n[0])))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned from the rows that aren't held out."""
    scratch = Scratch(docs.sparkSession, "qda")
    table = scratch.table(feature_table(docs), "features")
    fold = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds == held_fold
    known = labels.select(F.col("doc_id").alias("l_id"), F.col(label_col).cast("long").alias("y")).where(~fold(F.col("l_id")) & F.col("y").isin(0, 1))
    model = fit(moments(table.join(known, F.col("doc_id") == F.col("l_id"))))

    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")

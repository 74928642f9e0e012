"""Quality classifier: regularised quadratic discriminant over text statistics.

``fit`` learns from labelled documents: per class the mean and a shrunk
covariance of transformed statistics of the whole text, kept as a Cholesky
factor. ``score`` gives each document the difference of the two Gaussian log
densities, put on a 0-1 scale by a logistic curve fitted to the same rows.

Defined cases: a null or empty text has statistics of zero and is scored like
any other; a null id is scored but never learned from; an id with several labels
counts with the smaller; a repeated document row counts once per row; with no
rows of one class the score of every document is the share of label 1 (0.5
without any label). Columns of the input other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import fold, sample_labels, small_batches, texts

#: Labelled rows that a model is fitted on at most (the stated bound).
SAMPLE_ROWS = 60_000
#: Weight of the pooled covariance, and of its diagonal, in each class covariance.
POOLED, DIAGONAL = 0.2, 0.1
RIDGE = 1e-3
THRESHOLD = 0.3

_KIND = np.zeros(256, dtype=np.intp)  # 0 other, 1 upper, 2 digit, 3 sentence mark, 4 symbol
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[list(b".,;:?'\"-()")] = 3
_KIND[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 4

STATISTICS = ("words", "word_bytes", "upper", "digits", "marks", "symbols", "distinct",
              "stutter", "line_words", "repeated_lines")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text: logs of sizes, square roots of shares."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text, dtype=np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=5)
    lines = [x for x in text.split(b"\n") if x]
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    return [
        np.log1p(n),
        np.log(size / n),
        np.sqrt(kinds[1] / size),
        np.sqrt(kinds[2] / size),
        np.sqrt(kinds[3] / size),
        np.sqrt(kinds[4] / size),
        np.log1p(len(set(words))) / np.log1p(n),
        np.sqrt(same / n),
        np.log1p(n / len(lines)),
        np.sqrt(1 - len(set(lines)) / len(lines)),
    ]


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # lower Cholesky factor of the covariance
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = np.linalg.solve(self.factor, (x - self.mean).T)
        return -0.5 * ((z * z).sum(axis=0) + self.log_det)


@dataclass
class Model:
    """Two class Gaussians and the logistic curve; without classes, ``share`` alone."""
    share: float
    scale: np.ndarray | None = None
    good: Gaussian | None = None
    bad: Gaussian | None = None
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = x / self.scale
        return self.good.log_density(z) - self.bad.log_density(z)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.good is None or not len(x):
            return np.full(len(x), self.share)
        m = squashed(self.margin(x))
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -50, 50)))


def squashed(margin: np.ndarray) -> np.ndarray:
    """Signed log: far tails of the quadratic form keep their order, not their weight."""
    return np.sign(margin) * np.log1p(np.abs(margin))


def fit_curve(margin: np.ndarray, label: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope (never negative) and shift of a logistic curve, by damped Newton steps."""
    x = np.column_stack([margin, np.ones_like(margin)])
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - label) + 1e-2 * np.array([w[0] - 1, w[1]])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step / max(1.0, float(np.abs(step).max()))
    return max(float(w[0]), 0.0), float(w[1])


def fit_model(x: np.ndarray, label: np.ndarray) -> Model:
    """The model of labelled statistics (rows of ``x``)."""
    share = float(label.mean()) if len(label) else 0.5
    if len(label) == 0 or share in (0.0, 1.0):
        return Model(share)
    scale = x.std(axis=0) + 1e-6
    z = x / scale
    parts = {k: z[label == k] for k in (0, 1)}
    cov = {k: (v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) / max(len(v), 1)
           for k, v in parts.items()}
    pooled = sum(cov[k] * len(parts[k]) for k in parts) / len(z)
    made = {}
    for k, v in parts.items():
        # Small classes lean on the pooled covariance more.
        w = min(1.0, POOLED + z.shape[1] / max(len(v), 1))
        c = (1 - w) * cov[k] + w * pooled
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(len(c))
        low = np.linalg.cholesky(c)
        made[k] = Gaussian(v.mean(axis=0), low, 2 * float(np.log(np.diag(low)).sum()))
    model = Model(share, scale, made[1], made[0])
    model.slope, model.shift = fit_curve(squashed(model.margin(x)), label)
    return model


def _statistics_of(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.array([statistics(t) for t in texts(batch.column(at))],
                    dtype=np.float64).reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", folds: int = 5, held: int = 0,
        bound: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``bound`` labelled documents of the folds other than ``held``.

    The sample of ids is at most ``bound`` rows, so it is broadcast to the scan;
    the statistics of those rows (``bound`` x 10 numbers) come to the driver.
    """
    small_batches(docs.sparkSession)
    sample = sample_labels(labels, id_col, label_col, folds, held, bound)
    picked = (docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
              .join(F.broadcast(sample), "__id").select("__label", "__text"))

    def run(batches):
        for b in batches:
            x = _statistics_of(b, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
                 .cast(pa.list_(pa.float64()))], names=["label", "x"])

    got = picked.mapInArrow(run, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    y = got.column("label").to_numpy().astype(np.float64)
    order = np.lexsort(np.column_stack([x, y]).T)  # sums do not depend on task order
    return fit_model(x[order], y[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``score`` (0-1, higher is better) and ``predicted``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = model.score(_statistics_of(b, 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, score double, predicted int")


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, all columns as they are.

    A scan and a filter: nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(_statistics_of(b, at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "quality", folds: int = 5,
                   held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """Fit and score: id, ``held_out``, ``score``, ``predicted``."""
    model = fit(docs, labels, id_col, text_col, label_col, folds, held)
    return score(docs, model, id_col, text_col, threshold).select(
        id_col, F.coalesce(fold(id_col, folds) == held, F.lit(False)).alias("held_out"),
        "score", "predicted")

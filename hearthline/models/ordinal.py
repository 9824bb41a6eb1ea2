"""An ordinal model with shared weights: P(class > k) = sigmoid(w.x - threshold k).

One convex loss, the sum of the K-1 binary cross-entropies, is minimised by Newton steps. A pass adds up gradient and curvature in every
partition and the sums of all partitions by entry, so the driver sees one vector and one matrix of (features + K - 1) whatever the rows.
Rows marked as validation only count towards the loss that stops the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from hearthline.functions import scalars as S
from hearthline.operators.evaluation import K
from hearthline.session import staged


@dataclass
class OrdinalModel:
    """Weights, rising thresholds, and the validation (or training) loss after each step."""

    weights: np.ndarray
    thresholds: np.ndarray
    losses: list[float]
    features: str

    def predict(self, df: DataFrame, name: str = "exceed") -> DataFrame:
        """``name`` is the array P(class > k), which never rises with k; ``predicted_code`` counts those above one half."""
        dot = F.aggregate(
            F.zip_with(vector_to_array(self.features), F.array(*[F.lit(float(w)) for w in self.weights]), lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v
        )
        scored = df.withColumn("_dot", dot)
        heads = [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(t)) - F.col("_dot"))) for t in self.thresholds]
        return scored.withColumn(name, F.array(*heads)).drop("_dot").withColumn("predicted_code", S.rank_class(F.col(name)))


def sums(x: np.ndarray, codes: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, curved: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of a block of rows; thresholds come after the weights."""
    d, heads = x.shape[1], len(thresholds)
    z = (x @ weights)[:, None] - thresholds
    above = codes[:, None] > np.arange(heads)
    loss = float(np.sum(np.logaddexp(0.0, z) - z * above))
    if not curved:
        return loss, np.zeros(0), np.zeros(0)
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    error, curve = p - above, p * (1.0 - p)
    gradient = np.concatenate([x.T @ error.sum(axis=1), -error.sum(axis=0)])
    hessian = np.zeros((d + heads, d + heads))
    hessian[:d, :d] = x.T @ (x * curve.sum(axis=1)[:, None])
    hessian[:d, d:] = -(x.T @ curve)
    hessian[d:, :d] = hessian[:d, d:].T
    hessian[d:, d:] = np.diag(curve.sum(axis=0))
    return loss, gradient, hessian


def _pass(rows: DataFrame, weights: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Sums over all rows: losses of training and validation, their rows, then gradient and curvature."""
    width = len(weights) + len(thresholds)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + width + width * width)
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, len(weights))
            codes, held = batch["code"].to_numpy(), batch["held"].to_numpy(zero_copy_only=False)
            loss, gradient, hessian = sums(x[~held], codes[~held], weights, thresholds)
            total[:4] += loss, sums(x[held], codes[held], weights, thresholds, curved=False)[0], (~held).sum(), held.sum()
            total[4:] += np.concatenate([gradient, hessian.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "total"])

    added = rows.mapInArrow(add_up, "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    out = np.zeros(4 + width + width * width)
    for r in added.collect():  # the entries of one vector and one matrix
        out[r["at"]] = r["total"]
    return out


def fit_ordinal(
    train: DataFrame, code: str = "label", features: str = "features", is_validation: str = "is_validation",
    classes: int = K, steps: int = 25, l2: float = 1.0, tolerance: float = 1e-6,
) -> OrdinalModel:
    """Newton steps until the watched loss (validation rows, else training rows) stops falling; the best step is kept.

    Rows without a code or features do not count. ``l2`` weighs the squared weights, not the thresholds.
    """
    held = F.coalesce(F.col(is_validation), F.lit(False)) if is_validation in train.columns else F.lit(False)
    known = train.where(F.col(code).isNotNull() & F.col(features).isNotNull())
    rows = staged(known.select(vector_to_array(features).alias("x"), F.col(code).cast("double").alias("code"), held.alias("held")), "ordinal")
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit")
    d, heads = first["d"], classes - 1
    weights, thresholds = np.zeros(d), np.linspace(-1.0, 1.0, heads)
    penalty = np.concatenate([np.full(d, l2), np.full(heads, 1e-6)])
    best, losses = (np.inf, weights, thresholds), []
    for _ in range(steps):
        out = _pass(rows, weights, thresholds)
        watched = out[1] / out[3] if out[3] else (out[0] + 0.5 * l2 * float(weights @ weights)) / max(out[2], 1.0)
        losses.append(float(watched))
        if watched >= best[0] * (1 - tolerance):
            if watched < best[0]:
                best = (watched, weights, thresholds)
            break
        best = (watched, weights, thresholds)
        width = d + heads
        at = np.concatenate([weights, np.zeros(heads)])
        gradient, hessian = out[4 : 4 + width] + l2 * at, out[4 + width :].reshape(width, width) + np.diag(penalty)
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        # a long step leaves the region where the curvature holds
        step *= min(1.0, 4.0 / max(float(np.abs(step[d:]).max()), 1e-12))
        weights, thresholds = weights - step[:d], thresholds - step[d:]
    return OrdinalModel(best[1], np.sort(best[2]), losses, features)

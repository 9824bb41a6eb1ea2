"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

Fitted on at most ``fit_rows`` labelled documents, chosen by a hash of the id, so one task can hold their features. With more than one
of ``shards`` the documents are dealt to them by the id and the weights averaged, which is faster and, for few rows, less exact. A shard
runs FTRL-proximal (a learning rate per coordinate, L1 and L2) over its documents in the order of their ids. L1 leaves few weights, which go to the executors with the scoring step. Scores use only the text.

Null and empty texts have no features and score the bias. Without labelled documents every score is 0.5. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthline.llm.common import map_arrow, texts_of
from hearthline.llm.ngrams import LETTER, skip_features
from hearthline.llm.quality_lines import labelled_sample
from hearthline.llm.textblocks import blocks

HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 5) = 0"


@dataclass
class SparseWeights:
    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, dtype=np.float32)
        out[self.index] = self.weight
        return out


class Ftrl:
    """Follow the regularised leader, proximal, on sparse binary rows; coordinate ``size`` is the unpenalised bias."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1 = np.full(size + 1, l1)
        self.l1[-1] = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    where: str | None = None,
    fit_rows: int = 10_000,
    shards: int = 1,
    epochs: int = 5,
    bits: int = 20,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 6.0,
    l2: float = 0.0,
) -> SparseWeights:
    """Fit on labelled documents for which the SQL condition ``where`` on their doc_id holds. Runs a job."""

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch["text"], LETTER):
            owner, bucket = skip_features(block, bits)
            pair = np.unique((owner << bits) | bucket)
            cut = np.searchsorted(pair, np.arange(block.n + 1) << bits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"][block.rows],
                    batch["label"][block.rows],
                    pa.array([(pair[a:b] & ((1 << bits) - 1)).astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ],
                names=["doc_id", "label", "features"],
            )

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        # hashing may send several shards to one partition; each is fitted alone
        for own in sorted({r["shard"] for r in rows}):
            mine = sorted((r for r in rows if r["shard"] == own), key=lambda r: (r["doc_id"], r["features"]))
            model = Ftrl(1 << bits, alpha, beta, l1, l2)
            for _ in range(epochs):
                for r in mine:
                    model.learn(np.frombuffer(r["features"], dtype="<i4"), min(1, max(0, r["label"])))
            w = model.weights(slice(None))
            index = np.flatnonzero(w[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([own]), pa.array([float(w[-1])]), pa.array([index.astype("<i4").tobytes()], pa.binary()), pa.array([w[index].astype("<f4").tobytes()], pa.binary())],
                names=["shard", "bias", "index", "weight"],
            )

    sample = labelled_sample(docs, labels, "toxic", fit_rows, where)
    rows = map_arrow(sample, features, "doc_id long, label int, features binary").withColumn(
        "shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    )
    parts = rows.repartition(shards, "shard").mapInArrow(shard, "shard long, bias double, index binary, weight binary").collect()
    total, bias = np.zeros(1 << bits), 0.0
    for p in sorted(parts, key=lambda p: p["shard"]):
        total[np.frombuffer(p["index"], dtype="<i4")] += np.frombuffer(p["weight"], dtype="<f4")
        bias += p["bias"]
    index = np.flatnonzero(total)
    return SparseWeights(bits, bias / max(1, len(parts)), index.astype(np.int32), (total[index] / max(1, len(parts))).astype(np.float32))


def score_toxicity(docs: DataFrame, model: SparseWeights) -> DataFrame:
    """doc_id and score (0 to 1) of every row. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            for block in blocks(batch["text"], LETTER):
                owner, bucket = skip_features(block, model.bits)
                weighty = weights[bucket] != 0
                pair = np.unique((owner[weighty] << model.bits) | bucket[weighty])
                logit = model.bias + np.bincount(pair >> model.bits, weights=weights[pair & ((1 << model.bits) - 1)], minlength=block.n)
                score = 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][block.rows], pa.array(score)], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")

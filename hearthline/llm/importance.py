"""Quality by importance resampling.

Two generative models of hashed words and neighbouring pairs: the target's, from at most ``fit_rows`` documents labelled good, and the
raw one, from every document. A text's importance is the log ratio of its likelihoods; with Gumbel noise drawn by a hash of its id and
a seed, the ``keep_share`` of documents with the largest sums are a sample without replacement in proportion to importance.

The selection threshold is found exactly by counting keys in ever narrower ranges; only counts reach the driver, and rows that tie at
the threshold are all kept. Null and empty texts have a log ratio of 0. Repeated rows are scored row by row and share their noise.
Without labelled documents the target is uniform over the raw model and the noise alone decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthline.llm.common import staged, texts_of
from hearthline.llm.ngrams import LETTER, word_mark_pairs
from hearthline.llm.quality_lines import labelled_sample
from hearthline.llm.textblocks import blocks


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts; tasks count their own part, and one number per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch["text"], LETTER):
                total += np.bincount(word_mark_pairs(block, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def fit_ratio(docs: DataFrame, labels: DataFrame, fit_rows: int = 16_000, buckets: int = 10_000, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of target and raw probability of each bucket. Runs two jobs."""
    raw = bucket_counts(texts_of(docs), buckets) + smooth
    target = bucket_counts(labelled_sample(docs, labels.where("quality = 1"), "quality", fit_rows), buckets)
    if not target.sum():
        return np.zeros(buckets)
    # the smoothing mass follows the raw model, so a bucket that the target never shows is rare there, not impossible
    target = target + smooth * buckets * raw / raw.sum()
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_importance(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id and log_weight of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"], LETTER):
                owner, bucket = word_mark_pairs(block, len(ratio))
                weight = np.bincount(owner, weights=ratio[bucket], minlength=block.n).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][block.rows], pa.array(weight)], names=["doc_id", "log_weight"])

    return texts_of(docs).mapInArrow(run, "doc_id long, log_weight double")


def kth_largest(df: DataFrame, col: str, k: int, ranges: int = 1024) -> float:
    """The k-th largest value of a staged column, exactly, by counting in narrowing ranges; a few rows a round reach the driver."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    while low < high:
        width = (high - low) / ranges
        place = F.least(F.floor((F.col(col) - low) / width), F.lit(ranges - 1)) if width > 0 else F.when(F.col(col) > low, 1).otherwise(0)
        rows = df.where(F.col(col).between(low, high)).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(col).alias("a"), F.max(col).alias("b")).collect()
        for r in sorted(rows, key=lambda r: -r["place"]):
            if r["n"] >= k:
                low, high = r["a"], r["b"]
                break
            k -= r["n"]
    return high


def resample(docs: DataFrame, ratio: np.ndarray, keep_share: float = 0.85, seed: int = 7) -> DataFrame:
    """doc_id, log_weight, key (with Gumbel noise) and kept of every row. Stages the scores and runs small counting jobs."""
    unit = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    scored = staged(log_importance(docs, ratio).withColumn("key", F.col("log_weight") - F.log(-F.log(unit))), "importance")
    n = scored.count()
    if not n:
        return scored.withColumn("kept", F.lit(False))
    return scored.withColumn("kept", F.col("key") >= F.lit(kth_largest(scored, "key", max(1, math.ceil(keep_share * n)))))

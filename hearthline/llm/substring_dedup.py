"""Substring deduplication by level-wise doubling.

A word is removed if a window of ``size`` words over it also starts earlier: in a smaller doc_id, or in the same document before.

Level one counts windows of half that size. Of these each full window shows only the one with the smallest hash, so a text sends about
a sixth of its windows, and equal full windows always show the same half. Only windows whose shown half is repeated are extended to
twice its length, and their 96-bit hashes compared. Of equal windows a batch sends only its first: the others have an earlier one in the
same batch. So a passage in a third of all rows is one row per batch where starts are compared, and in the joins of level one a key that
adaptive execution splits. Texts are shuffled once, by row, and that exchange serves both text passes.

Null and empty texts have no words. Rows are told apart by their place in the scan: rows that repeat a doc_id count as later the later
they stand, and a null doc_id is later than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearthline.llm.common import texts_of
from hearthline.llm.textblocks import Block, U, blocks, mix, window_hash

SIZE = 20


def sliding(values: np.ndarray, width: int, pick: np.ufunc, fill: int, back: bool) -> np.ndarray:
    """pick (minimum or maximum) over ``width`` neighbours from each place on (or, if ``back``, up to it), by doubling."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        moved = np.full_like(out, fill)
        if back:
            moved[step:] = out[:-step] if step < len(out) else out[:0]
        elif step < len(out):
            moved[:-step] = out[step:]
        out, have = pick(out, moved), have + step
    return out


def shown_halves(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full windows (their first words), the smallest half-size hash in each, and the half-size hash at every word."""
    word, half = block.word_hash(), size // 2
    full = block.windows(size)
    grams = np.full(len(word), np.iinfo(np.uint64).max, dtype=U)
    at = block.windows(half)
    grams[at] = window_hash(word, at, half)
    return full, sliding(grams, size - half + 1, np.minimum, np.iinfo(np.uint64).max, back=False)[full], grams


def level_one(docs: DataFrame, size: int) -> DataFrame:
    """rid, half and how often (1, or 2 for more) the text shows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                full, low, grams = shown_halves(block, size)
                least = np.zeros(len(grams), dtype=U)
                least[full] = low
                # shown: the smallest of some full window around it
                chosen = np.flatnonzero((sliding(least, size - size // 2 + 1, np.maximum, 0, back=True) == grams) & (grams != np.iinfo(np.uint64).max))
                owner = block.owner()[chosen]
                order = np.lexsort((grams[chosen], owner))
                owner, value = owner[order], grams[chosen][order]
                new = np.ones(len(value), dtype=bool)
                new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(value)))
                rid = batch["rid"].to_numpy()[block.rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[owner[first]]), pa.array(value[first].view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))],
                    names=["rid", "half", "times"],
                )

    return docs.select("rid", "text").mapInArrow(run, "rid long, half long, times int")


def extended(texts: DataFrame, size: int) -> DataFrame:
    """Full windows whose shown half is among the text's repeated ``halves``, with a 96-bit hash (h1, h2).

    Of equal windows of a batch only the first is sent (rid, doc_id, start); the others are later for certain, and go as one row
    per text that lists their starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, names = batch["rid"].to_numpy(), batch["doc_id"]
            none, doc = np.asarray(names.is_null()), np.asarray(names.fill_null(0))
            parts = []
            for block in blocks(batch["text"]):
                halves = batch["halves"][block.rows]
                flat = np.asarray(halves.flatten()).view(np.uint64)
                of = np.repeat(np.arange(block.n), np.asarray(pa.compute.list_value_length(halves)))
                full, low, _ = shown_halves(block, size)
                owner = block.owner()[full]
                hit = np.isin(mix(low + mix(owner.astype(U) + U(1))), mix(flat + mix(of.astype(U) + U(1))))
                full, owner = full[hit], owner[hit]
                a, b = window_hash(block.word_hash(0), full, size, 0), window_hash(block.word_hash(1), full, size, 1)
                parts.append((a, b >> U(32), owner + block.rows.start, full - block.first[owner]))
            h1, h2, row, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            rank = np.empty(len(rid), dtype=np.int64)
            rank[np.lexsort((rid, doc, none))] = np.arange(len(rid))
            order = np.lexsort(((rank[row] << 32) | start, h2, h1))
            same = np.zeros(len(order), dtype=bool)
            same[1:] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
            # back in the order of the texts, where neighbouring rows share their ids and so take little room
            first = np.ones(len(order), dtype=bool)
            first[order[same]] = False
            del order, same
            later_row, later_start = row[~first], start[~first]
            by_row = np.argsort(later_row, kind="stable")
            later_row, later_start = later_row[by_row], later_start[by_row]
            own = np.flatnonzero(np.r_[True, later_row[1:] != later_row[:-1]]) if len(later_row) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(own, len(later_row)).astype(np.int32)), pa.array(later_start.astype(np.int32)))
            n, m = int(first.sum()), len(own)
            holder = later_row[own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rid[row[first]], rid[holder]])),
                    names.take(pa.array(np.concatenate([row[first], holder]))),
                    pa.concat_arrays([pa.array(start[first].astype(np.int32)), pa.nulls(m, pa.int32())]),
                    pa.array(np.concatenate([h1[first].view(np.int64), rid[holder]])),
                    pa.array(np.concatenate([h2[first].astype(np.int64), np.full(m, -1, dtype=np.int64)])),
                    pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), lists.cast(pa.list_(pa.int32()))]),
                ],
                names=["rid", "doc_id", "start", "h1", "h2", "later"],
            )

    return texts.select("rid", "doc_id", "text", "halves").mapInArrow(run, "rid long, doc_id long, start int, h1 long, h2 long, later array<int>")


def removed(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of each row, given the starts of its later windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                starts = batch["starts"][block.rows].fill_null([])
                flat = np.asarray(starts.flatten(), dtype=np.int64)
                of = np.repeat(np.arange(block.n), np.asarray(pa.compute.list_value_length(starts)))
                edge = np.zeros(len(block.start) + 1, dtype=np.int64)
                np.add.at(edge, block.first[of] + flat, 1)
                np.add.at(edge, block.first[of] + flat + size, -1)
                gone = np.cumsum(edge[:-1]) > 0
                raw = block.buf.tobytes()
                kept = []
                for d in range(block.n):
                    own = slice(block.first[d], block.first[d + 1])
                    kept.append(b" ".join([raw[s:e] for s, e, g in zip(block.start[own].tolist(), block.end[own].tolist(), gone[own].tolist(), strict=True) if not g]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"][block.rows],
                        pa.array(block.counts()),
                        pa.array(block.per_text_words(gone)),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                        pa.array([k.decode() for k in kept]),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return texts.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def substring_dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept (words joined by one space)."""
    if size < 2 or size % 2:
        raise ValueError("the window size must be even, as its last level doubles half of it")
    rows = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("rid", F.monotonically_increasing_id())
    shown = level_one(rows, size)
    repeated = shown.groupBy("half").agg(F.sum("times").alias("n")).where("n > 1").select("half")
    halves = shown.join(repeated, "half").groupBy("rid").agg(F.collect_list("half").alias("halves"))
    full = extended(rows.join(halves, "rid"), size)
    # a window is met once per batch at most, so a group is as large as the number of batches, not of its copies
    order = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "rid", "start")
    starts = (
        full.withColumn("nth", F.row_number().over(order))
        .where("nth > 1 OR later IS NOT NULL")
        .groupBy("rid")
        .agg(F.collect_list("start").alias("one"), F.flatten(F.collect_list("later")).alias("many"))
        .select("rid", F.concat("one", "many").alias("starts"))
    )
    return removed(rows.join(starts, "rid", "left"), size)

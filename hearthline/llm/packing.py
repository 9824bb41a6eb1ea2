"""Packing by Karmarkar-Karp multiway differencing.

A document is its ids and a closing id. Whole windows of 1,024 ids are cut from its front and stand alone; the rest is cut into
pieces of at most ``max_piece`` ids. Pieces of about ``group_docs`` consecutive documents of a task are dealt to windows by multiway
differencing: the two partial partitions with the largest imbalance are merged, the fullest parts of one with the emptiest of the
other, until one partition is left. The number of windows is the least that could hold the pieces, and one more each time that a
window comes out above its capacity.

One pass over the scan and no shuffle: every scan task packs its own documents, and the last, smaller group of a task wastes less
than one window. Sequence ids are the number of the task's partition and a count, so a repeated task gives the same ids.

A null text is empty: one piece with the closing id. Null or repeated doc_ids are packed row by row.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hearthline.llm.common import texts_of
from hearthline.llm.tokens import encoder, vocabulary_path

CAPACITY = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0 to k-1) of each item in a partition into k parts with near-equal sums."""
    parent = np.arange(len(sizes))
    # a partial partition: sums above its smallest (falling) and an item that names each part; fewer than k parts means empty ones
    heap = [(-int(s), i, np.array([s], dtype=np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:
            # the fullest parts of a meet empty or the emptiest parts of b
            parent[y[len(b) - over :][::-1]] = x[len(a) - over :]
            a = np.concatenate([a[: len(a) - over], a[len(a) - over :] + b[len(b) - over :][::-1], b[: len(b) - over]])
            x = np.concatenate([x, y[: len(y) - over]])
        else:
            a, x = np.concatenate([a, b]), np.concatenate([x, y])
        order = np.argsort(-a, kind="stable")
        a, x = a[order], x[order]
        if len(a) == k:
            a = a - a[-1]
        heapq.heappush(heap, (-int(a[0]), tie, a, x))
        tie += 1
    root = parent
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    return np.unique(root, return_inverse=True)[1] if len(sizes) else root


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece; the window count rises until no window is above its capacity."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part = differencing(sizes, k)
        if np.bincount(part, weights=sizes).max() <= capacity:
            return part
        k += 1


def pack_group(ids: list[np.ndarray], doc_ids: list, base: int, capacity: int, max_piece: int) -> tuple[pa.RecordBatch, int]:
    """Pieces of a group of documents; sequences count from ``base``. Returns how many were made as well."""
    length = np.array([len(x) for x in ids], dtype=np.int64)
    whole, rest = length // capacity, length % capacity
    cuts = -(-rest // max_piece)
    doc = np.concatenate([np.repeat(np.arange(len(ids)), whole), np.repeat(np.arange(len(ids)), cuts)])
    nth_whole = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    nth_cut = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    of = doc[len(nth_whole) :]
    # the cuts of one rest are of nearly equal size
    low = rest[of] * nth_cut // np.maximum(cuts[of], 1)
    high = rest[of] * (nth_cut + 1) // np.maximum(cuts[of], 1)
    start = np.concatenate([nth_whole * capacity, whole[of] * capacity + low])
    size = np.concatenate([np.full(len(nth_whole), capacity), high - low])
    part = windows(size[len(nth_whole) :], capacity)
    sequence = np.concatenate([np.arange(len(nth_whole)), len(nth_whole) + part]).astype(np.int64)
    order = np.argsort(sequence, kind="stable")
    run = np.cumsum(size[order]) - size[order]
    first = np.searchsorted(sequence[order], sequence[order], side="left")
    offset = np.empty_like(size)
    offset[order] = run - run[first]
    crc = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n in zip(doc, start, size, strict=True)]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([doc_ids[d] for d in doc], pa.int64()),
            *(pa.array(v, pa.int64()) for v in (start, size, crc, length[doc], base + sequence, offset)),
        ],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )
    return batch, int(sequence.max(initial=-1)) + 1


def pack(
    docs: DataFrame, vocabulary: str | None = None, closing_id: int = 0, capacity: int = CAPACITY, max_piece: int = 256, group_docs: int = 512
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = (words := encoder(path)).ids
        base = TaskContext.get().partitionId() << 40
        end = np.array([closing_id], dtype="<u4")
        ids: list[np.ndarray] = []
        names: list = []
        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids.append(np.concatenate([encode(text.as_py()), end]))
                names.append(name)
                if len(ids) >= group_docs:
                    out, made = pack_group(ids, names, base, capacity, max_piece)
                    base += made
                    ids, names = [], []
                    yield out
        if ids:
            yield pack_group(ids, names, base, capacity, max_piece)[0]
        words.clear()
        pa.default_memory_pool().release_unused()

    return texts_of(docs).mapInArrow(run, PIECES)

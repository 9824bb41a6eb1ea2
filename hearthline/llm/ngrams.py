"""Hashed n-grams of many texts as flat arrays."""

from __future__ import annotations

import numpy as np

from hearthline.llm.textblocks import U, Block, byte_table, mix, window_hash, word_spans

LETTER = byte_table(r"[0-9A-Za-z\x80-\xFF]")
MARKS = byte_table(r"[^0-9A-Za-z\x80-\xFF\x20\x09-\x0D\x00]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(block: Block) -> np.ndarray:
    """Word hashes with A-Z as a-z."""
    return block.word_hash(0, LOWER)


def skip_features(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner text and bucket of each word, pair of neighbours, and pair with one word between them."""
    word, owner = lowered(block), block.owner()
    two, three = block.windows(2), block.windows(3)
    skip = mix(word[three] * U(3) + mix(word[three + 2] + U(7)))
    value = np.concatenate([word, window_hash(word, two, 2), skip])
    return np.concatenate([owner, owner[two], owner[three]]), (value >> U(64 - bits)).astype(np.int64)


def word_mark_pairs(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner text and bucket of each run of letters or of marks, and of each pair of neighbouring runs."""
    a, b = word_spans(block.buf, block.off, LETTER), word_spans(block.buf, block.off, MARKS)
    start = np.concatenate([a[0], b[0]])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.concatenate([a[1], b[1]])[order]
    runs = Block(block.rows, block.buf, block.off, start, end, np.searchsorted(start, block.off, side="left"))
    word, owner, two = lowered(runs), runs.owner(), runs.windows(2)
    value = np.concatenate([word, window_hash(word, two, 2)])
    return np.concatenate([owner, owner[two]]), (value % U(buckets)).astype(np.int64)

"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

An Arrow batch is cut into blocks of whole texts of about half a megabyte, so memory follows the block (or the one longest
text), not the batch. Word and window hashes are differences of prefix sums of a polynomial modulo 2**64, mixed at the end. A hash
does not depend on where its span stands, so a long text is hashed in runs of words, and the only tables kept are of ``STEP`` powers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
#: powers kept per multiplier, and bytes hashed at a time
STEP = 1 << 16
U = np.uint64
#: odd multipliers of the byte polynomial, and of the word polynomial, for two independent hashes
BYTE_MUL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD_MUL = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def byte_table(pattern: str) -> np.ndarray:
    """True for each byte that a regular expression over single Latin-1 characters matches."""
    import re

    return np.array([re.fullmatch(pattern, chr(b)) is not None for b in range(256)])


#: words between ASCII white space
SPACED = byte_table(r"[^\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


_tables: dict[int, np.ndarray] = {}


def powers(mul: int) -> np.ndarray:
    """The first ``STEP`` powers of a multiplier, modulo 2**64."""
    if mul not in _tables:
        t = np.full(STEP, mul, dtype=U)
        t[0] = 1
        _tables[mul] = np.multiply.accumulate(t)
    return _tables[mul]


def prefix(values: np.ndarray, mul: int) -> np.ndarray:
    """Prefix sums of values times powers; entry i covers the first i values."""
    up = powers(mul)
    out = np.zeros(len(values) + 1, dtype=U)
    for at in range(0, len(values), STEP):
        part = values[at : at + STEP].astype(U)
        part *= up[: len(part)]
        if at:
            part *= U(pow(mul, at, 1 << 64))
        np.cumsum(part, out=part)
        part += out[at]
        out[at + 1 : at + 1 + len(part)] = part
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, mul: int) -> np.ndarray:
    """Hashes of the spans [start, end) of the values under the prefix sums."""
    inverse = pow(mul, -1, 1 << 64)
    down = powers(inverse)
    out = sums[end] - sums[start]
    out *= down[start % STEP]
    if len(sums) > STEP:
        leap = np.array([pow(inverse, i * STEP, 1 << 64) for i in range(len(sums) // STEP + 1)], dtype=U)
        out *= leap[start // STEP]
    return mix(out)


def words_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, mul: int, table: np.ndarray | None = None) -> np.ndarray:
    """Hashes of words (ordered, disjoint spans of bytes), some ``STEP`` bytes at a time; ``table`` maps bytes first."""
    out = np.empty(len(start), dtype=U)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + STEP, side="right")))
        low, high = int(start[at]), int(end[to - 1])
        part = buf[low:high] if table is None else table[buf[low:high]]
        sums = prefix(part.astype(np.uint16) + np.uint16(1), mul)
        out[at:to] = spans_hash(sums, start[at:to] - low, end[at:to] - low, mul)
        at = to
    return out


@dataclass
class Block:
    """Whole texts: their bytes, text offsets, word starts and ends, and the first word of each text."""

    rows: slice
    buf: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(self.n), self.counts())

    def word_hash(self, which: int = 0, table: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words; ``table`` maps bytes first."""
        return words_hash(self.buf, self.start, self.end, BYTE_MUL[which], table)

    def windows(self, k: int) -> np.ndarray:
        """Indices of words that begin k consecutive words of one text."""
        left = np.repeat(self.first[1:], self.counts()) - np.arange(len(self.start))
        return np.flatnonzero(left >= k)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each text of a value given per byte."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.off[1:]] - sums[self.off[:-1]]

    def per_text_words(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each text of a value given per word."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]


def window_hash(word: np.ndarray, at: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of k consecutive words beginning at the given words."""
    return spans_hash(prefix(word, WORD_MUL[which]), at, at + k, WORD_MUL[which])


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = table[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(buf):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end


def blocks(texts: pa.Array, table: np.ndarray = SPACED, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts, in order, covering every row; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        own = off[at : to + 1] - off[at]
        buf = raw[off[at] : off[to]]
        start, end = word_spans(buf, own, table)
        yield Block(slice(at, to), buf, own, start, end, np.searchsorted(start, own, side="left"))
        at = to


def repeats_within(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values of owners: whether the value occurs again in the same owner, and whether it has occurred before."""
    key = mix(value + mix(owner.astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    later = np.zeros(len(key), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later

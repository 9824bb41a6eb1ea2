"""Personal data: rule spans, and what a character-level bidirectional LSTM with CRF transitions adds to them.

Every span of the four kinds holds a digit or an at sign, so a text without either has none. In the others, tiles of 32 characters that
hold one, and their neighbours, are read in windows of 64 characters around the tile, so that two windows cover a character. Their
emissions are averaged, and one Viterbi decoding with the CRF's transitions runs over each run of neighbouring tiles, whatever windows it
crosses; runs of more than 64 tiles are decoded in pieces that overlap by eight tiles, of which the outer four on each side are dropped. A span of the tagger that overlaps
no rule span and passes the checks of its kind is added; rule spans always stay.

The tagger is trained on at most ``fit_windows`` windows of the documents, chosen by a hash, with rule spans as labels. Without any
rule span in them there is nothing to learn and the rules alone decide. Null texts are empty; repeated rows are judged alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthline.llm.chain_crf import viterbi
from hearthline.llm.common import map_arrow, texts_of
from hearthline.llm.pii_rules import KINDS, Span, base_spans, plausible
from hearthline.llm.tagger import Tagger, symbols
from hearthline.llm.textblocks import blocks, byte_table

TILE, WINDOW = 32, 64
EDGE = (WINDOW - TILE) // 2
PIECE, MARGIN = 64, 4  # tiles
TRIGGER = byte_table(r"[0-9@]")


def coded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def tiles(codes: np.ndarray) -> np.ndarray:
    """Numbers of the tiles with a digit or an at sign, and of their neighbours."""
    at = np.unique(np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64)) // TILE)
    near = np.unique(np.concatenate([at - 1, at, at + 1]))
    return near[(near >= 0) & (near * TILE < len(codes))]


def cut_windows(values: np.ndarray, tile: np.ndarray, pad: int = 0) -> np.ndarray:
    """The window around each tile, padded at the ends of the text."""
    wide = np.concatenate([np.full(EDGE, pad, values.dtype), values, np.full(WINDOW, pad, values.dtype)])
    return wide[tile[:, None] * TILE + np.arange(WINDOW)]


def windows_of(codes: np.ndarray, first: int, end: int) -> np.ndarray:
    """The windows of neighbouring tiles, from the part of the text around them alone."""
    left = min(first, 1)
    part = codes[(first - left) * TILE : end * TILE + WINDOW]
    return cut_windows(symbols(part), np.arange(left, left + end - first))


def tags_of(spans: list[Span], n: int) -> np.ndarray:
    tags = np.zeros(n, dtype=np.int8)
    for kind, start, end in reversed(spans):
        k = KINDS.index(kind)
        tags[start:end] = 2 + 2 * k
        tags[start] = 1 + 2 * k
    return tags


def spans_of(tags: np.ndarray, text: str) -> list[Span]:
    """Spans of a text's tags, without white space at their ends."""
    out: list[Span] = []
    inside = np.flatnonzero(tags)
    at = 0
    while at < len(inside):
        kind = (tags[inside[at]] - 1) // 2
        to = at + 1
        while to < len(inside) and inside[to] == inside[to - 1] + 1 and tags[inside[to]] == 2 + 2 * kind:
            to += 1
        start, end = int(inside[at]), int(inside[to - 1]) + 1
        piece = text[start:end]
        start += len(piece) - len(piece.lstrip())
        end -= len(piece) - len(piece.rstrip())
        if start < end:
            out.append((KINDS[kind], start, end))
        at = to
    return out


def fit_tagger(docs: DataFrame, fit_windows: int = 2000, **settings) -> Tagger | None:
    """Train on at most ``fit_windows`` windows, half of them with a rule span where there are enough. Runs a job."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch["text"]):
            for row in np.flatnonzero(block.per_text(TRIGGER[block.buf])):
                text = batch["text"][int(block.rows.start + row)].as_py()
                codes = coded(text)
                tile = tiles(codes)
                x, y = cut_windows(symbols(codes), tile), cut_windows(tags_of(base_spans(text), len(codes)), tile)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.tobytes() for w in x], pa.binary()), pa.array([w.tobytes() for w in y], pa.binary()), pa.array((y > 0).any(axis=1))],
                    names=["x", "y", "found"],
                )

    windows = map_arrow(texts_of(docs), step, "x binary, y binary, found boolean")
    order = F.xxhash64("x", "y")
    half = fit_windows // 2
    rows = [r for found in (True, False) for r in windows.where(F.col("found") == found).orderBy(order, "x", "y").limit(half).collect()]
    if not any(r["found"] for r in rows):
        return None
    x = np.stack([np.frombuffer(r["x"], dtype=np.int16) for r in rows])
    y = np.stack([np.frombuffer(r["y"], dtype=np.int8) for r in rows])
    return Tagger().fit(x, y, **settings).single()


def pieces(tile: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first, end, first kept, kept end) of the stretches of tiles to decode: whole runs, or overlapping parts of long ones."""
    if not len(tile):
        return []
    ends = np.flatnonzero(np.diff(tile) > 1) + 1
    out = []
    for run in np.split(tile, ends):
        low, high = int(run[0]), int(run[-1]) + 1
        for a in range(low, high, PIECE):
            b = min(a + PIECE, high)
            out.append((max(low, a - MARGIN), min(high, b + MARGIN), a, b))
    return out


def joined_emissions(emit: np.ndarray) -> np.ndarray:
    """Emissions per character of neighbouring tiles from those of their windows (tiles, WINDOW, tags): the mean over the windows that cover it."""
    total = np.zeros((len(emit) + 1, TILE, emit.shape[2]), dtype=emit.dtype)
    total[:-1] += emit[:, :TILE]
    total[1:] += emit[:, TILE:]
    total[1:-1] /= 2
    return total.reshape(-1, emit.shape[2])[EDGE : EDGE + TILE * len(emit)]


def global_tags(codes: list[np.ndarray], tagger: Tagger, rows: int = 2048) -> list[np.ndarray]:
    """Tags of the characters of each text; about ``rows`` windows are in memory at a time."""
    tags = [np.zeros(len(c) + WINDOW, dtype=np.int8) for c in codes]
    # longest first, in characters of the text: the decoder asks for falling lengths
    todo = sorted(((min(p[1] * TILE, len(c)) - p[0] * TILE, d, p) for d, c in enumerate(codes) for p in pieces(tiles(c))), key=lambda t: -t[0])
    at = 0
    while at < len(todo):
        to = at + 1
        while to < len(todo) and (to + 1 - at) * todo[at][0] <= rows * TILE:
            to += 1
        own, at = todo[at:to], to
        cut = [windows_of(codes[d], p[0], p[1]) for _, d, p in own]
        emit = np.split(tagger.emissions(np.concatenate(cut)), np.cumsum([len(c) for c in cut])[:-1])
        size = np.array([n for n, _, _ in own])
        wide = np.zeros((len(own), int(size[0]), emit[0].shape[2]), dtype=emit[0].dtype)
        for row, (e, n) in enumerate(zip(emit, size, strict=True)):
            wide[row, :n] = joined_emissions(e)[:n]
        best = viterbi(wide, size, tagger.p["trans"])
        for row, (_, d, p) in enumerate(own):
            start, end = p[2] * TILE, min(p[3] * TILE, len(codes[d]))
            tags[d][start:end] = best[row, start - p[0] * TILE : end - p[0] * TILE]
    return tags


def all_spans(texts: list[str], tagger: Tagger | None, rows: int = 2048) -> list[tuple[list[Span], list[Span]]]:
    """Rule spans, and all spans, of each text."""
    base = [base_spans(t) for t in texts]
    if tagger is None or not texts:
        return [(b, b) for b in base]
    tags = global_tags([coded(t) for t in texts], tagger, rows)
    out = []
    for text, found, t in zip(texts, base, tags, strict=True):
        added = [
            s for s in spans_of(t[: len(text)], text) if not any(s[1] < b[2] and b[1] < s[2] for b in found) and plausible(s[0], text[s[1] : s[2]])
        ]
        out.append((found, sorted(found + added, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found_in(batch_texts: pa.Array, tagger: Tagger | None) -> Iterator[tuple[slice, np.ndarray, list[tuple[list[Span], list[Span]]]]]:
    """For each block: its rows, the rows (in the batch) of texts that may hold a span, and their spans."""
    for block in blocks(batch_texts):
        rows = np.flatnonzero(block.per_text(TRIGGER[block.buf])) + block.rows.start
        yield block.rows, rows, all_spans([batch_texts[int(r)].as_py() for r in rows], tagger)


def find_personal(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """One row per input row: doc_id, the number of rule spans of each kind, base_sha256, spans. One pass, no shuffle."""
    names = [f"n_{k}" for k in KINDS]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, rows, found in found_in(batch["text"], tagger):
            n = own.stop - own.start
            counts = np.zeros((len(KINDS), n), dtype=np.int64)
            digest, spans = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
            for row, (base, every) in zip(rows - own.start, found, strict=True):
                for kind, _, _ in base:
                    counts[KINDS.index(kind), row] += 1
                digest[row] = hashlib.sha256(written(base).encode()).hexdigest()
                spans[row] = written(every)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][own], *map(pa.array, counts), pa.array(digest), pa.array(spans)], names=["doc_id", *names, "base_sha256", "spans"]
            )

    return map_arrow(texts_of(docs), step, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, as its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """The input rows, all columns, with spans in their text replaced."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch[text_col].to_pylist()
        for _, rows, found in found_in(batch[text_col], tagger):
            for row, (_, every) in zip(rows, found, strict=True):
                texts[row] = redacted(texts[row], every)
        return batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, batch[text_col].type))

    return map_arrow(docs, step, docs.schema)

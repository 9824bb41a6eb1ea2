"""Quality rules with line sequence labelling.

Two plain rules come first: texts of fewer than 50 words, and texts half of whose words lie in repeated three-word windows, fail.
Of the others, the lines that hold a word are labelled content or boilerplate by Viterbi decoding of a linear-chain conditional
random field over binned line features; a text is kept if the lines labelled content hold at least ``min_share`` of the bytes.

The field is fitted on a bounded sample of labelled documents (``fit_rows``); each line inherits the label of its document.
Without any labelled document no line is boilerplate and the two rules alone decide.

Null and empty texts have no words and fail the first rule. Repeated rows are judged alike, one output row per input row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthline.llm.chain_crf import by_length, forward_backward, viterbi
from hearthline.llm.common import map_arrow, texts_of
from hearthline.llm.textblocks import BYTE_MUL, SPACED, Block, blocks, byte_table, repeats_within, window_hash, word_spans, words_hash

LINE = byte_table(r"[^\n]")
SYMBOL = byte_table(r"[#*$%&|<>]")
MARK = byte_table(r"[#*$%&|<>!~^]")
UPPER = byte_table(r"[A-Z]")
STOP = byte_table(r"[.!?;:]")
#: upper edges of the bins of each line feature
EDGES = {
    "words": (1.5, 3.5, 7.5, 15.5, 31.5),
    "marks_per_word": (0.01, 0.05, 0.2, 0.6, 1.5),
    "upper_share": (0.02, 0.1, 0.4),
    "seen_before": (0.5,),
    "repeated_share": (0.2, 0.5),
    "ends_sentence": (0.5,),
    "bytes_per_word": (3.5, 5.5, 7.5, 10.5),
}
WIDTH = [len(e) + 1 for e in EDGES.values()]
BASE = np.concatenate([[0], np.cumsum(WIDTH)[:-1]])
MIN_WORDS = 50


@dataclass
class LineModel:
    """Weights of the binned features per label (content 0, boilerplate 1) and of the transitions."""

    emit: np.ndarray
    trans: np.ndarray

    @classmethod
    def empty(cls) -> LineModel:
        return cls(np.zeros((sum(WIDTH), 2)), np.zeros((2, 2)))


@dataclass
class Lines:
    """Lines with a word: their text, features (indices of the active bins) and bytes."""

    owner: np.ndarray
    bins: np.ndarray
    size: np.ndarray
    seen: np.ndarray


def repeated_words(block: Block) -> np.ndarray:
    """Words in three-word windows that occur twice or more in their text."""
    at = block.windows(3)
    covered = np.zeros(len(block.start), dtype=bool)
    if len(at):
        twice, _ = repeats_within(block.owner()[at], window_hash(block.word_hash(), at, 3))
        for k in range(3):
            covered[at[twice] + k] = True
    return covered


def lines_of(block: Block, repeated: np.ndarray) -> Lines:
    start, end = word_spans(block.buf, block.off, LINE)
    first, last = np.searchsorted(block.start, start), np.searchsorted(block.start, end)
    worded = last > first
    start, end, first, last = start[worded], end[worded], first[worded], last[worded]
    owner = np.searchsorted(block.off, start, side="right") - 1
    size = end - start
    _, seen = repeats_within(owner, words_hash(block.buf, start, end, BYTE_MUL[0]))
    words = last - first

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[end] - sums[start]

    again = np.concatenate([[0], np.cumsum(repeated)])
    last_byte = block.buf[block.end[last - 1] - 1] if len(last) else np.zeros(0, np.uint8)
    values = {
        "words": words,
        "marks_per_word": inside(MARK[block.buf]) / np.maximum(words, 1),
        "upper_share": inside(UPPER[block.buf]) / np.maximum(size, 1),
        "seen_before": seen,
        "repeated_share": (again[last] - again[first]) / np.maximum(words, 1),
        "ends_sentence": STOP[last_byte],
        "bytes_per_word": size / np.maximum(words, 1),
    }
    bins = np.stack([b + np.digitize(values[k].astype(float), e) for b, (k, e) in zip(BASE, EDGES.items(), strict=True)], axis=1)
    return Lines(owner, bins.astype(np.int16), size, seen)


def padded(model: LineModel, bins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions of sequences that stand one after the other, sorted by falling length; the order; the cell of each line."""
    order, _ = by_length(lengths)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    steps = int(lengths.max(initial=0))
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    cell = np.repeat(place, lengths) * steps + step
    emit = np.zeros((len(lengths) * steps, 2))
    emit[cell] = model.emit[bins].sum(axis=1)
    return emit.reshape(len(lengths), steps, 2), order, cell


def groups_by_length(lengths: np.ndarray, cells: int = 200_000) -> list[np.ndarray]:
    """Sequences of similar length together, so that padding stays small whatever the longest is."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    out, at = [], 0
    while at < len(order):
        to = at + 1
        while to < len(order) and lengths[order[to]] * (to + 1 - at) <= max(cells, lengths[order[at]]) and lengths[order[to]] <= 2 * lengths[order[at]] + 8:
            to += 1
        out.append(order[at:to])
        at = to
    return out


def label_lines(model: LineModel, bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Viterbi labels of lines of texts that stand one after the other."""
    labels = np.zeros(len(bins), dtype=np.int8)
    first = np.cumsum(lengths) - lengths
    for group in groups_by_length(lengths):
        at = np.concatenate([np.arange(first[g], first[g] + lengths[g]) for g in group])
        emit, order, cell = padded(model, bins[at], lengths[group])
        labels[at] = viterbi(emit, lengths[group][order], model.trans).reshape(-1)[cell]
    return labels


def fit_field(bins: list[np.ndarray], labels: np.ndarray, rounds: int = 60, rate: float = 0.2, ridge: float = 1e-3, balanced: bool = False) -> LineModel:
    """Maximum likelihood by Adam; every line of a sequence has the sequence's label; ``balanced`` gives both labels the same weight in sum."""
    model = LineModel.empty()
    lengths = np.array([len(b) for b in bins], dtype=np.int64)
    keep = lengths > 0
    bins, labels, lengths = [b for b, k in zip(bins, keep, strict=True) if k], labels[keep], lengths[keep]
    if len(set(labels.tolist())) < 2:
        return model
    share = np.array([lengths[labels == y].sum() for y in (0, 1)], dtype=float)
    weight = share.sum() / (2 * share) if balanced else np.ones(2)
    groups = [(y, np.flatnonzero(labels == y)[g]) for y in (0, 1) for g in groups_by_length(lengths[labels == y])]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.emit, model.trans)]
    for step in range(1, rounds + 1):
        grad = [-ridge * model.emit * lengths.sum(), -ridge * model.trans * lengths.sum()]
        for y, group in groups:
            own, size = np.concatenate([bins[g] for g in group]), lengths[group]
            emit, order, cell = padded(model, own, size)
            _, marginal, pairs = forward_backward(emit, size[order], model.trans)
            diff = -marginal.reshape(-1, 2)[cell] * weight[y]
            diff[:, y] += weight[y]
            for label in (0, 1):
                grad[0][:, label] += np.bincount(own.ravel(), weights=np.repeat(diff[:, label], own.shape[1]), minlength=len(model.emit))
            grad[1] -= pairs * weight[y]
            grad[1][y, y] += (size - 1).sum() * weight[y]
        for p, g, m in zip((model.emit, model.trans), grad, moments, strict=True):
            g = g / lengths.sum()
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int, where: str | None = None) -> DataFrame:
    """At most ``fit_rows`` labelled documents, chosen by a hash of the id; the broadcast side has at most that many rows."""
    chosen = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .where(where or "true")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(label)), "doc_id")
        .limit(fit_rows)
    )
    return texts_of(docs).join(F.broadcast(chosen), "doc_id")


def fit_lines(docs: DataFrame, labels: DataFrame, fit_rows: int = 3000) -> LineModel:
    """Fit the field on lines of at most ``fit_rows`` labelled documents (quality 0: boilerplate). Runs a job."""

    def step(batch: pa.RecordBatch):
        for block in blocks(batch["text"]):
            lines = lines_of(block, repeated_words(block))
            cut = np.searchsorted(lines.owner, np.arange(block.n + 1))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"][block.rows],
                    "label": batch["label"][block.rows],
                    "bins": [lines.bins[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                },
                schema=pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bins", pa.binary())]),
            )

    rows = map_arrow(labelled_sample(docs, labels, "quality", fit_rows), step, "doc_id long, label int, bins binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["bins"])))
    bins = [np.frombuffer(r["bins"], dtype=np.int16).reshape(-1, len(WIDTH)) for r in rows]
    return fit_field(bins, np.array([1 - min(1, max(0, r["label"])) for r in rows], dtype=np.int64))


def judged(block: Block, model: LineModel, min_share: float) -> dict[str, np.ndarray]:
    repeated = repeated_words(block)
    lines = lines_of(block, repeated)
    spaced = SPACED[block.buf]
    n_words = block.counts()
    n_repeat = block.per_text_words(repeated)
    lengths = np.bincount(lines.owner, minlength=block.n)
    content = lines.size * (label_lines(model, lines.bins, lengths) == 0)
    total = np.bincount(lines.owner, weights=lines.size, minlength=block.n)
    share = np.bincount(lines.owner, weights=content, minlength=block.n) / np.maximum(total, 1)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words,
        "word_chars": block.per_text(spaced & ((block.buf & 0xC0) != 0x80)),
        "n_symbols": block.per_text(SYMBOL[block.buf]),
        "n_dup_lines": np.bincount(lines.owner, weights=lines.seen, minlength=block.n).astype(np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "content_share": share,
        "kept": ~failed & (share >= min_share),
    }


def quality_rules(docs: DataFrame, model: LineModel, min_share: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, content_share, kept. One pass, no shuffle."""

    def step(batch: pa.RecordBatch):
        for block in blocks(batch["text"]):
            found = judged(block, model, min_share)
            yield pa.RecordBatch.from_arrays([batch["doc_id"][block.rows], *map(pa.array, found.values())], ["doc_id", *found])

    return map_arrow(
        texts_of(docs),
        step,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, content_share double, kept boolean",
    )


def keep_good(docs: DataFrame, model: LineModel, min_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The input rows, all columns, whose text is kept."""

    def step(batch: pa.RecordBatch):
        for block in blocks(batch[text_col]):
            yield batch.slice(block.rows.start, block.n).filter(pa.array(judged(block, model, min_share)["kept"]))

    return map_arrow(docs, step, docs.schema)

"""Collocations of neighbouring words, counted in quotient filters.

Texts (null: empty; A-Z as a-z) are split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``; everything is per
language (null: ``und``). A candidate is a phrase of 2 to ``max_words`` words that occurs at least ``min_count`` times; its score is that of
its worst cut into two parts, floor(1000000 * a * a / (l * r)). A candidate dies if a longer candidate that holds it occurs at least
``absorb`` percent as often. The first ``top`` candidates of each language are returned.

Words below ``min_count`` cannot stand in a candidate or in a part of one, so they only end runs; the others get dense numbers per
language. An n-gram of word numbers, packed into as few bits as its numbers take, goes through a keyed permutation (rounds that are
undone in reverse), which spreads it evenly and loses nothing. The high bits choose a range; of the other bits, the high ones are the quotient and
all the rest the remainder. A quotient filter is a sorted block of one chunk and range: the number of entries of each quotient in unary,
the remainders in whole bytes, the counts in one byte each with the larger ones beside them. Filters of one range are merged over all chunks
as sorted lists, and the permutation undone for what reaches ``min_count``: counts are exact, and no n-gram travels as text.

Texts are read once and written as chunks: word numbers of the chunk and, as rows, its distinct words. The numbers of the language come
back to each chunk by a join, so no dictionary is broadcast or collected; the driver sees a row per language. Words of kept n-grams are told
apart exactly; within a chunk words are told apart by 64-bit hashes. A hot language spreads over its ranges like any other.

Repeated rows count again, null ids do not matter, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hearthline.llm.common import staged, thinned
from hearthline.llm.ngrams import LOWER
from hearthline.llm.textblocks import U, blocks, byte_table, mix
from hearthline.operators.skew import attach_by_key

WORD = byte_table(r"[^\x20\x09.,;:!?\x0A-\x0D]")
BREAK = byte_table(r"[.,;:!?\x0A-\x0D]")
CHUNK_BYTES = 1 << 23
ROUNDS = 4


def chunks(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Rows (chunk, lang, tokens) and (chunk, lang, local, word, n) of chunks of texts of one language.

    Tokens are the chunk's own word numbers from 1, with 0 between words that are not neighbours in a piece.
    """

    def coded(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
        for block in blocks(texts, WORD, CHUNK_BYTES):
            value, first, local, n = np.unique(block.word_hash(0, LOWER), return_index=True, return_inverse=True, return_counts=True)
            if not len(value):
                continue
            # frequent words get small numbers, which compress well
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(1, len(order) + 1)
            first, local, n = first[order], rank[local], n[order]
            marks = np.concatenate([[0], np.cumsum(BREAK[block.buf])])
            apart = marks[block.start[1:]] != marks[block.end[:-1]]
            new = block.first[(block.first > 0) & (block.first < len(block.start))]
            apart[new - 1] = True
            at = np.arange(len(local)) + np.concatenate([[0], np.cumsum(apart)])
            tokens = np.zeros(int(at[-1]) + 1, dtype=np.uint32)
            tokens[at] = local
            low = LOWER[block.buf].tobytes()
            yield tokens, [low[block.start[i] : block.end[i]] for i in first], n

    def planes(tokens: np.ndarray) -> bytes:
        """The four bytes of all numbers one after the other, compressed, behind how many numbers they are."""
        spread = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T).tobytes()
        return len(tokens).to_bytes(8, "little") + pa.compress(spread, "zstd", asbytes=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        names = ["chunk", "lang", "tokens", "local", "word", "n"]
        for batch in batches:
            for lang in batch["lang"].unique().to_pylist():
                own = batch["text"].filter(pa.compute.equal(batch["lang"], lang))
                for tokens, words, n in coded(own):
                    chunk += 1
                    m = len(words)
                    columns = [
                        pa.array(np.full(m + 1, chunk)),
                        pa.array([lang] * (m + 1)),
                        pa.array([planes(tokens)] + [None] * m, pa.binary()),
                        pa.array(np.arange(m + 1)),
                        pa.array([None, *words], pa.binary()).cast(pa.string()),
                        pa.array(np.concatenate([[0], n])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "chunk long, lang string, tokens binary, local long, word string, n long")


def token_numbers(blob: bytes) -> np.ndarray:
    """The chunk's word numbers from their compressed bytes."""
    m = int.from_bytes(blob[:8], "little")
    spread = pa.decompress(blob[8:], 4 * m, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(spread, np.uint8).reshape(4, m).T).view(np.uint32).reshape(m)


def numbered(words: DataFrame, buckets: int = 1024) -> DataFrame:
    """lang, word, f and a dense id from 1 per language; the numbers of a language are given bucket by bucket."""
    placed = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    ahead = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("lang", "bucket").agg(F.count("*").alias("m")).select("lang", "bucket", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("word"))
    return placed.withColumn("nth", nth).join(starts, ["lang", "bucket"]).select("lang", "word", "f", (F.col("start") + F.col("nth")).alias("id"))


def scramble(value: np.ndarray, half: int, turn: int) -> np.ndarray:
    return mix(value + U((0x9E3779B97F4A7C15 * (turn + 1)) & 0xFFFFFFFFFFFFFFFF)) & U((1 << half) - 1)


def permuted(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of pairs of ``half``-bit numbers."""
    for turn in range(ROUNDS):
        left, right = right, left ^ scramble(right, half, turn)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for turn in reversed(range(ROUNDS)):
        left, right = right ^ scramble(left, half, turn), left
    return left, right


def layout(size: int, bits: int, tokens: int, range_tokens: int) -> tuple[int, int]:
    """Bits of each half of an n-gram of ``size`` numbers, and high bits that choose its range: as many as leave at most 64 others."""
    half = -(-size * bits // 2)
    ranges = max(0, (-(-tokens // range_tokens) - 1).bit_length(), 2 * half - 64)
    return half, min(ranges, half)


def pack(grams: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves of n-grams of word numbers, the first word lowest."""
    half = -(-len(grams) * bits // 2)
    low, high = np.zeros(len(grams[0]), dtype=U), np.zeros(len(grams[0]), dtype=U)
    for k, g in enumerate(grams):
        at = k * bits
        if at < half:
            low |= (g << U(at)) & U((1 << half) - 1)
        if at + bits > half:
            high |= g >> U(half - at) if at < half else g << U(at - half)
    return low, high


def unpack(low: np.ndarray, high: np.ndarray, size: int, bits: int) -> list[np.ndarray]:
    half, out = -(-size * bits // 2), []
    for k in range(size):
        at = k * bits
        g = low >> U(at) if at < half else high >> U(at - half)
        if at < half < at + bits:
            g = g | (high << U(half - at))
        out.append(g & U((1 << bits) - 1))
    return out


def filter_of(values: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """A quotient filter of sorted distinct values below 2**width and their counts."""
    m = len(values)
    quotient = max(0, min(width, m.bit_length() + (width - m.bit_length()) % 8))
    quotient -= 8 if quotient > m.bit_length() + 4 and quotient >= 8 else 0
    remainder = width - quotient
    size = -(-remainder // 8)
    top = (values >> U(remainder)).astype(np.int64) if remainder < 64 else np.zeros(m, dtype=np.int64)
    unary = np.zeros((1 << quotient) + m, dtype=np.uint8)
    unary[top + np.arange(m)] = 1
    rest = values & U((1 << remainder) - 1)
    body = rest.astype("<u8").view(np.uint8).reshape(m, 8)[:, :size]
    large = np.flatnonzero(counts >= 255)
    head = np.array([m, quotient, len(large)], dtype="<i8").tobytes()
    return b"".join(
        [head, np.packbits(unary).tobytes(), np.ascontiguousarray(body).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype("<i8").tobytes(), counts[large].astype("<i8").tobytes()]
    )


def entries(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values and the counts of a quotient filter."""
    m, quotient, large = (int(x) for x in np.frombuffer(blob, "<i8", 3))
    remainder = width - quotient
    size, at = -(-remainder // 8), 24
    n_bits = (1 << quotient) + m
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n_bits // 8), at), count=n_bits)
    at += -(-n_bits // 8)
    wide = np.zeros((m, 8), dtype=np.uint8)
    wide[:, :size] = np.frombuffer(blob, np.uint8, m * size, at).reshape(m, size)
    at += m * size
    counts = np.frombuffer(blob, np.uint8, m, at).astype(np.int64)
    at += m
    places = np.frombuffer(blob, "<i8", large, at)
    counts[places] = np.frombuffer(blob, "<i8", large, at + 8 * large)
    top = (np.flatnonzero(unary) - np.arange(m)).astype(U)
    values = wide.view("<u8").reshape(m)
    return (values | (top << U(remainder)) if remainder < 64 else values), counts


def merged(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of values and counts as one; a stable sort merges runs that are sorted already."""
    values, counts = (np.concatenate(x) for x in zip(*filters, strict=True))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def filters(coded: DataFrame, ids: DataFrame, layouts: dict[str, tuple[int, int]], max_words: int, range_tokens: int) -> DataFrame:
    """Quotient filters (lang, size, part, blob) of the n-grams of each chunk. ids: chunk, local, id; layouts: bits and tokens per language."""

    def step(tokens: pa.Table, mine: pa.Table) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, int, int, bytes]] = []
        for lang, blob in zip(tokens["lang"].to_pylist(), tokens["tokens"].to_pylist(), strict=True):
            local = token_numbers(blob)
            known = np.zeros(int(local.max(initial=0)) + 1, dtype=U)
            known[mine["local"].to_numpy()] = mine["id"].to_numpy().astype(U)
            word = known[local]
            if lang not in layouts:
                continue
            bits, total = layouts[lang]
            at = np.flatnonzero(word)
            for size in range(2, max_words + 1):
                at = at[at + size <= len(word)]
                at = at[word[at + size - 1] > 0]
                half, part_bits = layout(size, bits, total, range_tokens)
                left, right = permuted(*pack([word[at + k] for k in range(size)], bits), half)
                width = 2 * half - part_bits
                part = left >> U(half - part_bits)
                value = ((left & U((1 << (half - part_bits)) - 1)) << U(half)) | right
                order = np.lexsort((value, part)) if part_bits else np.argsort(value)
                part, value = part[order], value[order]
                if not len(value):
                    break
                first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (part[1:] != part[:-1])])
                n = np.diff(np.append(first, len(value)))
                part, value = part[first], value[first]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                found += [(lang, size, int(part[i]), filter_of(value[i:j], n[i:j], width)) for i, j in pairwise([*cuts.tolist(), len(part)])]
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "size", "part", "blob"])

    return coded.groupBy("chunk").cogroup(ids.withColumnRenamed("chunk", "home").groupBy("home")).applyInArrow(step, "lang string, size int, part long, blob binary")


def frequent(filtered: DataFrame, layouts: dict[str, tuple[int, int]], min_count: int, range_tokens: int) -> DataFrame:
    """lang, size, ids and f of the n-grams that occur often enough: filters merged range by range, and the permutation undone."""

    def step(group: pa.Table) -> pa.Table:
        lang, size, part = (group[c][0].as_py() for c in ("lang", "size", "part"))
        bits, total = layouts[lang]
        half, part_bits = layout(size, bits, total, range_tokens)
        value, f = merged([entries(blob.as_buffer().to_pybytes(), 2 * half - part_bits) for blob in group["blob"]])
        value, f = value[f >= min_count], f[f >= min_count]
        left = (value >> U(half)) | (U(part) << U(half - part_bits))
        grams = unpack(*restored(left, value & U((1 << half) - 1), half), size, bits)
        ids = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(grams, axis=1).reshape(-1).astype(np.int64)), size).cast(pa.list_(pa.int64()))
        return pa.table({"lang": pa.array([lang] * len(f), pa.string()), "size": pa.array(np.full(len(f), size, np.int32)), "ids": ids, "f": pa.array(f)})

    return filtered.groupBy("lang", "size", "part").applyInArrow(step, "lang string, size int, ids array<long>, f long")


def scored(counts: DataFrame, words: DataFrame, max_words: int) -> DataFrame:
    """Candidates (lang, ids, a, l, r, score) with the score and parts of their worst cut; counts: lang, size, ids, f of 2 words and more."""
    single = words.select("lang", F.array("id").alias("ids"), "f")
    known = {1: single} | {k: counts.where(F.col("size") == k).select("lang", "ids", "f") for k in range(2, max_words)}
    out = []
    for size in range(2, max_words + 1):
        rows = counts.where(F.col("size") == size).select("lang", "ids", F.col("f").alias("a"))
        cuts = []
        for k in range(1, size):
            for name, n, begin in ((f"l{k}", k, 1), (f"r{k}", size - k, k + 1)):
                rows = rows.withColumn("part", F.slice("ids", begin, n))
                part = known[n].select("lang", F.col("ids").alias("part"), F.col("f").alias(name), F.col("f").alias("m"))
                rows = attach_by_key(rows, part, ["lang", "part"], "m").drop("part")
            ratio = f"CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * 1000000 div (CAST(l{k} AS DECIMAL(15,0)) * CAST(r{k} AS DECIMAL(15,0)))"
            cuts.append(F.struct(F.expr(ratio).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        worst = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        out.append(rows.withColumn("cut", worst).select("lang", "ids", "a", "cut.l", "cut.r", "cut.score"))
    for other in out[1:]:
        out[0] = out[0].union(other)
    return out[0]


def collocations(
    docs: DataFrame,
    max_words: int = 3,
    min_count: int = 10,
    absorb: int = 50,
    top: int = 2000,
    lang_col: str = "lang",
    text_col: str = "text",
    range_tokens: int = 1 << 21,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases per language. Stages chunks, words, filters and counts in jobs of its own."""
    coded = staged(chunks(docs, lang_col, text_col), "chunks")
    local = coded.where("word IS NOT NULL")
    counted = staged(local.groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
    words = staged(numbered(counted.where(F.col("f") >= min_count)), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    kept = words.groupBy("lang").agg(F.max("id").alias("v"))
    totals = staged(totals.join(kept, "lang", "left"), "totals")
    layouts = {r["lang"]: (int(r["v"]).bit_length(), int(r["n"])) for r in totals.where("v IS NOT NULL").collect()}
    place = F.xxhash64("lang", "word").alias("place")
    own = thinned(local.select("chunk", "lang", "local", "word", place), words.select(place), "place")
    ids = own.join(words, ["lang", "word"]).select("chunk", "local", "id")
    shards = filters(coded.where("tokens IS NOT NULL").select("chunk", "lang", "tokens"), ids, layouts, max_words, range_tokens)
    counts = staged(frequent(shards, layouts, min_count, range_tokens), "n-gram-counts")
    found = staged(scored(counts, words, max_words), "candidates")
    # a candidate's inner phrases, with how often the longer one occurs
    inner = [
        counts.where(F.col("size") == size).select("lang", F.slice("ids", k + 1, n).alias("ids"), "f")
        for size in range(3, max_words + 1)
        for n in range(2, size)
        for k in range(size - n + 1)
    ]
    if inner:
        for other in inner[1:]:
            inner[0] = inner[0].union(other)
        most = inner[0].groupBy("lang", "ids").agg(F.max("f").alias("longer"))
        found = found.join(most, ["lang", "ids"], "left").where(f"longer IS NULL OR 100 * longer < {absorb} * a").drop("longer")
    found = staged(found, "survivors")
    # phrases are spelled out only for candidates that can be among the first
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    floor = found.select("lang", "score", "a").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top)
    floor = floor.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"))
    short = found.join(floor, "lang").where("struct(score, a) >= least").drop("least")
    spelled = short.withColumn("key", F.monotonically_increasing_id())
    spelled = staged(spelled, "spelled")
    names = spelled.select("key", "lang", F.posexplode("ids").alias("at", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    names = names.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.join(names, "key").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest([array_to_string(list_slice(w, i, i + 1), ' ') FOR i IN range(1, len(w))]) FROM w WHERE len(w) >= 2
      UNION ALL SELECT lang, 3, unnest([array_to_string(list_slice(w, i, i + 2), ' ') FOR i IN range(1, len(w) - 1)]) FROM w WHERE len(w) >= 3),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS c, w FROM cand),
part AS (SELECT cut.*, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
         FROM cut JOIN f l ON l.lang = cut.lang AND l.k = c AND l.phrase = array_to_string(list_slice(w, 1, c), ' ')
                  JOIN f r ON r.lang = cut.lang AND r.k = cut.k - c AND r.phrase = array_to_string(list_slice(w, c + 1, cut.k), ' ')),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS nth FROM part) WHERE nth = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (
             SELECT lang, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS phrase, a FROM cand WHERE k = 3)
           GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * worst.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

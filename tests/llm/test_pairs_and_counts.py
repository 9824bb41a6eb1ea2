"""Jaccard join, collocations and divergence against brute force in plain Python, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hearthline.llm import collocations, divergence, jaccard_join, near_dedup, textblocks
from hearthline.llm.ngrams import LOWER

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, bands string, label long, key long"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def family(seed: int = 3) -> list[tuple]:
    """Families of near copies around the bound, chains, short texts, nulls, repeats and a long text."""
    rng = random.Random(seed)
    rows, texts = [], []
    for base in range(4):
        words = [f"f{base}w{i}" for i in range(rng.choice([12, 60, 200]))]
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 40) + 2)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(40)}"
            texts.append(" ".join(copy))
    # a chain: each links with the next only
    words = [f"c{i}" for i in range(100)]
    for i in range(12):
        texts.append(" ".join(words[i * 3 : i * 3 + 62]))
    texts += ["one", "ONE", "one two", "one  two", "one two three", "", "   \n ", LONG, LONG + " tail", "É a b", "é a b"]
    for i, t in enumerate(texts):
        rows.append((i + 5, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None]), "x", 1, 2))
    rows += [(1, None, "en", "s0", None, None, None), (None, texts[0], None, None, None, None, None), rows[3], rows[3]]
    return rows


def shingles(text: str | None, width: int = 3) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return frozenset([tuple(words)] if 0 < len(words) < width else [tuple(words[i : i + width]) for i in range(len(words) - width + 1)])


def brute_components(rows: list[tuple], percent: int) -> list[tuple]:
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("percent", "small", "part_rows"), [(90, 16, 1024), (90, 2, 7), (75, 3, 1024)])
def test_jaccard_components(spark, percent, small, part_rows):
    rows = family()
    df = spark.createDataFrame(rows, SCHEMA)
    got = jaccard_join.jaccard_components(df, percent=percent, small=small, part_rows=part_rows).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute_components(rows, percent)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.jaccard_components(none).collect() == []
    assert collocations.collocations(none).collect() == []
    assert divergence.source_divergence(none).collect() == []


def test_linked_sets_agree_in_a_block():
    """Random sets with a similarity of exactly 0.9 and more share a key whatever their sizes, and folded rows stay within the bound."""
    rng = np.random.default_rng(5)
    for n in [1, 5, 9, 10, 19, 20, 21, 57, 200, 950]:
        for _ in range(20):
            union = rng.integers(0, 1 << 62, size=n, dtype=np.int64).astype(np.uint64)
            lost = n // 10
            cut = int(rng.integers(0, lost + 1))
            a, b = np.sort(union[cut:]), np.sort(np.concatenate([union[: n - lost], union[n - lost + lost - cut :]])[: n])
            b = np.setdiff1d(union, union[n - (lost - cut) :] if lost > cut else union[:0])
            a = np.setdiff1d(union, union[:cut])
            if 100 * len(np.intersect1d(a, b)) < 90 * len(np.union1d(a, b)):
                continue
            owner, value = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
            who, key = jaccard_join.block_keys(owner, value, 2, 90)
            assert set(key[who == 0]) & set(key[who == 1])


def phrases(rows: list[tuple], max_words: int, min_count: int, absorb: int, top: int) -> set[tuple]:
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, max_words + 1):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        ranked = []
        for p, a in found.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= absorb * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if not inside:
                ranked.append((-score, -a, " ".join(p).encode(), p, k))
        for nth, (score, a, text, p, k) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, nth, text.decode(), -a, f[p[:k]], f[p[k:]], total[lang], -score))
    return out


@pytest.mark.parametrize(("max_words", "range_tokens", "top"), [(3, 1 << 21, 2000), (4, 50, 2000), (3, 50, 5)])
def test_collocations(spark, max_words, range_tokens, top):
    rng = random.Random(1)
    vocabulary = ["New", "york", "City", "é", "of", "the", "in", "a-b", "x"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(60)), rng.choice(["en", "de", None, "und"]), "s", None, None, None) for i in range(60)]
    rows += [(1, None, None, None, None, None, None), (2, "", "fr", None, None, None, None), rows[0], rows[0], (3, "rare words only", "xx", None, None, None, None)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), max_words=max_words, range_tokens=range_tokens, top=top)
    assert {tuple(r) for r in got.collect()} == phrases(rows, max_words, 10, 50, top)


def test_filters_lose_nothing():
    rng = np.random.default_rng(2)
    for bits, size in [(3, 2), (9, 3), (21, 3), (24, 3), (17, 5)]:
        grams = [rng.integers(0, 1 << bits, size=3000).astype(np.uint64) for _ in range(size)]
        half, part_bits = collocations.layout(size, bits, 10_000, 2000)
        left, right = collocations.permuted(*collocations.pack(grams, bits), half)
        assert all((a == b).all() for a, b in zip(collocations.unpack(*collocations.restored(left, right, half), size, bits), grams, strict=True))
        assert 2 * half - part_bits <= 64
    for width in (0, 3, 8, 30, 41, 64):
        values = np.unique(rng.integers(0, 1 << 63, size=2000, dtype=np.int64).astype(np.uint64) * np.uint64(2) >> np.uint64(64 - width)) if width else np.zeros(1, np.uint64)
        counts = rng.integers(1, 700, size=len(values))
        back = collocations.entries(collocations.filter_of(values, counts, width), width)
        assert (back[0] == values).all() and (back[1] == counts).all()


def brute_divergence(rows: list[tuple], min_docs: int, top: int) -> set[tuple]:
    count, docs, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = [m.translate(ASCII_LOWER) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        seen[lang].add(source)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in seen.items():
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        p, whole = {}, Counter()
        for s in sources:
            mine = {t: count[lang, s][t] for t in kept}
            whole.update(mine)
            p[s] = {t: 1 + 10**9 * (c + 1) // (sum(mine.values()) + len(kept)) for t, c in mine.items()}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        for s in sources:
            pair = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize(("tile_cells", "rows_of_block", "top"), [(1 << 17, 256, 200), (20, 2, 200), (7, 1, 2)])
def test_divergence(spark, tile_cells, rows_of_block, top):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdeÉé" for b in "xyzXY"]
    rows = [(i, " ".join(rng.choices(words[: 10 + i % 25], k=rng.randrange(0, 40))) + " 12 b_c", rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", "s3", None]), None, None, None) for i in range(120)]
    rows += [(1, None, "fr", "s0", None, None, None), (2, "only here", "fr", "s1", None, None, None), (3, None, "en", "bare", None, None, None), rows[0], rows[0]]
    got = divergence.source_divergence(spark.createDataFrame(rows, SCHEMA), tile_cells=tile_cells, rows=rows_of_block, top=top)
    assert {tuple(r) for r in got.collect()} == brute_divergence(rows, 3, top)


def test_shares_are_exact():
    for count, whole in [(0, 1), (5, 7), (10**12, 3 * 10**13 + 1), (8 * 10**15, 9 * 10**15)]:
        assert int(divergence.shares(np.array([count]), np.array([whole]))[0]) == 1 + 10**9 * (count + 1) // whole


def test_very_long_text_is_hashed_in_runs():
    """One text of 50 MB: equal words have equal hashes wherever they stand, and only tables of ``STEP`` powers are kept."""
    unit = "lorem ipsum dolor sit amet " * 4
    text = unit * (50_000_000 // len(unit)) + "z" * 200_000 + " lorem"
    (block,) = textblocks.blocks(pa.array([text]))
    word = block.word_hash(0, LOWER)
    assert len(np.unique(word[:-2])) == 5 and word[-1] == word[0]
    (alone,) = textblocks.blocks(pa.array(["z" * 200_000]))
    assert alone.word_hash(0, LOWER)[0] == word[-2]
    at = np.array([0, 5, len(word) - 7])
    assert len(np.unique(textblocks.window_hash(word, at[:2], 5))) == 1
    assert all(len(t) == textblocks.STEP for t in textblocks._tables.values())


def test_template_family_stays_apart(spark):
    """Documents that share a long template but not their own words are different; true near copies of one of them are not. Compared with exact TF-IDF."""
    rng = random.Random(8)
    template = [f"t{i}" for i in range(184)]
    texts = [" ".join(template + [f"own{k}x{i}" for i in range(20)]) for k in range(30)]
    texts += [" ".join(f"r{rng.randrange(10**9)}" for _ in range(200)) for _ in range(598)]
    texts += [texts[40] + " one more", texts[0] + " tail"]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    classes = {r["doc_id"]: r["class_id"] for r in got}
    sets = [Counter(tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)) for t in texts]
    df = Counter(g for s in sets for g in s)
    weigh = lambda s, o, pick: sum(pick(s[g], o[g]) * (1 + np.log(len(texts) / df[g])) for g in s.keys() | o.keys())
    for a, b in [(0, 1), (0, 629), (40, 628), (3, 17)]:
        similar = weigh(sets[a], sets[b], min) / weigh(sets[a], sets[b], max) >= 0.8
        assert (classes[a] == classes[b]) == similar
    assert len({classes[k] for k in range(30)}) == 30
    assert sum(r["kept"] for r in got) == 628

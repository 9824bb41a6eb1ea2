"""The corpus operators against SQL, brute force and round trips, with nulls, empty and long texts, ties and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hearthline.llm import decontaminate, near_dedup, packing, pii, quality_lines, queries, substring_dedup, toxicity, warc
from hearthline.llm.chain_crf import viterbi
from hearthline.llm.importance import kth_largest, resample
from hearthline.llm.pii_rules import base_spans
from hearthline.llm.separator_scan import scan_token_files, token_counts
from hearthline.llm.tagger import Tagger
from hearthline.llm.tokens import Encoder, vocabulary_path
from tests.oracle import canonical, connect

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
ODD = [
    (1, "a b  c\n d É", "en", "w"),
    (2, None, None, None),
    (3, "", "en", "x"),
    (4, "   \n\n \n ", "en", "x"),
    (5, LONG, "en", "y"),
    (6, LONG + " tail", "en", "y"),
    (6, LONG + " tail", "en", "y"),
    (None, "one two three four five six seven eight nine ten eleven", None, "z"),
    (8, "mail a.b@c.example.org, ip 10.0.0.255 card 4111 1111 1111 1111 phone +1 (212) 555-0100.", "en", "z"),
]
SCHEMA = "doc_id long, text string, lang string, bands string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, an empty and a very long text, a repeated row, and a column named like an internal one."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(SF).execute(queries.ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == canonical(cols, cur.fetchall())


def test_near_dedup(spark, odd, none):
    base = [f"word{i}" for i in range(400)]
    near = [*base[:200], "changed", *base[201:]]
    rows = [(10 + i, " ".join(near if i % 2 else base), None, None) for i in range(40)] + [(90, " ".join(base[::-1]), None, None)]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i].class_id for i in range(10, 50)} == {10} and got[90].class_id == 90
    assert [i for i in got if got[i].kept] == [10, 90] and got[10].n_links == 1
    odd_rows = near_dedup.near_duplicates(odd).collect()
    assert len(odd_rows) == len(ODD) and sum(r.kept for r in odd_rows if r.class_id == 5) == 1
    assert {r.class_id for r in odd_rows if r.doc_id in (5, 6)} == {5} and {r.class_id for r in odd_rows if r.doc_id in (2, 3)} == {2}
    assert near_dedup.near_duplicates(none).count() == 0


def test_large_bucket(spark):
    """More copies than a bucket compares pair by pair still form one class."""
    base = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :]]), None, None) for i in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), small=4).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_links_of_large_bucket(spark):
    """In a family that is alike throughout, every text shows a link to every other one, whatever the size of its buckets."""
    base = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :]]), None, None) for i in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame([*rows, rows[7]], SCHEMA)).collect()
    assert [r.n_links for r in got] == [59] * 61


def brute_force(texts, similarity=0.8):
    """Class (its first text) and number of links of each text, all shingles weighing alike, from all pairs."""
    held = [Counter(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    label, links = list(range(len(texts))), [0] * len(texts)
    for i, x in enumerate(held):
        for j, y in enumerate(held[:i]):
            shared = (x & y).total()
            if shared >= similarity * (x.total() + y.total() - shared):
                links[i], links[j] = links[i] + 1, links[j] + 1
                low, high = sorted((label[i], label[j]))
                label = [low if c == high else c for c in label]
    return label, links


@pytest.mark.parametrize(("small", "settings"), [(16, {}), (4, {"part_texts": 20})])
def test_template_family(spark, small, settings):
    """Texts of one template whose pairs lie around the wanted similarity have the classes and links of brute force."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(120):
        words = [f"form{k}" for k in range(220)]
        for at in rng.choice(20, 3 if i < 60 else 5, replace=False):
            words[5 + at * 10] = f"own{rng.integers(3)}at{at}"
        texts.append(" ".join([*words, *(words[:40] if i % 3 else [])]))
    label, links = brute_force(texts)
    assert len(set(label)) > 2 and max(links) > 16
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), small=small, floor=1.0, bands=40, **settings).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == dict(enumerate(zip(label, links, strict=True)))


def test_samples_estimate_similarity():
    value = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x, y = near_dedup.weighted_samples(np.repeat([0, 1], 1500), np.r_[value[:1500], value[500:]], np.r_[np.full(1500, 2.0), np.full(1500, 3.0)], 2, 400).T
    assert abs((x == y).mean() - 1000 * 2 / (500 * 2 + 1000 * 3 + 500 * 3)) < 0.08


def test_decontamination_paths(spark, odd, none):
    items = spark.createDataFrame([(1, "two THREE four five"), (2, None), (3, " ".join(f"w{i % 977}x{i % 31}" for i in range(50, 90)))], "item_id long, text string")
    wide = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(odd, items).collect()}
    assert wide == {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(odd, items, broadcast_rows=0).collect()}
    assert (None, 11, 4, 1) in wide and (5, 20_000, 40, 1) in wide and (2, 0, 0, 0) in wide
    assert decontaminate.decontaminate(odd, items).count() == len(ODD)
    assert decontaminate.decontaminate(none, items).count() == 0 and decontaminate.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0


def test_substring_dedup(odd, none):
    got = substring_dedup.substring_dedup(odd).collect()
    by = Counter((r.doc_id, r.n_words, r.n_removed) for r in got)
    assert len(got) == len(ODD) and by[(6, 20_001, 20_001)] == 1 and by[(2, 0, 0)] == 1
    assert by[(6, 20_001, 20_000)] == 1 and substring_dedup.substring_dedup(none).count() == 0


def test_toxicity(spark, odd, none):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    model = toxicity.fit_toxicity(spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), labels, f"NOT ({toxicity.HELD_OUT})")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/../sf0.01/labels.parquet").collect()}
    scores = sorted((r.score, truth[r.doc_id]) for r in toxicity.score_toxicity(docs, model).collect() if r.doc_id in truth)
    low = np.cumsum([1 - y for _, y in scores])
    auc = sum(n for n, (_, y) in zip(low, scores, strict=True) if y) / (sum(y for _, y in scores) * low[-1])
    assert auc > 0.9
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and toxicity.score_toxicity(none, model).count() == 0
    empty = toxicity.fit_toxicity(odd, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd, empty).collect()} == {0.5}


def test_packing(spark, odd, none):
    encode = Encoder(vocabulary_path()).whole
    for rows, frame in ((ODD, odd), ([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], spark.read.parquet(f"{SF}/documents.parquet"))):
        pieces = packing.pack(frame).collect()
        ids = {}
        for r in rows:
            ids[r[0]] = np.array([*encode.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p in pieces:
            assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        used: dict[int, list] = {}
        for p in pieces:
            used.setdefault(p.sequence_id, []).append((p.offset, p.length))
        for own in used.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
        assert sum(p.length for p in pieces) == sum(len(ids[r[0]]) for r in rows)
    assert packing.pack(none).count() == 0


def test_differencing():
    sizes = np.random.default_rng(1).integers(1, 257, 600)
    sums = np.bincount(packing.differencing(sizes, 80), weights=sizes)
    assert len(sums) == 80 and sums.max() - sums.min() < 16
    assert np.bincount(packing.windows(sizes), weights=sizes).max() <= 1024


def test_encoder():
    e = Encoder(vocabulary_path(), keep=3)
    for t in ["a  b   c", " x", "\n\n foo \n bar", "a\n \nb", "l'été d'or don't", "<|endoftext|> a<|endoftext|>b", "a.\nB, c", "日本 語", "word.\nWord. x", LONG]:
        assert list(e.ids(t)) == e.whole.encode(t, add_special_tokens=False).ids


def test_token_counts(spark, odd, none, tmp_path):
    encode = Encoder(vocabulary_path(), special_as_text=True).whole
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts(odd, block_tokens=1000).collect())
    assert got == Counter((r[0], len(encode.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert token_counts(none).count() == 0
    np.array([5, 6, 9, 9, 7, 7, 7, 7, 7, 9, 8], dtype="<u2").tofile(tmp_path / "a.bin")
    rows = scan_token_files(spark, str(tmp_path), separator=9, block_tokens=2).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start, r.length, r.closed) for r in rows] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 5, True), (3, 10, 1, False)]


def test_personal(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    tagger = pii.fit_tagger(docs, fit_windows=300, steps=30)
    got = {r.doc_id: r for r in pii.find_personal(odd, tagger).collect()}
    assert (got[8].n_email, got[8].n_ip, got[8].n_card, got[8].n_phone) == (1, 1, 1, 1) and got[2].spans == "" and got[5].n_card == 0
    assert got[8].base_sha256 == hashlib.sha256(pii.written(base_spans(ODD[8][1])).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(odd, tagger).collect()}
    assert clean[8] == "mail [EMAIL], ip [IP] card [CARD] phone [PHONE]." and clean[2] is None and clean[5] == LONG
    assert pii.find_personal(none, None).count() == 0 and pii.fit_tagger(none) is None


@pytest.mark.parametrize("text", ["a@b.c@d.e x@y", "@a.b ..@c.d-e.f.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111-1111-1111-1111 5 5 5", "++1 (2)--345678 9+12", "é a@ñ.c 9" * 3])
def test_rules_against_plain_patterns(text):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    good = {"email": lambda t: True, "ip": pii_ip, "card": pii.plausible.__globals__["is_card"], "phone": pii.plausible.__globals__["is_phone"]}
    assert base_spans(text) == [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, text) if good[k](m.group())]


def pii_ip(text: str) -> bool:
    return all(int(p) <= 255 for p in text.split("."))


def test_tagger_gradient():
    draw = np.random.default_rng(2)
    tagger, x, y = Tagger(size=3, inputs=4), draw.integers(0, 130, (2, 6)), draw.integers(0, 9, (2, 6)).astype(np.int8)
    _, grad = tagger.gradient(x, y)
    for name, at in (("wx_f", (1, 2)), ("wh_b", (0, 4)), ("trans", (int(y[0, 0]), int(y[0, 1]))), ("out", (2, 3)), ("emb", (int(x[0, 3]), 1))):
        values = []
        for step in (1e-5, -1e-5):
            tagger.p[name][at] += step
            values.append(tagger.gradient(x, y)[0])
            tagger.p[name][at] -= step
        assert abs((values[0] - values[1]) / 2e-5 - grad[name][at]) < 1e-4


def test_viterbi():
    import itertools

    draw = np.random.default_rng(4)
    emit, trans, lengths = draw.normal(size=(3, 5, 2)), draw.normal(size=(2, 2)), np.array([5, 4, 1])
    best = viterbi(emit, lengths, trans)
    for r, n in enumerate(lengths):
        score = {p: sum(emit[r, i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in itertools.product((0, 1), repeat=int(n))}
        assert tuple(best[r, :n]) == max(score, key=score.get)


def test_warc(spark):
    body = "é" * 600
    rows = [(1, "http://a/\n b", body), (2, None, body), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", body), (7, "u", "x" * 2000)]
    got = warc.archive_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kinds = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got}
    assert kinds == {1: ("revisit", 2, 1200), 2: ("response", None, 1200), 3: ("response", None, 5), 4: ("response", None, 5), 5: ("response", None, 0), None: ("revisit", 2, 1200), 7: ("response", None, 2000)}
    assert all(r.payload_digest == hashlib.sha1(body.encode()).hexdigest() for r in got if r.page_id in (1, 2, None))
    assert warc.archive_pages(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_lines.fit_lines(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_lines.quality_rules(docs, model).collect():
        text = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality_lines.quality_rules(odd, model).count() == len(ODD) and quality_lines.keep_good(none, model).count() == 0
    assert not quality_lines.fit_lines(none, spark.read.parquet(f"{SF}/labels.parquet")).emit.any()


def test_importance(spark, odd, none):
    got = resample(odd, np.zeros(100), keep_share=0.5).collect()
    assert len(got) == len(ODD) and len(ODD) / 2 <= sum(r.kept for r in got) <= len(ODD) / 2 + 1
    values = spark.createDataFrame([(float(v),) for v in [3, 3, 1, 9, 9.5, 2, -4]], "v double")
    assert [kth_largest(values, "v", k, ranges=2) for k in (1, 2, 3, 4, 5, 7)] == [9.5, 9.0, 3.0, 3.0, 2.0, -4.0]
    assert resample(none, np.zeros(100)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = queries.read.__globals__["staged"](stage(spark, docs, SF), name)
        assert docs.columns == before
    left = {r.doc_id: r.text for r in docs.collect()}
    assert 0 < len(left) < len(texts) and all(not base_spans(t) for t in left.values())
    assert {p.doc_id for p in corpus_pipeline.run(spark, SF).collect()} == set(left)

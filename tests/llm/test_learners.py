"""The learners of the corpus operators: plain versions without hashing, and held-out rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearthline.llm import importance, quality_lines, queries, toxicity

SF = "/root/testdata/sf0.1"
WORDS = ["calm", "river", "Stone", "green", "paper", "vile", "curse", "rot", "light", "field"]
LABELS = "doc_id long, toxic int, quality int"


def _corpus(n: int = 60) -> tuple[list[tuple], list[tuple]]:
    """Texts whose label depends on words and on a pair; some are null, empty or very short."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS[:5] + WORDS[8:] + (WORDS if i % 3 == 0 else [])) for _ in range(rng.randint(1, 25))]
        text = rng.choice(["{}", "{}.", "({})!"]).format(rng.choice([" ", ", ", " -- "]).join(words))
        docs.append((i, {7: None, 8: ""}.get(i, text)))
        if i % 4:
            labels.append((i, int("vile" in words or "curse" in words), int(i % 3 != 0)))
    return docs, labels


def _skip_features(text: str | None) -> set:
    w = re.findall(r"[0-9a-z]+", (text or "").lower())
    return set(w) | {("pair", *p) for p in zip(w, w[1:])} | {("skip", *p) for p in zip(w, w[2:])}


def _plain_ftrl(rows: list[tuple], alpha: float, beta: float, l1: float, l2: float, epochs: int) -> dict:
    """FTRL-proximal, coordinate by coordinate; the bias, None, is not penalised."""
    z, n = Counter(), Counter()

    def weight(f):
        least = 0.0 if f is None else l1
        if abs(z[f]) <= least:
            return 0.0
        return -(z[f] - math.copysign(least, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for features, label in rows:
            w = {f: weight(f) for f in [*features, None]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for f in w:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return {f: weight(f) for f in list(z)}


@pytest.mark.parametrize("l1,l2", [(0.0, 0.0), (0.4, 0.1)])
def test_ftrl_equals_a_plain_version(spark, l1, l2):
    docs, labels = _corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = toxicity.fit_toxicity(df, spark.createDataFrame(labels, LABELS), l1=l1, l2=l2, alpha=0.5, epochs=3, bits=22)
    texts = dict(docs)
    plain = _plain_ftrl([(_skip_features(texts[i]), toxic) for i, toxic, _ in labels], 0.5, 1.0, l1, l2, 3)
    assert len(model.index) == sum(f is not None and w != 0 for f, w in plain.items())
    for r in toxicity.score_toxicity(df, model).collect():
        logit = plain[None] + sum(plain.get(f, 0.0) for f in _skip_features(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5)


def test_held_out_toxic_documents_are_found(spark):
    found = queries.QUERIES["op3_toxicity"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [p for t, p in held if t == 1], [p for t, p in held if t == 0]
    assert len(toxic) >= 50 and sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def _runs(text: str | None) -> list:
    runs = re.findall(r"[0-9a-z]+|[^0-9a-z\s]+", (text or "").lower())
    return [*runs, *zip(runs, runs[1:])]


def test_importance_equals_a_plain_ratio(spark):
    docs, labels = _corpus()
    df, marks = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, LABELS)
    buckets, smooth = 1_000_003, 0.5
    ratio = importance.fit_ratio(df, marks, buckets=buckets, smooth=smooth)
    texts = dict(docs)
    raw, target = Counter(), Counter()
    for text in texts.values():
        raw.update(_runs(text))
    for i, _, quality in labels:
        if quality == 1:
            target.update(_runs(texts[i]))
    raw_all = sum(raw.values()) + smooth * buckets
    target_all = sum(target.values()) + smooth * buckets

    def gain(f):
        share = (raw[f] + smooth) / raw_all
        return math.log((target[f] + smooth * buckets * share) / target_all) - math.log(share)

    scored = {r["doc_id"]: r["log_weight"] for r in importance.log_importance(df, ratio).collect()}
    assert scored == pytest.approx({i: sum(map(gain, _runs(t))) for i, t in docs}, abs=1e-6)


def test_importance_parts_labelled_documents_it_was_not_fitted_on(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.expr("pmod(crc32(cast(doc_id AS string)), 2)")
    scored = importance.log_importance(docs, importance.fit_ratio(docs, labels.where(fold == 0)))
    shares = scored.join(labels.where(fold == 1), "doc_id").groupBy("quality").agg(F.avg((F.col("log_weight") > 0).cast("double")).alias("s"), F.count("*").alias("n"))
    share = {r["quality"]: (r["s"], r["n"]) for r in shares.collect()}
    assert min(share[0][1], share[1][1]) >= 20 and share[1][0] >= 0.9 and share[0][0] <= 0.3


def test_line_field_judges_documents_it_was_not_fitted_on(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.expr("pmod(crc32(cast(doc_id AS string)), 2)")
    model = quality_lines.fit_lines(docs, labels.where(fold == 0))
    rest = labels.where((fold == 1) & F.col("quality").isNotNull())
    judged = quality_lines.quality_rules(docs.join(rest.select("doc_id"), "doc_id"), model).join(rest, "doc_id").where("NOT base_failed").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in judged)
    assert len(judged) > 300 and right >= 0.95 * len(judged)
    bad = [r for r in judged if r["quality"] == 0]
    assert bad and sum(not r["kept"] for r in bad) >= 0.8 * len(bad)

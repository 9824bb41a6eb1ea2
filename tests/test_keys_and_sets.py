"""Rows per key, itemsets of any size, samples and column differences against plain Python."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from hearthline.operators import dedup, roles, rules, splits as L


@pytest.mark.parametrize("text_ids", [False, True])
def test_latest_and_best_per_key(spark, text_ids):
    rng = random.Random(3)
    rows = []
    for i in range(-150, 150):
        day = rng.choice([None, dt.date(1950, 1, 1), dt.date(2008, 5, 1), dt.date(2011, 5, 1)])
        rows.append((rng.choice([None, 1, 2, 3, 3, 3]), day, f"{i:04d}" if text_ids else i * 10**16, rng.choice([None, 1.0])))
    df = spark.createDataFrame(rows, f"k int, d date, i {'string' if text_ids else 'bigint'}, x double")
    early = dt.date.min

    def expected(order):
        best = {}
        for r in rows:
            if r[0] is not None and (r[0] not in best or order(r) > order(best[r[0]])):
                best[r[0]] = r
        return {r[2] for r in rows if r[0] is None} | {r[2] for r in best.values()}

    latest = dedup.latest_per_key(df, "k", "d", "i")
    assert latest.columns == df.columns
    assert {r["i"] for r in latest.collect()} == expected(lambda r: (r[1] or early, r[2]))
    if not text_ids:
        plan = latest._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
    best = dedup.best_quality_per_key(df, "k", "d", "i", ["x"])
    assert {r["i"] for r in best.collect()} == expected(
        lambda r: (((r[1].year if r[1] else 2007) - 2007) * 10 + (r[3] is not None), r[1] or early, r[2])
    )
    assert dedup.latest_per_key(df.limit(0), "k", "d", "i").count() == 0


def test_itemsets_of_any_size_and_their_rules(spark):
    rng = random.Random(5)
    baskets = [sorted({"a", "b", "c", "d", "e"} | set(rng.sample("fgh", 1))) if rng.random() < 0.4 else sorted(rng.sample("abcdefgh", 4)) for _ in range(200)]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    counts = Counter(s for b in baskets for n in range(1, len(b) + 1) for s in combinations(b, n))
    want = {s: n for s, n in counts.items() if n >= 20}
    sets = rules.frequent_itemsets(df, min_support=0.1, max_size=None)
    assert {tuple(r["itemset"]): r["n"] for r in sets.collect()} == want
    assert max(map(len, want)) == 6 or max(map(len, want)) == 5
    two = rules.frequent_itemsets(df, min_support=0.1, max_size=2)
    assert {tuple(r["itemset"]) for r in two.collect()} == {s for s in want if len(s) <= 2}
    got = {(tuple(r["antecedent"]), tuple(r["consequent"])): r["confidence"] for r in rules.association_rules(sets, 0.0).collect()}
    splits = {(a, tuple(x for x in s if x not in a)): want[s] / want[a] for s in want for n in range(1, len(s)) for a in combinations(s, n)}
    assert got.keys() == splits.keys()
    assert all(abs(got[k] - splits[k]) < 1e-12 for k in got)
    assert rules.frequent_itemsets(df.limit(0), max_size=None).count() == 0


def test_sample_is_the_smallest_hashes(spark):
    df = spark.range(5000)
    from hearthline.functions.hashing import hash32

    ordered = [r["id"] for r in df.orderBy(hash32(9, F.col("id")), "id").collect()]
    for n in (0, 1, 700, 5000, 9000):
        assert [r["id"] for r in L.hash_sample(df, n, "id", 9).collect()] == ordered[:n]
    assert L.hash_sample(df.limit(0), 5, "id").count() == 0


def test_columns_with_values_on_one_side(spark):
    left = spark.createDataFrame([(1, None, "x")], "a int, b int, c string")
    right = spark.createDataFrame([(1, 2, None), (1, None, None)], "a int, b int, c string")
    got = {(r["column"], r["side"]) for r in roles.column_difference(left, right).collect()}
    assert got == {("b", "right_only"), ("c", "left_only")}

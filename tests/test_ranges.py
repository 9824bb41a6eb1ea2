"""Ranges of an order: cut points per group, weights, codes of many levels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.models.prep import level_codes
from hearthline.operators import orderstats as O


def _numbers(spark):
    """Groups of very different size and scale, a null group, nulls and a value that holds a third of the rows."""
    rng = np.random.default_rng(3)
    rows = [("wide", float(v)) for v in rng.normal(1e6, 1e5, 900)] + [("narrow", float(v)) for v in rng.random(700)]
    rows += [(None, float(v)) for v in rng.random(300)] + [("few", float(v)) for v in (1, 2, 3)] + [("hot", 7.0)] * 900 + [("wide", None), ("none", None)]
    return spark.createDataFrame(rows, "g string, v double")


def test_every_group_has_its_own_cuts(spark):
    df = _numbers(spark)
    counts = df.where("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    placed, ranges = O.range_bucket(counts, "v", ["g"], 20)
    sizes = {g: [] for g in ("wide", "narrow", None, "few", "hot")}
    for r in placed.groupBy("g", ranges).agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["g"]].append(r["n"])
    per_range = -(-1904 // 20)
    assert len(sizes["wide"]) == -(-900 // per_range) and len(sizes["narrow"]) == -(-700 // per_range) and len(sizes[None]) == -(-300 // per_range)
    assert len(sizes["few"]) == len(sizes["hot"]) == 1
    assert max(n for found in sizes.values() for n in found) <= per_range + 20


@pytest.mark.parametrize("buckets", [None, 1, 3, 20])
def test_percentiles_do_not_depend_on_ranges(spark, buckets):
    df = _numbers(spark)
    points = {"a": 0.1, "m": 0.5, "z": 0.99}
    found = {r["g"]: (r["a"], r["m"], r["z"]) for r in O.exact_percentiles(df, "v", points, ["g"], buckets=buckets).collect()}
    frame = df.where("v IS NOT NULL").toPandas()
    for g, own in frame.groupby("g", dropna=False)["v"]:
        assert found[g if isinstance(g, str) else None] == pytest.approx(np.percentile(own, [10, 50, 99]))
    assert len(found) == 5
    whole = O.exact_percentiles(df, "v", points, buckets=buckets).first()
    assert tuple(whole) == pytest.approx(np.percentile(frame["v"], [10, 50, 99]))


@pytest.mark.parametrize("bounded", [False, True])
def test_weights_repeat_rows(spark, bounded):
    rows = [("a", 1.0, 3), ("a", 5.0, 1), ("a", 1.0, 2), ("b", 2.0, 1), ("b", None, 9), ("b", 4.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    found = {r["g"]: r["m"] for r in O.exact_percentiles(df, "v", {"m": 0.9}, ["g"], weight="w", bounded=bounded).collect()}
    assert found == pytest.approx({"a": np.percentile([1] * 5 + [5], 90), "b": np.percentile([2, 4], 90)})


def test_places_among_cuts(spark):
    df = spark.range(0, 14).select((F.col("id") / 2.0).alias("v"), F.array(*[F.lit(float(x)) for x in (1, 2, 2, 5)]).alias("c"))
    for most in (4, 5, 100):
        got = [r[0] for r in df.select(O.place_among(F.col("c"), F.col("v"), most)).collect()]
        assert got == [int(np.searchsorted([1, 2, 2, 5], i / 2.0, side="right")) for i in range(14)]


def test_codes_of_many_levels(spark, monkeypatch):
    import hearthline.models.prep as prep

    monkeypatch.setattr(prep, "PER_RANGE", 50)
    df = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("w")).union(spark.createDataFrame([(None,)], "w string"))
    codes = {r["level"]: r["code"] for r in level_codes(df, "w").collect()}
    assert codes == {w: i for i, w in enumerate(sorted(codes))} and len(codes) == 3000
    assert level_codes(df.where("w IS NULL"), "w").count() == 0

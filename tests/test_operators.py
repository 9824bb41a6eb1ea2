"""Operators against brute force on small fixtures, with hot keys and nulls."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from hearthline import config as C
from hearthline.functions.hashing import poisson_count
from hearthline.functions import scalars as S
from hearthline.models import prep, tuning
from hearthline.models.explain import shuffled_column
from hearthline.operators import bootstrap, checks, dedup, evaluation as E, neighbours, orderstats as O, repair as R, rules, segments as G, splits as L
from hearthline.operators.association import cramers_v, spearman
from hearthline.operators.skew import attach_by_key
from hearthline.plans.cleaning import build_clean


def hot_values(n=3000, seed=3):
    """A third of the rows share one value."""
    rnd = random.Random(seed)
    return [5.0 if i % 3 == 0 else round(rnd.gauss(0, 100), 3) for i in range(n)]


@pytest.fixture(scope="module")
def hot(spark):
    rows = [(i, "a" if i % 3 else "b", v if i % 50 else None) for i, v in enumerate(hot_values())]
    return spark.createDataFrame(rows, "id bigint, g string, v double").cache()


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.995, 1.0])
def test_exact_percentile(hot, q):
    pdf = hot.toPandas()
    got = {r["g"]: r["q"] for r in O.exact_percentiles(hot, "v", {"q": q}, ["g"], buckets=16).collect()}
    for g, want in pdf.groupby("g")["v"].quantile(q).items():
        assert got[g] == pytest.approx(want, abs=1e-9)
    whole = O.exact_percentiles(hot, "v", {"q": q}).first()["q"]
    assert whole == pytest.approx(pdf["v"].quantile(q), abs=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-5, 5), min_size=1, max_size=40), q=st.floats(0, 1))
def test_percentile_property(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = O.exact_percentiles(df, "v", {"q": q}, buckets=4).first()["q"]
    assert got == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_average_ranks(hot):
    pdf = hot.toPandas().dropna()
    want = dict(zip(pdf["v"], pdf["v"].rank()))
    assert {r["v"]: r["rank"] for r in O.average_ranks(hot, "v").collect()} == want


def test_hash_positions_are_a_permutation(hot):
    rows = O.hash_positions(hot, "id", 1, ["g"], buckets=8).toPandas()
    for _, part in rows.groupby("g"):
        assert sorted(part["position"]) == list(range(len(part)))
        assert set(part["group_size"]) == {len(part)}


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_attach_by_key_same_both_ways(spark, broadcast_rows):
    rows = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 1000))
    per_key = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = attach_by_key(rows, per_key, ["k"], "n", broadcast_rows=broadcast_rows, max_heavy=50).toPandas()
    pdf = rows.toPandas()
    want = pdf.groupby("k")["id"].max()
    assert len(got) == 3000
    merged = got.set_index("id")
    for i, k in zip(pdf["id"], pdf["k"]):
        if pd.isna(k):
            assert pd.isna(merged.loc[i, "top"])
        else:
            assert merged.loc[i, "top"] == want[k]


D = dt.date


def test_quality_dedup(spark):
    full = {c: "x" for c in C.ROLES["core"][2:]}
    rows = [
        (1, 10, D(2019, 5, 1), 9), (2, 10, D(2020, 1, 1), 0),
        (3, 20, D(2020, 2, 1), 9), (4, 20, D(2020, 11, 1), 3),
        (5, None, D(2018, 1, 1), 9), (6, None, D(2018, 1, 1), 9),
    ]
    data = []
    for i, key, day, filled in rows:
        core = [1.0 if j < filled else None for j in range(2)] + ["x" if j + 2 < filled else None for j in range(7)]
        data.append((i, key, day, *core))
    ddl = "LMK_KEY int, UPRN bigint, INSPECTION_DATE date, " + ", ".join(
        f"{c} {'double' if i < 2 else 'string'}" for i, c in enumerate(C.ROLES["core"])
    )
    df = spark.createDataFrame(data, ddl)
    assert sorted(r["LMK_KEY"] for r in dedup.best_quality_per_key(df).collect()) == [2, 3, 5, 6]
    assert sorted(r["LMK_KEY"] for r in dedup.latest_per_key(df).collect()) == [2, 4, 5, 6]
    assert full


def test_group_temporal_split(spark):
    rows = [
        (1, 1, D(2020, 1, 1)), (2, 1, D(2022, 12, 31)), (3, 2, D(2021, 1, 1)), (4, 2, D(2023, 1, 1)),
        (5, None, D(2023, 5, 5)), (6, None, None), (7, None, D(2022, 1, 1)), (8, 3, None),
    ]
    df = spark.createDataFrame(rows, "LMK_KEY int, UPRN int, INSPECTION_DATE date")
    got = {r["LMK_KEY"]: r["split"] for r in L.group_temporal_split(df).collect()}
    assert got == {1: "train", 2: "train", 3: "discard", 4: "test", 5: "test", 6: "discard", 7: "train", 8: "discard"}
    split = L.group_temporal_split(df)
    assert checks.group_overlap(split, "UPRN").first()[0] == 0
    assert {r["status"] for r in checks.check_split(split, C.CUTOFF).collect()} == {"pass"}


def test_repairs_and_log(spark):
    rows = [(5.0, 4.0, 50.0, -0.1, 20.0), (0.0, 4.0, 0.0, None, None), (3.0, 0.0, 20.0, 1.0, 1.0), (1.0, 40.0, 20.0, 1.0, -1.0)]
    df = spark.createDataFrame(rows, f"{R.HEATED} double, {R.HABITABLE} double, {C.AREA} double, CO2_EMISSIONS_CURRENT double, ENERGY_CONSUMPTION_CURRENT double")
    fixed = [tuple(r) for r in R.repair_consistency(df).select(R.HEATED, R.HABITABLE, C.AREA, "HAS_ONSITE_GENERATION").collect()]
    assert fixed == [(4.0, 4.0, 50.0, 1), (None, 4.0, None, 0), (None, None, 20.0, 0), (1.0, 40.0, 20.0, 1)]
    log = {r["rule"]: r["n_rows_affected"] for r in R.cleaning_log(df).collect()}
    assert log == {
        "heated > habitable": 2, f"{R.HEATED} == 0": 2, f"{R.HABITABLE} == 0": 1, f"{C.AREA} == 0": 1,
        "negative emissions/consumption": 2, "habitable_rooms > 30 (HMO)": 1,
    }


def test_sentinels_and_null_rates(spark):
    df = spark.createDataFrame([("NO DATA!",), (" nodata! ",), ("INVALID!",), ("not defined",), ("Good",), (None,), (" NODATA\t",)], "v string")
    assert [r[0] for r in R.normalise_sentinels(df).collect()] == [None] * 4 + ["Good"] + [None] * 2
    thin = spark.range(1000).select(F.when(F.col("id") < 1, 1).alias("gone"), F.when(F.col("id") < 2, 1).alias("kept"))
    assert R.drop_fully_missing(thin).columns == ["kept"]
    edge = spark.range(1000).select(F.when(F.col("id") >= 50, 1).alias("five"), F.when(F.col("id") >= 49, 1).alias("less"))
    assert R.add_missing_flags(edge).columns == ["five", "less", "five_IS_MISSING"]


def test_clean_invariants(spark):
    from hearthline.queries.roles import certificates

    clean = build_clean(certificates(spark, "/root/testdata/sf0.001"), "R1").cache()
    assert {r["status"] for r in checks.check_clean(clean).collect()} == {"pass"}
    again = build_clean(certificates(spark, "/root/testdata/sf0.001"), "R1")
    assert checks.check_rerun(clean, again).first()["status"] == "pass"


def kappa(t, p, power, k=7):
    o = np.zeros((k, k))
    for a, b in zip(t, p):
        o[a, b] += 1
    w = np.abs(np.subtract.outer(np.arange(k), np.arange(k))) ** power
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    return 1 - (w * o).sum() / (w * e).sum() if (w * e).sum() else None


@pytest.mark.parametrize("seed", range(3))
def test_metrics_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 7 if seed else 4, 200)
    p = np.clip(t + rng.integers(-2, 3, 200), 0, 6)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "p": p}))
    m = E.classification_metrics(E.confusion_cells(df)).first()
    assert m["qwk"] == pytest.approx(kappa(t, p, 2))
    assert m["linear_kappa"] == pytest.approx(kappa(t, p, 1))
    assert m["accuracy"] == pytest.approx((t == p).mean())
    recalls = [((t == k) & (p == k)).sum() / (t == k).sum() for k in range(7) if (t == k).any()]
    assert m["balanced_accuracy"] == pytest.approx(np.mean(recalls))
    f1 = [2 * ((t == k) & (p == k)).sum() / d if (d := (t == k).sum() + (p == k).sum()) else 0 for k in range(7)]
    assert m["macro_f1"] == pytest.approx(np.mean(f1))


def test_one_class_only(spark):
    df = spark.createDataFrame([(3, 3)] * 5, "t int, p int")
    m = E.classification_metrics(E.confusion_cells(df)).first()
    assert m["qwk"] is None and m["linear_kappa"] is None
    assert m["macro_f1"] == pytest.approx(1 / 7)


def test_within_and_support(spark):
    df = spark.createDataFrame([(50.0, 50.0), (50.0, 55.0), (50.0, 60.0), (50.0, 66.0)], "y double, yhat double")
    assert tuple(E.within_points(df).first()) == (0.5, 0.75, 0.75)
    seg = spark.range(59).select(F.when(F.col("id") < 29, "thin").otherwise("thick").alias("s"), F.lit(50.0).alias("y"), F.lit(60.0).alias("yhat"))
    assert [r["s"] for r in E.segment_metrics(seg, "s", "y", "yhat").collect()] == ["thick"]


def test_poisson_draws(spark):
    for mean in (1.0, 5.0, 31.0, 40.0, 5000.0):
        df = spark.range(20000).select(poisson_count(F.lit(mean), 9, F.col("id")).alias("w"))
        s = df.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
        assert s["m"] == pytest.approx(mean, rel=0.05)
        assert s["v"] == pytest.approx(mean, rel=0.06)


def test_bootstrap_holds_the_point_value(spark):
    rng = np.random.default_rng(1)
    t = rng.integers(0, 7, 2000)
    p = np.clip(t + rng.integers(-1, 2, 2000), 0, 6)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "p": p}))
    ci = bootstrap.kappa_interval(df, replicates=300).first()
    assert ci["ci_low"] < kappa(t, p, 2) < ci["ci_high"]
    picks = [rng.integers(0, 2000, 2000) for _ in range(300)]
    plain = np.quantile([kappa(t[i], p[i], 2) for i in picks], [0.025, 0.975])
    assert ci["ci_low"] == pytest.approx(plain[0], abs=0.004)
    assert ci["ci_high"] == pytest.approx(plain[1], abs=0.004)


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_neighbours_both_ways(spark, block_rows):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(90, 6))
    vecs[10] = vecs[40] = vecs[70]
    vecs[5] = 0.0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id bigint, v array<double>")
    got = neighbours.nearest_neighbours(df.where("id < 20"), df.where("id >= 20"), "id", "v", 4, block_rows=block_rows)
    unit = vecs / np.where(np.linalg.norm(vecs, axis=1) == 0, 1, np.linalg.norm(vecs, axis=1))[:, None]
    sims = np.round(unit[:20] @ unit[20:].T, 9)
    for q in range(20):
        want = sorted(range(70), key=lambda j: (-sims[q, j], j + 20))[:4]
        mine = [r["neighbour"] for r in got.where(F.col("query") == q).orderBy("rank").collect()] if q < 3 or q in (5, 10) else None
        if mine is not None:
            assert mine == [j + 20 for j in want]
    assert got.count() == 80


def test_neighbours_of_text_keys(spark):
    rows = [(f"k{i:02d}", [1.0, float(i % 4)]) for i in range(40)] + [("none", None), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = neighbours.nearest_neighbours(df.where("id < 'k10'"), df.where("id >= 'k10' OR id IS NULL"), "id", "v", 2, block_rows=3)
    found = {(r["query"], r["rank"]): r["neighbour"] for r in got.collect()}
    assert len(found) == 20 and found["k00", 1] == "k12" and found["k00", 2] == "k16" and found["k03", 1] == "k11"


def test_preparation_of_rare_unknown_and_null(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array
    from hearthline.models import prep

    train = [(float(i % 5), "a'b" if i % 2 else "c", f"t{i % 30:02d}", None) for i in range(60)] + [(None, "rare", "t00", None)]
    schema = "n double, low string, high string, nothing double"
    fitted = prep.preparation(["n", "low", "high", "nothing"]).fit(spark.createDataFrame(train, schema))
    fitted.write().save(str(tmp_path / "prep"))
    rows = spark.createDataFrame([(None, "a'b", "t01", None), (4.0, "rare", "t29", 1.0), (2.0, "unseen", "unseen", None)], schema)
    for model in (fitted, PipelineModel.load(str(tmp_path / "prep"))):
        got = [r["x"] for r in model.transform(rows).select(vector_to_array("features").alias("x")).collect()]
        # n, nothing, low = a'b, low = c, rare levels, code of high
        assert got == [[0.0, 0.0, 1.0, 0.0, 0.0, 1.0], [1.0, 1.0, 0.0, 0.0, 1.0, 29.0], [0.0, 0.0, 0.0, 0.0, 0.0, -1.0]]


def test_rules_golden(spark):
    baskets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["a", "c"]), (4, ["b", "c"]), (5, ["a", "b", "c"])], "k int, items array<string>")
    sets = rules.frequent_itemsets(baskets, min_support=0.1)
    support = {tuple(r["itemset"]): r["support"] for r in sets.collect()}
    assert support[("a", "b")] == pytest.approx(0.6) and support[("a", "b", "c")] == pytest.approx(0.4)
    found = {(tuple(r["antecedent"]), tuple(r["consequent"])): r for r in rules.association_rules(sets, 0.0).collect()}
    assert found[(("a",), ("b", "c"))]["confidence"] == pytest.approx(0.5)
    assert found[(("a",), ("b", "c"))]["lift"] == pytest.approx(0.8333, abs=1e-4)
    assert len(found) == 3 * 2 + 6


def test_recommendation_quality(spark):
    actual = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["z"])], "query int, items array<string>")
    recs = spark.createDataFrame([(1, ["a", "b", "x", "y", "w"])], "query int, recs array<string>")
    r = rules.recommendation_quality(actual.where("query = 1"), recs).first()
    assert (r["hit_rate"], r["precision_at_n"], r["recall_at_n"]) == (1.0, pytest.approx(0.4), 0.5)
    assert rules.recommendation_quality(actual, recs).first()["queries"] == 2


def mixed(spark, n=120):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.normal()) if i % 3 else 0.5, float(rng.integers(0, 4)), "xyz"[i % 3], "pq"[i % 2], i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, c string, d string, cluster int")


def test_gower_and_silhouette(spark):
    df = mixed(spark)
    pdf = df.toPandas()
    n = len(pdf)
    dist = np.zeros((n, n))
    for col in "ab":
        v = pdf[col].to_numpy()
        dist += np.abs(v[:, None] - v[None, :]) / (v.max() - v.min())
    for col in "cd":
        v = pdf[col].to_numpy()
        dist += v[:, None] != v[None, :]
    dist /= 4
    lab = pdf["cluster"].to_numpy()
    want = []
    for i in range(n):
        means = [dist[i, (lab == c) & (np.arange(n) != i)].mean() for c in range(3)]
        a, b = means[lab[i]], min(m for c, m in enumerate(means) if c != lab[i])
        want.append((b - a) / max(a, b))
    got = G.silhouette(G.group_distances(df, "id", "cluster", ["a", "b"], ["c", "d"], [0, 1, 2], buckets=8), "id", "cluster", [0, 1, 2])
    assert [r["silhouette"] for r in got.orderBy("id").collect()] == pytest.approx(want)


def test_prototypes_cost_never_rises(spark):
    df = G.standardise(mixed(spark), ["a", "b"])
    model = G.fit_prototypes(df, ["a", "b"], ["c", "d"], 3, "id", max_rounds=6)
    path = model.cost_path
    assert all(x >= y - 1e-9 for x, y in zip(path, path[1:]))
    assert {r["cluster"] for r in model.assign(df).select("cluster").distinct().collect()} <= {0, 1, 2}


def test_spearman_and_cramer(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 300).astype(float), "b": rng.normal(size=300), "k": rng.integers(0, 2, 300), "m": rng.integers(0, 2, 300)})
    df = spark.createDataFrame(pdf)
    rho = spearman(df, ["a", "b"]).first()["rho"]
    assert rho == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()))
    o = pd.crosstab(pdf["k"], pdf["m"]).to_numpy().astype(float)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    chi2 = (np.maximum(np.abs(o - e) - 0.5, 0) ** 2 / e).sum()
    row = cramers_v(df, "k", "m").first()
    assert row["chi2"] == pytest.approx(chi2) and row["v"] == pytest.approx(np.sqrt(chi2 / 300))


def test_folds(spark):
    df = spark.range(1003).withColumn("y", (F.col("id") % 3).cast("string")).withColumn("g", F.when(F.col("id") % 5 != 0, F.col("id") % 40))
    sizes = L.stratified_folds(df, "y", "id").groupBy("y", "fold").count().toPandas()
    assert (sizes.groupby("y")["count"].max() - sizes.groupby("y")["count"].min()).max() <= 1
    folded = df.withColumn("fold", L.group_fold("g", "id"))
    assert folded.where("g IS NOT NULL").groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_threshold_search_against_brute_force(spark):
    rng = np.random.default_rng(6)
    probs = rng.dirichlet(np.ones(7) * 0.6, 80)
    t = np.clip(np.round(probs @ np.arange(7) + rng.normal(0, 0.7, 80)), 0, 6).astype(int)
    df = spark.createDataFrame([(int(a), [float(x) for x in p]) for a, p in zip(t, probs)], "t int, probs array<double>")
    cum = np.cumsum(probs, axis=1)

    def predict(th):
        hit = cum >= np.array(th)
        return np.where(hit.any(1), hit.argmax(1), 6)

    best, q = [0.5] * 7, kappa(t, predict([0.5] * 7), 2)
    for k in range(7):
        for cand in tuning.GRID:
            trial = best[:k] + [cand] + best[k + 1 :]
            v = kappa(t, predict(trial), 2)
            if v is not None and v > q + 1e-5:
                best, q = trial, v
    got, got_q = tuning.tune_thresholds(df, "probs", "t", sweeps=1)
    assert got == best and got_q == pytest.approx(q)


def test_level_codes_and_shuffle(spark):
    words = [f"w{i % 37:02d}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(words)), "id int, w string")
    codes = {r["level"]: r["code"] for r in prep.level_codes(df, "w", buckets=5).collect()}
    assert codes == {w: i for i, w in enumerate(sorted(set(words)))}
    dealt = shuffled_column(df, "w", "id", 3).toPandas()
    assert sorted(dealt["_new"]) == sorted(words) and len(dealt) == 400
    assert (dealt.sort_values("id")["_new"].to_numpy() != np.array(words)).mean() > 0.8


def test_differences(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert tuple(checks.table_differences(a, b).first()) == (1, 1)


def test_decile_bins_half_open(spark):
    df = spark.range(9).select(F.col("id").cast("double").alias("v"))
    bins = [r["bin"] for r in E.with_quantile_bin(df, "v", 4).orderBy("v").collect()]
    assert bins == [0, 0, 1, 1, 2, 2, 3, 3, 3]


def test_measure_names_in_summary(spark):
    from hearthline.operators.summary import measure_summary

    df = spark.createDataFrame([("x", "£10"), ("x", "£20 - £40"), (None, "n/a"), (None, "£5")], "IMPROVEMENT_SUMMARY_TEXT string, INDICATIVE_COST string")
    got = {r["measure"]: r for r in measure_summary(df).collect()}
    assert got[None]["count"] == 2 and got[None]["cost_mid_median"] == 5
    assert got["x"]["cost_high_median"] == 25 and got["x"]["cost_mid_mean"] == 20
    assert S is not None


def test_scratch_folder_needs_a_setting_on_a_cluster():
    from hearthline.session import require_local

    require_local("local[4]")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            require_local(master)


def test_metrics_leave_out_null_scores(spark):
    from hearthline.operators.evaluation import reliability, segment_metrics

    rows = spark.createDataFrame([("a", 80, 70), ("a", None, 60), ("a", 50, None)], "s string, t int, p int")
    got = segment_metrics(rows, "s", "t", "p", min_support=1).first()
    assert (got.n, got.mae, got.rmse) == (1, 10.0, 10.0)
    bins = reliability(spark.createDataFrame([(1, 0.05), (0, None), (None, 0.5)], "y int, p double"), "y", "p").collect()
    assert [(r.bin, r.n) for r in bins] == [(0, 1)]


def test_small_pieces_send_no_row_more_often(spark, monkeypatch):
    """The piece that is multiplied at a time does not decide how often a row travels; floats travel as floats."""
    sent = []
    whole = neighbours.block_products

    def seen(left, right, *rest):
        sent.append((left.count(), right.count(), left.schema["vec"].dataType.simpleString()))
        return whole(left, right, *rest)

    monkeypatch.setattr(neighbours, "block_products", seen)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(120)], "id long, v array<float>")
    sides = (df.where("id < 40"), df.where("id >= 40"), "id", "v", 3)
    large, small = (neighbours.nearest_neighbours(*sides, **o).orderBy("query", "rank").collect() for o in ({}, {"block_bytes": 24 * 5}))
    assert large == small and len(small) == 120
    cores = spark.sparkContext.defaultParallelism
    assert sent == [(40 * cores, 80, "array<float>")] * 2

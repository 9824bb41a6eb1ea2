"""The ordinal model against numeric gradients, and permuted columns against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hearthline.models import explain
from hearthline.models.ordinal import fit_ordinal, sums


def test_sums_against_numeric_gradient():
    rng = np.random.default_rng(1)
    x, codes = rng.normal(size=(30, 3)), rng.integers(0, 4, 30)
    at = rng.normal(size=6)

    def f(v):
        return sums(x, codes, v[:3], v[3:])

    _, gradient, hessian = f(at)
    for i in range(6):
        step = np.eye(6)[i] * 1e-5
        assert abs((f(at + step)[0] - f(at - step)[0]) / 2e-5 - gradient[i]) < 1e-5
        assert np.abs((f(at + step)[1] - f(at - step)[1]) / 2e-5 - hessian[i]).max() < 1e-5


@pytest.mark.parametrize("held", [False, True])
def test_ordinal_fit_finds_the_weights(spark, held):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    latent = x @ [2.0, -1.0] + rng.logistic(size=4000)
    codes = np.searchsorted([-2.0, 0.0, 1.5], latent)
    frame = pd.DataFrame({"x": x.tolist(), "label": codes.astype(float), "is_validation": rng.random(4000) < (0.2 if held else 0.0)})
    df = spark.createDataFrame(frame).withColumn("features", array_to_vector("x"))
    model = fit_ordinal(df, classes=4)
    assert np.abs(model.weights - [2.0, -1.0]).max() < 0.2 and np.abs(model.thresholds - [-2.0, 0.0, 1.5]).max() < 0.25
    out = model.predict(df).select("exceed", "predicted_code", "label").toPandas()
    exceed = np.stack(out["exceed"].to_numpy())
    assert (np.diff(exceed, axis=1) <= 0).all()
    assert (out["predicted_code"] == (exceed > 0.5).sum(axis=1)).all()
    # as good as the weights that made the labels
    true_codes = ((x @ [2.0, -1.0])[:, None] > [-2.0, 0.0, 1.5]).sum(axis=1)
    assert (out["predicted_code"] == out["label"]).mean() > (true_codes == codes).mean() - 0.01


def test_permuted_positions_are_bijections():
    for n in [*range(1, 60), 1000, 4097]:
        for key in (0, 1, explain.variant_key(42, "f", 3)):
            got = explain.permuted_positions(np.arange(n), n, key)
            assert sorted(got) == list(range(n))
    moved = explain.permuted_positions(np.arange(5000), 5000, 7)
    assert (moved == np.arange(5000)).mean() < 0.01 and abs(np.corrcoef(moved, np.arange(5000))[0, 1]) < 0.06


def test_importance_against_brute_force(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"id": np.arange(300), "a": rng.normal(size=300), "b": rng.choice(["x", "y", "z"], 300), "c": rng.integers(0, 9, 300)})
    frame.loc[::7, "b"] = None
    frame["t"] = (np.digitize(frame["a"], [-1, 0, 1]) + (frame["b"] == "x")).astype(int)
    df = spark.createDataFrame(frame)
    df = df.withColumn("b", F.when(F.col("b") != "NaN", F.col("b")))
    code = F.expr("IF(a >= -1, 1, 0) + IF(a >= 0, 1, 0) + IF(a >= 1, 1, 0) + IF(b <=> 'x', 1, 0)")
    variants = explain.permuted_variants(df, ["a", "b", "c"], "id", 3, 42).toPandas()
    assert len(variants) == 300 * 10
    own = variants[variants["feature"] == ""].sort_values("id")
    for f in ("a", "b", "c"):
        for r in range(3):
            one = variants[(variants["feature"] == f) & (variants["repeat"] == r)].sort_values("id")
            assert sorted(one[f].astype(str)) == sorted(own[f].astype(str)) and list(one[f].astype(str)) != list(own[f].astype(str))
            for other in {"a", "b", "c", "t"} - {f}:
                assert list(one[other].astype(str)) == list(own[other].astype(str))

    def qwk(t, p):
        t, p = np.asarray(t), np.asarray(p)
        w = (np.arange(7)[:, None] - np.arange(7)) ** 2
        o = np.zeros((7, 7))
        np.add.at(o, (t, p), 1)
        return 1 - (w * o).sum() / (w * np.outer(o.sum(1), o.sum(0)) / o.sum()).sum()

    got = {r["feature"]: r for r in explain.permutation_importance(df, ["a", "b", "c"], "id", lambda x: x.withColumn("p", code), repeats=3).collect()}
    for f in ("a", "b", "c"):
        drops = []
        for r in range(3):
            one = variants[(variants["feature"] == f) & (variants["repeat"] == r)]
            p = np.digitize(one["a"], [-1, 0, 1]) + (one["b"] == "x")
            drops.append(1.0 - qwk(one["t"], p))
        assert abs(got[f]["importance_mean"] - np.mean(drops)) < 1e-9 and abs(got[f]["importance_std"] - np.std(drops)) < 1e-9
    assert got["a"]["importance_mean"] > got["b"]["importance_mean"] > got["c"]["importance_mean"] == 0

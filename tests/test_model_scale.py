"""What keeps the fits of the model queries within time: inputs worked out once, rows that keep their nodes."""

from __future__ import annotations

import datetime as dt

import pytest

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hearthline.models import estimators as M
from hearthline.models.histogram_boost import Settings
from hearthline.queries import q_models

N = 400


def test_rows_keep_their_nodes_and_the_forest_stays(spark):
    rows = spark.range(N, numPartitions=2).select(
        array_to_vector(F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20)).cast("double") for i in range(5)])).alias("features"),
        F.pmod(F.xxhash64("id"), F.lit(3)).cast("double").alias("label"), F.lit(1.0).alias("weight"))
    assert M.random_forest().getCacheNodeIds()
    kept, walked = (M.random_forest(8, maxDepth=6, **kw).fit(rows) for kw in ({}, {"cacheNodeIds": False}))
    assert kept.toDebugString.split("\n", 1)[1] == walked.toDebugString.split("\n", 1)[1]


def test_frame_works_out_its_inputs_once(spark, tmp_path):
    day = dt.datetime(1999, 1, 1)
    orders = [(i, None if i % 9 == 0 else i % 40, "FOP"[i % 3], None if i % 50 == 0 else 1000.0 * (i % 300), day + dt.timedelta(days=3 * i), "1-URGENT") for i in range(N)]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders + orders[:5], schema).write.parquet(f"{tmp_path}/orders.parquet")
    frame = q_models._frame(spark, str(tmp_path))
    # the given table is not read again: neither per side of the split nor by later steps
    assert not any("orders.parquet" in f for f in frame.inputFiles())
    plain = q_models.featuring.engineer(q_models.certificates(spark, str(tmp_path)).where(F.col(q_models.C.TARGET).isin(*q_models.C.BANDS)))
    plain = q_models.scoring.training_frame(plain, q_models.FEATURES, cutoff=q_models.CUT)
    got = frame.drop("label", "t")
    assert got.columns == plain.columns
    assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0 < got.count()


def test_joint_classifier_boosts_to_the_end(spark, monkeypatch):
    """The registered query runs the operator's own rounds, leaves and rate, not fewer."""
    rows = spark.createDataFrame([("A", "train", 1.0), ("C", "test", 2.0)], "label_band string, split string, a double")
    asked = []

    class Asked(Exception):
        pass

    def fit(train, features, label, classes=None, settings=None):
        asked.append((train.count(), features, classes, settings or Settings()))
        raise Asked

    monkeypatch.setattr(q_models, "_matrix", lambda *_: (rows, ["a"]))
    monkeypatch.setattr(q_models, "fit_boosted", fit)
    with pytest.raises(Asked):
        q_models.mdl7_joint(spark, "")
    assert asked == [(1, ["a"], len(q_models.C.BANDS), Settings(rounds=100, leaves=31, rate=0.07))]

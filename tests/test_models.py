"""Registered model queries fit what their operators stand for."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import GBTRegressor

from hearthline.models import estimators as M
from hearthline.queries import q_models


class Reached(Exception):
    pass


@pytest.mark.parametrize(
    ("run", "kind", "whole", "names"),
    [
        (q_models.mdl3, RandomForestClassifier, M.random_forest, ("numTrees", "maxDepth")),
        (q_models.mdl6, GBTRegressor, M.score_regressor, ("maxIter", "maxDepth")),
    ],
)
def test_operator_defaults(spark, monkeypatch, run, kind, whole, names):
    def fit(model, train):
        raise Reached({n: model.getOrDefault(n) for n in names})

    monkeypatch.setattr(q_models, "_sides", lambda spark, d: (None, None))
    monkeypatch.setattr(kind, "fit", fit)
    with pytest.raises(Reached) as got:
        run(spark, "")
    assert got.value.args[0] == {n: whole().getOrDefault(n) for n in names}

"""Saving a fitted model beside the columns it expects."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from hearthline.models.routed import RoutedModel


def save_model(spark: SparkSession, path: str, preparation: PipelineModel, model: RoutedModel, frame: DataFrame, columns: list[str]) -> None:
    """Preparation, both models, and the feature contract as one JSON record."""
    preparation.write().save(f"{path}/preparation")
    model.general.write().save(f"{path}/general")
    model.specialist.write().save(f"{path}/specialist")
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    contract = {"features": [[c, kinds[c]] for c in columns], "cohort": model.cohort, "special": model.special}
    spark.createDataFrame([(json.dumps(contract),)], "contract string").coalesce(1).write.text(f"{path}/contract")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, RoutedModel, dict[str, str]]:
    from pyspark.ml.regression import GBTRegressionModel

    contract = json.loads(spark.read.text(f"{path}/contract").first()[0])
    model = RoutedModel(
        GBTRegressionModel.load(f"{path}/general"), GBTRegressionModel.load(f"{path}/specialist"),
        contract["cohort"], contract["special"],
    )
    return PipelineModel.load(f"{path}/preparation"), model, dict(contract["features"])

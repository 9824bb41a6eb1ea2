"""From certificates to a scored table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.models.prep import ready
from hearthline.models.routed import RoutedModel
from hearthline.operators.roles import conform
from hearthline.operators.splits import group_temporal_split

IDENTITY = (C.ID, C.DWELLING, C.DATE)


def training_frame(df: DataFrame, columns: list[str], *, cutoff: str = C.CUTOFF, split: str = "split") -> DataFrame:
    """Identity, cohort, labels, split and the prepared feature columns."""
    labelled = group_temporal_split(df, cutoff, name=split).withColumns(
        {"label_score": F.col(C.SCORE).cast("double"), "label_band": F.col(C.TARGET)}
    )
    keep = [c for c in dict.fromkeys([*IDENTITY, C.COHORT, "label_score", "label_band", split]) if c not in columns]
    return ready(labelled.select(*keep, *columns), columns)


def predict_table(frame: DataFrame, preparation: PipelineModel, model: RoutedModel, columns: list[str]) -> DataFrame:
    """One row per certificate: truth, prediction, confidence and split."""
    keep = [c for c in frame.columns if c not in columns]
    scored = model.predict_band(preparation.transform(conform(frame, columns, keep)))
    return scored.select(
        C.ID,
        F.col(C.DWELLING).cast("string").alias(C.DWELLING),
        C.DATE,
        F.col(C.COHORT).cast("int").alias(C.COHORT),
        F.col("label_band").alias("actual_band"),
        F.col("label_score").alias("actual_sap_score"),
        F.bround("predicted_score", 2).alias("predicted_sap_score"),
        "predicted_band",
        (F.col("label_band") == F.col("predicted_band")).alias("band_correct"),
        F.bround(F.abs(F.col("label_score") - F.col("predicted_score")), 2).alias("abs_score_error"),
        F.bround(S.confidence_proxy(F.col("predicted_score")), 3).alias("confidence_proxy"),
        # the whole corpus is scored: what is not held out counts as train
        F.when(F.col("split") == "test", "test").otherwise("train").alias("split"),
    )

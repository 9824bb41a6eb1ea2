"""Score model with a specialist for one cohort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.models.estimators import fit_early_stopped, score_regressor


def predict_as(model: Model, df: DataFrame, name: str) -> DataFrame:
    return model.copy({model.predictionCol: name}).transform(df)


@dataclass(frozen=True)
class RoutedModel:
    """``general`` serves every row except those of the specialist cohort."""

    general: Model
    specialist: Model
    cohort: str = C.COHORT
    special: int = C.SPECIALIST_COHORT

    def predict_score(self, df: DataFrame, name: str = "predicted_score") -> DataFrame:
        both = predict_as(self.specialist, predict_as(self.general, df, "_general"), "_special")
        route = F.when(F.col(self.cohort) == self.special, F.col("_special")).otherwise(F.col("_general"))
        return both.withColumn(name, S.clip_score(route)).drop("_general", "_special")

    def predict_band(self, df: DataFrame, name: str = "predicted_band", score: str = "predicted_score") -> DataFrame:
        return self.predict_score(df, score).withColumn(name, S.score_to_band(F.col(score)))


def fit_routed(
    train: DataFrame,
    *,
    cohort: str = C.COHORT,
    special: int = C.SPECIALIST_COHORT,
    label: str = "label_score",
    is_validation: str | None = None,
    min_special: int = 500,
    trees: int = 100,
    weight: str | None = None,
    **kw,
) -> RoutedModel:
    """One model on all rows, one on the specialist cohort; with a validation mask both stop early."""
    own = train.where(F.col(cohort) == special)
    found = own.limit(min_special).count()
    if found < min_special:
        raise ValueError(f"cohort {special} has {found} training rows, at least {min_special} are needed")

    def fit(rows: DataFrame, w: str | None) -> Model:
        if is_validation:
            return fit_early_stopped(rows, is_validation, trees, label, weight=w, **kw)
        return score_regressor(trees, label, w, **kw).fit(rows)

    # the specialist is weighted only when it stops early, like the general model
    return RoutedModel(fit(train, weight), fit(own, weight if is_validation else None), cohort, special)


def fit_per_cohort(
    train: DataFrame, cohorts: list, *, cohort: str = C.COHORT, label: str = "label_score", min_rows: int = 500, trees: int = 100, **kw
) -> dict:
    """A model per cohort with enough rows, under ``None`` the model of all rows. ``cohorts`` is a short fixed list."""
    sizes = {r[cohort]: r["n"] for r in train.where(F.col(cohort).isin(*cohorts)).groupBy(cohort).agg(F.count(F.lit(1)).alias("n")).collect()}
    models = {None: score_regressor(trees, label, **kw).fit(train)}
    for c in cohorts:
        if sizes.get(c, 0) >= min_rows:
            models[c] = score_regressor(trees, label, **kw).fit(train.where(F.col(cohort) == c))
    return models


def predict_per_cohort(df: DataFrame, models: dict, cohort: str = C.COHORT, name: str = "predicted_score") -> DataFrame:
    out = predict_as(models[None], df, "_m")
    route: Column = F.col("_m")
    own = [c for c in models if c is not None]
    for i, c in enumerate(own):
        out = predict_as(models[c], out, f"_m{i}")
        route = F.when(F.col(cohort) == c, F.col(f"_m{i}")).otherwise(route)
    return out.withColumn(name, S.clip_score(route)).drop("_m", *[f"_m{i}" for i in range(len(own))])

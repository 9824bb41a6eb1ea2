"""Estimators over an assembled feature vector, and simple baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.functions.hashing import uniform
from hearthline.operators.joins import with_lookup_median

K = len(C.BANDS)
SEED = 42


def logistic(weight: str | None = "weight", label: str = "label", features: str = "features", max_iter: int = 100):
    model = LogisticRegression(labelCol=label, featuresCol=features, maxIter=max_iter, family="multinomial")
    return model.setWeightCol(weight) if weight else model


def random_forest(trees: int = 400, weight: str | None = "weight", label: str = "label", **kw):
    """Each row keeps its node in every tree: the same forest, but no pass walks all rows down from the roots again."""
    options = {"maxDepth": 12, "minInstancesPerNode": 2, "cacheNodeIds": True, "seed": SEED, **kw}
    model = RandomForestClassifier(labelCol=label, numTrees=trees, **options)
    return model.setWeightCol(weight) if weight else model


def shallow_tree(depth: int = 5, label: str = "label", **kw):
    return DecisionTreeClassifier(labelCol=label, maxDepth=depth, seed=SEED, **kw)


def score_regressor(trees: int = 100, label: str = "label_score", weight: str | None = None, **kw) -> GBTRegressor:
    """Boosted trees on the score; depth 6 stands for up to 63 leaves."""
    options = {"stepSize": 0.07, "maxDepth": 6, "minInstancesPerNode": 20, "seed": SEED, **kw}
    model = GBTRegressor(labelCol=label, maxIter=trees, **options)
    return model.setWeightCol(weight) if weight else model


def boosted_classifier(trees: int = 50, label: str = "label", weight: str | None = "weight", parallelism: int = 4, **kw):
    """One boosted binary model per class; Spark's boosted classifier is binary."""
    options = {"stepSize": 0.07, "maxDepth": 5, "minInstancesPerNode": 20, "seed": SEED, **kw}
    one = GBTClassifier(maxIter=trees, **options)
    model = OneVsRest(classifier=one, labelCol=label, parallelism=parallelism)
    return model.setWeightCol(weight) if weight else model


def class_probabilities(scored: DataFrame, name: str = "probs", source: str = "probability") -> DataFrame:
    return scored.withColumn(name, vector_to_array(source))


# --- baselines ------------------------------------------------------------------------------------


def class_shares(train: DataFrame, label: str) -> DataFrame:
    return train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def most_frequent(df: DataFrame, train: DataFrame, label: str, name: str = "prediction") -> DataFrame:
    """Predict the commonest training class; the smaller label wins a tie."""
    top = class_shares(train, label).agg(F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label)))).scalar()
    return df.withColumn(name, top)


def stratified_random(
    df: DataFrame, train: DataFrame, label: str, id_col: str, domain: list, seed: int | str = SEED, name: str = "prediction"
) -> DataFrame:
    """Draw a class by its training share, keyed by the row id."""
    counts = train.agg(*[F.count_if(F.col(label) == v).alias(f"c{i}") for i, v in enumerate(domain)])
    packed = counts.select(F.struct(*counts.columns)).scalar()
    held = df.withColumn("_c", packed).withColumn("_u", uniform(seed, F.col(id_col)))
    total = reduce(lambda a, b: a + b, [F.col(f"_c.c{i}") for i in range(len(domain))])
    pick: Column = F.lit(domain[-1])
    for i in reversed(range(len(domain) - 1)):
        below = reduce(lambda a, b: a + b, [F.col(f"_c.c{j}") for j in range(i + 1)])
        pick = F.when(F.col("_u") * total < below, F.lit(domain[i])).otherwise(pick)
    return held.withColumn(name, pick).drop("_c", "_u")


def lookup_heuristic(
    df: DataFrame, train: Column, age: str = "CONSTRUCTION_AGE_NUM", walls: str = "WALLS_DESCRIPTION", score: str = C.SCORE
) -> DataFrame:
    """Median training score per (era, wall type), as a band."""
    keyed = df.withColumns(
        {"era": S.era(F.col(age), C.ERA_RIGHT_CLOSED, True, "nan"), "wall": S.wall_type(F.col(walls))}
    )
    scored = with_lookup_median(keyed, train, ["era", "wall"], score, "predicted_score", bounded=True)
    return scored.withColumn("predicted_band", S.score_to_band(F.col("predicted_score")))


# --- early stopping -------------------------------------------------------------------------------


def fit_early_stopped(
    train: DataFrame, is_validation: str = "is_validation", trees: int = 200, label: str = "label_score",
    min_rows: int = 50, floor: int = 20, **kw
) -> GBTRegressionModel:
    """Find the best number of trees on the newest slice, then refit on all rows with it."""
    sides = train.agg(F.count_if(F.col(is_validation)).alias("v"), F.count_if(~F.col(is_validation)).alias("c")).first()
    full = score_regressor(trees, label, **kw)
    if sides["v"] < min_rows or sides["c"] < min_rows:
        return full.fit(train)
    core = score_regressor(trees, label, **kw).fit(train.where(~F.col(is_validation)))
    errors = core.evaluateEachIteration(train.where(F.col(is_validation)), "squared")
    best = min(range(len(errors)), key=lambda i: errors[i]) + 1
    return score_regressor(max(best, min(floor, trees)), label, **kw).fit(train)


# --- ordinal decomposition ------------------------------------------------------------------------


def fit_exceedance(train: DataFrame, code: str = "label", features: str = "features", max_iter: int = 50) -> list[Model | float]:
    """K-1 binary models for P(class > k); a constant target keeps its constant."""
    shares = train.agg(*[F.avg((F.col(code) > k).cast("double")).alias(f"s{k}") for k in range(K - 1)]).first()
    fitted: list[Model | float] = []
    for k in range(K - 1):
        share = shares[f"s{k}"] or 0.0
        if share in (0.0, 1.0):
            fitted.append(share)
            continue
        rows = train.withColumn("_target", (F.col(code) > k).cast("double"))
        fitted.append(LogisticRegression(labelCol="_target", featuresCol=features, maxIter=max_iter, regParam=0.01).fit(rows))
    return fitted


def predict_exceedance(df: DataFrame, heads: list[Model | float], name: str = "exceed") -> DataFrame:
    out, parts = df, []
    for k, head in enumerate(heads):
        if isinstance(head, float):
            parts.append(F.lit(head))
            continue
        own = head.copy({head.probabilityCol: f"_p{k}", head.rawPredictionCol: f"_r{k}", head.predictionCol: f"_y{k}"})
        out = own.transform(out)
        parts.append(vector_to_array(F.col(f"_p{k}"))[1])
    temporary = [c for k in range(len(heads)) for c in (f"_p{k}", f"_r{k}", f"_y{k}")]
    scored = out.withColumn(name, F.array(*parts)).drop(*temporary)
    return scored.withColumn("predicted_code", S.rank_class(F.col(name)))


# --- calibration ----------------------------------------------------------------------------------


def fit_isotonic(out_of_fold: DataFrame, probs: str = "probs", label: str = "label", classes: int = K) -> list[Model]:
    """One monotone map per class from out-of-fold probability to observed share."""
    return [
        IsotonicRegression(labelCol="_target", featuresCol="_p").fit(
            out_of_fold.select(F.col(probs)[k].alias("_p"), (F.col(label) == k).cast("double").alias("_target"))
        )
        for k in range(classes)
    ]


def apply_isotonic(df: DataFrame, maps: list[Model], probs: str = "probs", name: str = "calibrated") -> DataFrame:
    """Calibrate every class and scale to sum 1; all zero falls back to equal shares."""
    out = df
    for k, m in enumerate(maps):
        out = m.copy({m.featuresCol: f"_f{k}", m.predictionCol: f"_i{k}"}).transform(out.withColumn(f"_f{k}", F.col(probs)[k]))
    raw = F.array(*[F.col(f"_i{k}") for k in range(len(maps))])
    held = out.withColumn("_raw", raw).withColumn("_sum", F.aggregate("_raw", F.lit(0.0), lambda a, v: a + v))
    equal = F.lit(1.0 / len(maps))
    scaled = F.transform("_raw", lambda v: F.when(F.col("_sum") > 0, v / F.col("_sum")).otherwise(equal))
    return held.withColumn(name, scaled).drop("_raw", "_sum", *[f"{p}{k}" for k in range(len(maps)) for p in ("_f", "_i")])

"""Bootstrap intervals over counted cells.

A resample only enters a metric through the counts of its cells, so rows are
counted once and each replicate draws one Poisson count per cell (the Poisson
bootstrap of Chamandy et al., 2012). Work after the count does not depend on
the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from hearthline.functions.hashing import poisson_count
from hearthline.operators.evaluation import classification_metrics, confusion_cells, per_class_metrics
from hearthline.operators.orderstats import exact_percentiles


def replicate_cells(cells: DataFrame, keys: list[str], replicates: int, seed: int | str) -> DataFrame:
    """Every cell once per replicate with its drawn weight ``w``."""
    drawn = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    keyed = [F.col("replicate"), *[F.col(k) for k in keys]]
    return drawn.withColumn("w", poisson_count(F.col("n").cast("double"), seed, *keyed))


def interval(samples: DataFrame, value: str, by: Iterable[str] = (), level: float = 0.95) -> DataFrame:
    """Mean, percentile interval and width; one row per replicate goes in."""
    by = list(by)
    tail = (1.0 - level) / 2.0
    ends = exact_percentiles(samples, value, {"ci_low": tail, "ci_high": 1.0 - tail}, by, bounded=True)
    means = samples.groupBy(*by).agg(F.avg(value).alias("mean"))
    if by:
        joined = means.join(ends, by)
    else:
        joined = ends.withColumn("mean", means.scalar())
    return joined.select(*by, "mean", "ci_low", "ci_high", (F.col("ci_high") - F.col("ci_low")).alias("ci_width"))


def per_class_f1_interval(
    df: DataFrame, true: str = "t", pred: str = "p", replicates: int = 1000, seed: int | str = 42
) -> DataFrame:
    cells = replicate_cells(confusion_cells(df, true, pred), ["t", "p"], replicates, seed)
    samples = per_class_metrics(cells, ["replicate"], n="w")
    return interval(samples, "f1", ["band"])


def kappa_interval(
    df: DataFrame, true: str = "t", pred: str = "p", replicates: int = 1000, seed: int | str = 42
) -> DataFrame:
    cells = replicate_cells(confusion_cells(df, true, pred), ["t", "p"], replicates, seed)
    return interval(classification_metrics(cells, ["replicate"], n="w", metrics=["qwk"]), "qwk")


def score_intervals(
    df: DataFrame, y: str = "y", yhat: str = "yhat", replicates: int = 1000, seed: int | str = 42, digits: int = 2
) -> DataFrame:
    """R2 and RMSE intervals; pairs of scores are counted at ``digits`` decimals,
    so a bounded score scale has a bounded number of cells.
    """
    pairs = (
        df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
        .groupBy(F.round(y, digits).alias("y"), F.round(yhat, digits).alias("yhat"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w, err = F.col("w"), F.col("yhat") - F.col("y")
    drawn = replicate_cells(pairs, ["y", "yhat"], replicates, seed)
    n, sy = F.sum(w), F.sum(w * F.col("y"))
    res = F.sum(w * err * err)
    tot = F.sum(w * F.col("y") * F.col("y")) - sy * sy / n
    samples = drawn.groupBy("replicate").agg(
        (F.lit(1.0) - F.try_divide(res, tot)).alias("r2"), F.sqrt(F.try_divide(res, n.cast("double"))).alias("rmse")
    )
    long = samples.unpivot(["replicate"], ["r2", "rmse"], "metric", "value")
    return interval(long, "value", ["metric"])


def decide_next_best(champion: DataFrame, rivals: DataFrame, name: str = "name", metric: str = "qwk") -> DataFrame:
    """Is the best rival below the champion's lower confidence bound?"""
    best = rivals.agg(F.max(F.struct(F.col(metric), F.col(name)))).scalar()
    return champion.withColumn("_best", best).select(
        F.col(f"_best.{name}").alias("next_best"),
        F.col(f"_best.{metric}").alias("next_best_value"),
        "ci_low",
        (F.col(f"_best.{metric}") < F.col("ci_low")).alias("below_lower_bound"),
    )

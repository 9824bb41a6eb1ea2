"""Equi joins between certificates, recommendations, lookups and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthline import config as C
from hearthline.operators.orderstats import exact_percentiles
from hearthline.operators.skew import attach_by_key


def of_kept_certificates(recs: DataFrame, kept: DataFrame, key: str = C.ID) -> DataFrame:
    """Recommendation rows whose certificate is kept."""
    return recs.join(kept.select(key), key, "left_semi")


def with_attribute(predictions: DataFrame, attributes: DataFrame, key: str = C.ID) -> DataFrame:
    """Predictions with attribute columns; unmatched or incomplete rows are dropped."""
    cols = [c for c in attributes.columns if c != key]
    return predictions.join(attributes, key, "left").dropna(subset=cols)


def with_basket(rows: DataFrame, baskets: DataFrame, key: str = C.ID, items: str = "items") -> DataFrame:
    return rows.join(baskets, key, "inner").where(F.size(items) > 0)


def with_lookup_median(
    df: DataFrame, train: Column, keys: list[str], score: str, name: str = "lookup", *, bounded: bool = False
) -> DataFrame:
    """Train median of the row's cell, else the train median of all rows."""
    learn = df.where(train)
    cells = exact_percentiles(learn, score, {name: 0.5}, keys, bounded=bounded)
    fallback = exact_percentiles(learn, score, {"_all": 0.5}, bounded=bounded).scalar()
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    table = sizes.join(cells, keys, "left")
    return attach_by_key(df, table, keys, "_rows").withColumn(name, F.coalesce(name, fallback))

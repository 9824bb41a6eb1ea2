"""One certificate per dwelling."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from hearthline import config as C
from hearthline.operators.repair import present


def completeness(cols: Iterable[str]) -> Column:
    """How many of the columns are filled."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols], F.lit(0))


def packed_order(df: DataFrame, score: Column | None, date: str, id_col: str) -> Column:
    """Score, date and whole-number id as one decimal that compares like the three in turn; a missing date is the earliest.

    A decimal has a fixed width, so its maximum is kept in a hash map of the keys. Days take 22 bits (the years from -3700 on), an int score 36 bits,
    the id 20 digits.
    """
    days = F.coalesce(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).cast("bigint") + F.lit(1 << 21), F.lit(0).cast("bigint"))
    if score is not None:
        days = days + (score.cast("bigint") + F.lit(1 << 35)) * F.lit(1 << 22)
    own = F.col(id_col).cast("decimal(19,0)") + F.lit(str(1 << 63)).cast("decimal(19,0)")
    return (days.cast("decimal(18,0)") * F.lit(str(10**20)).cast("decimal(21,0)") + own).cast("decimal(38,0)")


def best_per_key(df: DataFrame, key: str, date: str, id_col: str, score: Column | None = None) -> DataFrame:
    """The row with the largest (score, date, id) per key; rows without a key all stay.

    Only key, order and id enter the aggregation, which is a hash aggregation before and after the shuffle where ids are whole numbers; a hot
    key sends one value per map task. Rows come back by a semi join on the id, which is taken to name one row: rows that share key, order and id all stay.
    """
    keyed = df.where(F.col(key).isNotNull())
    if isinstance(df.schema[id_col].dataType, IntegralType):
        best = keyed.groupBy(key).agg(F.max(packed_order(df, score, date, id_col)).alias("_best"))
        own = F.col("_best") % F.lit(str(10**20)).cast("decimal(21,0)") - F.lit(str(1 << 63)).cast("decimal(19,0)")
        winners = best.select(key, own.cast(df.schema[id_col].dataType).alias(id_col))
    else:
        order = ([score.alias("s")] if score is not None else []) + [F.col(date).alias("d"), F.col(id_col).alias("i")]
        winners = keyed.groupBy(key).agg(F.max(F.struct(*order)).alias("_best")).select(key, F.col("_best.i").alias(id_col))
    return keyed.join(winners, [key, id_col], "left_semi").select(*df.columns).unionByName(df.where(F.col(key).isNull()))


def latest_per_key(df: DataFrame, key: str = C.DWELLING, date: str = C.DATE, id_col: str = C.ID) -> DataFrame:
    return best_per_key(df, key, date, id_col)


def quality_score(date: str = C.DATE, core: Iterable[str] = C.ROLES["core"]) -> Column:
    """Ten points per year after 2007, one per filled core field."""
    return (F.coalesce(F.year(date), F.lit(2007)) - 2007) * 10 + completeness(core)


def best_quality_per_key(
    df: DataFrame,
    key: str = C.DWELLING,
    date: str = C.DATE,
    id_col: str = C.ID,
    core: Iterable[str] = C.ROLES["core"],
) -> DataFrame:
    """Newest year first, then the better filled certificate, then date and id."""
    return best_per_key(df, key, date, id_col, quality_score(date, present(df, core)))

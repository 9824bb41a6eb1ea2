"""Splits by time and dwelling, folds, samples and row weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline import config as C
from hearthline.functions.hashing import hash32, uniform
from hearthline.operators.orderstats import hash_positions, value_positions
from hearthline.operators.skew import attach_by_key


def temporal_split(date: str = C.DATE, cutoff: str = C.CUTOFF) -> Column:
    """train up to the cutoff, test after it, null for an unknown date."""
    limit = F.lit(cutoff).cast("date")
    return F.when(F.col(date) <= limit, "train").when(F.col(date) > limit, "test")


def with_group_max(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Largest value of the row's group; null for rows without a key."""
    per_key = (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(name), F.count(F.lit(1)).alias("_rows"))
    )
    return attach_by_key(df, per_key, [key], "_rows")


def group_temporal_split(
    df: DataFrame,
    cutoff: str = C.CUTOFF,
    date: str = C.DATE,
    key: str = C.DWELLING,
    id_col: str = C.ID,
    name: str = "split",
) -> DataFrame:
    """Train keeps whole dwellings last seen up to the cutoff; test keeps the last
    certificate of the others; everything else is ``discard``. Rows without a
    dwelling key go by their own date.
    """
    keyed = df.where(F.col(key).isNotNull())
    dated = F.when(F.col(date).isNotNull(), F.struct(F.col(date).alias("d"), F.col(id_col).alias("i")))
    per_key = keyed.groupBy(key).agg(F.max(dated).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    limit = F.lit(cutoff).cast("date")
    own = (
        F.when(F.col("_last.d") <= limit, "train")
        .when((F.col("_last.d") > limit) & (F.col("_last.i") == F.col(id_col)), "test")
        .otherwise("discard")
    )
    with_key = attach_by_key(keyed, per_key, [key], "_rows").withColumn(name, own).drop("_last")
    without = df.where(F.col(key).isNull()).withColumn(
        name, F.coalesce(temporal_split(date, cutoff), F.lit("discard"))
    )
    return with_key.unionByName(without)


def stratified_folds(df: DataFrame, stratum: str, id_col: str, k: int = 5, seed: int | str = 42) -> DataFrame:
    """Folds of equal size inside every stratum."""
    placed = hash_positions(df, id_col, seed, [stratum])
    return placed.withColumn("fold", F.pmod(F.col("position"), F.lit(k)).cast("int")).drop("position", "group_size")


def group_fold(key: str, id_col: str, k: int = 5, seed: int | str = 42) -> Column:
    """Fold of a row's group; a row without a group is a group of its own."""
    group = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row:"), F.col(id_col).cast("string")))
    return F.pmod(hash32(seed, group), F.lit(k)).cast("int")


def group_shuffle_split(key: str, id_col: str, share: float = 0.15, seed: int | str = 42) -> Column:
    """True for the rows of a random ``share`` of the groups."""
    group = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row:"), F.col(id_col).cast("string")))
    return uniform(seed, group) < share


def latest_slice(df: DataFrame, date: str = C.DATE, share: float = 0.15, name: str = "is_validation") -> DataFrame:
    """Mark the newest rows: those whose percent rank by date is above 1 - share.

    The rank only depends on the day, so the mask is a single cut-off day.
    """
    day = df.select(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).alias("day"))
    placed = value_positions(day, "day", bounded=True)
    percent_rank = F.try_divide(F.col("before").cast("double"), (F.col("total") - 1).cast("double"))
    cut = placed.agg(F.min(F.when(percent_rank > 1.0 - share, F.col("day")))).scalar()
    own = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    return df.withColumn(name, F.coalesce(own >= cut, F.lit(False)))


def hash_sample(df: DataFrame, n: int, id_col: str, seed: int | str = 42) -> DataFrame:
    """Uniform sample of min(n, rows) rows without replacement: those of the smallest hashes.

    Hashes are first counted by their upper half, which gives the range that holds the n smallest; only rows up to it (n and a 65,536th of all, as
    a mean) are ordered, so the last task does not grow with the number of tasks.
    """
    key = hash32(seed, F.col(id_col))
    counts = df.groupBy(F.shiftright(key, 16).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_range")))  # 65,536 rows at most
    last = upto.agg(F.coalesce(F.min(F.when(F.col("_upto") >= n, F.col("_range"))), F.lit(1 << 16))).scalar()
    return df.where(F.shiftright(key, 16) <= last).orderBy(key, F.col(id_col)).limit(n)


# --- row weights ----------------------------------------------------------------------------------


def with_group_size(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).withColumn("_rows", F.col(name))
    return attach_by_key(df, sizes, keys, "_rows")


def inverse_count_weight(df: DataFrame, key: str, name: str = "weight") -> DataFrame:
    """1 / rows per key; rows without a key weigh 1."""
    sized = with_group_size(df, [key], "_size")
    return sized.withColumn(name, F.lit(1.0) / F.coalesce(F.col("_size"), F.lit(1))).drop("_size")


def inverse_sqrt_share_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """1 / sqrt(share of the row's class)."""
    sized = with_group_size(df, [label], "_size")
    total = df.agg(F.count(F.lit(1))).scalar()
    return sized.withColumn(name, F.lit(1.0) / F.sqrt(F.col("_size") / total)).drop("_size")


def balanced_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """1 / group size, scaled so that the mean weight is 1."""
    sized = with_group_size(df, [label], "_size")
    # mean of 1/size over rows = groups / rows
    stats = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg((F.count(F.lit(1)) / F.sum("n"))).scalar()
    return sized.withColumn(name, F.lit(1.0) / F.col("_size") / stats).drop("_size")

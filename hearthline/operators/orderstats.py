"""Exact positions, ranks and percentiles without sorting a group in one task.

Equal values are counted first (a hot value becomes one row), distinct values
are cut into ranges, and each range is accumulated on its own; only the range
totals (at most ``bucket_count`` per group) are accumulated across ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.functions.hashing import hash32
from hearthline.operators.skew import null_safe
from hearthline.session import staged


PER_RANGE = 1 << 16


def bucket_count(df: DataFrame, buckets: int | None = None) -> int:
    """Ranges to cut an order into: a few per shuffle partition, so that they grow with the cluster."""
    return buckets or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def place_among(cuts: Column, value: Column, most: int) -> Column:
    """How many of the ascending ``cuts``, at most ``most``, are not above ``value``; by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(most, 1).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(cuts, at + step - 1) <= value, F.lit(False)), step).otherwise(F.lit(0))
    )


def range_bucket(counts: DataFrame, value: str, groups: list[str], buckets: int | None = None) -> tuple[DataFrame, str | None]:
    """(``counts`` written once, name of its range column): ``counts`` has one row per group and distinct value.

    A group that holds more values than a range is cut at quantiles of its own, from one mergeable sketch per group. A range has ``PER_RANGE``
    values, or more in a table of more than ``buckets`` such ranges (given ``buckets``, just the table's share). So fewer than ``buckets``
    groups are cut, at fewer than ``buckets`` points in all, which are broadcast. Without such a group there are no ranges (None).
    """
    counts = staged(counts, "counts")
    total, ranges = counts.count(), bucket_count(counts, buckets)
    per_range = max(1 if buckets else PER_RANGE, -(-total // ranges))
    if total <= per_range:
        return counts, None
    if not groups:
        parts = -(-total // per_range)
        cuts = counts.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).scalar()
        cut = counts.withColumn("_cuts", cuts)  # a column: lambdas take no subquery
        return cut.withColumn("_bucket", place_among(F.col("_cuts"), F.col(value), parts)).drop("_cuts"), "_bucket"
    sizes = counts.groupBy(*groups).agg(F.count(F.lit(1)).alias("_values"))
    large = staged(sizes.where(F.col("_values") > per_range), "large")
    if not large.count():
        return counts, None
    sketch = F.percentile_approx(value, [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges)).alias("_all")
    own = counts.join(F.broadcast(large), null_safe(counts, large, groups))
    fine = own.groupBy(*[counts[g] for g in groups], "_values").agg(sketch)
    parts = F.ceil(F.col("_values") / per_range).cast("int")
    picked = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_all", F.floor(i * ranges / parts).cast("int") - 1))
    cuts = staged(fine.select(*groups, picked.alias("_cuts")), "cuts")
    joined = counts.join(F.broadcast(cuts), null_safe(counts, cuts, groups), "left")
    place = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(place_among(F.col("_cuts"), F.col(value), ranges))
    return joined.select(*[counts[c] for c in counts.columns], place.alias("_bucket")), "_bucket"


def running_totals(
    df: DataFrame, order: list[str], groups: list[str], measures: list[str], bucket: str | None = None
) -> DataFrame:
    """Add ``<m>_before`` (sum over the rows ahead) and ``<m>_total`` per group.

    ``bucket`` numbers consecutive ranges of the order; with it no window is
    wider than one range of one group.
    """
    if bucket is None:
        ahead = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*groups)
        return df.select(
            "*",
            *[F.coalesce(F.sum(m).over(ahead), F.lit(0)).alias(f"{m}_before") for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
        )
    inside = running_totals(df, order, [*groups, bucket], measures)
    per_bucket = df.groupBy(*groups, bucket).agg(*[F.sum(m).alias(m) for m in measures])
    offsets = running_totals(per_bucket, [bucket], groups, measures)
    return inside.join(offsets, null_safe(inside, offsets, [*groups, bucket])).select(
        *[inside[c] for c in df.columns if c != bucket],
        *[(inside[f"{m}_before"] + offsets[f"{m}_before"]).alias(f"{m}_before") for m in measures],
        *[offsets[f"{m}_total"] for m in measures],
    )


def value_positions(
    df: DataFrame,
    value: str,
    groups: list[str] | None = None,
    *,
    bounded: bool = False,
    buckets: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per group and distinct value: ``n``, rows ``before`` it, rows ``total``.

    ``bounded`` says that the value comes from a small fixed domain (a score, a
    day); then the distinct values need no ranges. A row counts ``weight`` times
    where that column is given.
    """
    groups = groups or []
    rows = F.lit(1) if weight is None else F.col(weight)
    base = df.select(*groups, F.col(value).cast("double").alias(value), rows.cast("bigint").alias("_w"))
    # nulls count as 0 and go afterwards: a null filter would be pushed into the
    # input and compute the value's expression a second time
    seen = F.sum(F.when(F.col(value).isNotNull(), F.col("_w")).otherwise(F.lit(0)))
    counts = base.groupBy(*groups, value).agg(seen.alias("n")).where(F.col("n") > 0)
    if bounded:
        placed = running_totals(counts, [value], groups, ["n"])
    else:
        counts, ranges = range_bucket(counts, value, groups, buckets)
        placed = running_totals(counts, [value], groups, ["n"], ranges)
    return placed.withColumnsRenamed({"n_before": "before", "n_total": "total"})


def hash_positions(
    df: DataFrame, id_col: str, seed: int | str, groups: list[str] | None = None, buckets: int | None = None
) -> DataFrame:
    """Add ``position`` (0-based) of each row in a seeded shuffle, within its group.

    The hash is uniform, so equal slices of its range are equal in size.
    """
    groups, buckets = groups or [], bucket_count(df, buckets)
    keyed = df.withColumn("_hash", hash32(seed, F.col(id_col))).withColumn("_one", F.lit(1).cast("bigint"))
    bucketed = keyed.withColumn("_bucket", F.floor(F.col("_hash") * buckets / F.lit(float(1 << 32))))
    placed = running_totals(bucketed, ["_hash", id_col], groups, ["_one"], "_bucket")
    return placed.select(*df.columns, F.col("_one_before").alias("position"), F.col("_one_total").alias("group_size"))


def exact_percentiles(
    df: DataFrame,
    value: str,
    points: dict[str, float],
    groups: list[str] | None = None,
    *,
    bounded: bool = False,
    buckets: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolation percentiles per group, named by ``points``. Nulls are ignored; a row counts ``weight`` times where given."""
    groups = groups or []
    if bounded:
        names = list(points)
        exact = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(points[k]) for k in names]), F.col(weight) if weight else 1)
        return df.groupBy(*groups).agg(exact.alias("_p")).select(
            *groups, *[F.col("_p")[i].alias(k) for i, k in enumerate(names)]
        )
    placed = value_positions(df, value, groups, buckets=buckets, weight=weight)
    first, last = F.col("before"), F.col("before") + F.col("n") - 1

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position <= last), F.col(value)))

    picks: list[Column] = [F.max("total").alias("_total")]
    for name, q in points.items():
        target = (F.col("total") - 1) * F.lit(q)
        picks += [at(F.floor(target)).alias(f"_{name}_lo"), at(F.ceil(target)).alias(f"_{name}_hi")]
    row = placed.groupBy(*groups).agg(*picks)
    out = []
    for name, q in points.items():
        target = (F.col("_total") - 1) * F.lit(q)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (target - F.floor(target))).alias(name))
    return row.select(*groups, *out)


def average_ranks(df: DataFrame, value: str, *, bounded: bool = False) -> DataFrame:
    """Rank of each distinct value, ties sharing their average rank."""
    placed = value_positions(df, value, bounded=bounded)
    return placed.select(value, "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"), "total")


def mode_per_group(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value per group, the smallest one on ties; nulls are ignored."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value)))
    return counts.groupBy(*groups).agg(best.alias(name))

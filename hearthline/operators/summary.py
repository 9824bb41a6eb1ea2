"""Descriptive tables: counts, cross-tabs, profiles, quartiles, describe."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.operators.orderstats import exact_percentiles, mode_per_group
from hearthline.operators.repair import null_rates, numeric_columns
from hearthline.operators.skew import null_safe
from hearthline.session import staged

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def join_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two per-group tables; a null group matches itself."""
    extra = [c for c in right.columns if c not in keys]
    return left.join(right, null_safe(left, right, keys)).select(
        *[left[c] for c in left.columns], *[right[c] for c in extra]
    )


# --- recommendation measures ----------------------------------------------------------------------


def with_cost(df: DataFrame, cost: str) -> DataFrame:
    """Replace a cost text by its columns ``low``, ``high`` and ``mid``."""
    rest = [c for c in df.columns if c != cost]
    return df.select(*rest, S.parse_cost(F.col(cost)).alias("_c")).select(
        *rest, F.col("_c.low").alias("low"), F.col("_c.high").alias("high"), F.col("_c.mid").alias("mid")
    )


def measure_summary(
    recs: DataFrame, measure: str = "IMPROVEMENT_SUMMARY_TEXT", cost: str = "INDICATIVE_COST"
) -> DataFrame:
    """Count and cost statistics per measure; an unnamed measure is a group too."""
    texts = recs.groupBy(F.col(measure).alias("measure"), F.col(cost).alias("_cost")).agg(F.count(F.lit(1)).alias("n"))
    rows = staged(with_cost(texts, "_cost"), "costs")  # each different text is parsed once
    priced = F.when(F.col("mid").isNotNull(), F.col("n"))
    base = rows.groupBy("measure").agg(F.sum("n").alias("count"), F.try_divide(F.sum(F.col("mid") * F.col("n")), F.sum(priced)).alias("cost_mid_mean"))
    long = rows.unpivot(["measure", "n"], ["low", "high", "mid"], "part", "value")
    points = exact_percentiles(long, "value", {"median": 0.5}, ["measure", "part"], weight="n")
    medians = points.groupBy("measure").agg(
        *[F.max(F.when(F.col("part") == p, F.col("median"))).alias(f"cost_{p}_median") for p in ("low", "high", "mid")]
    )
    return base.join(medians, null_safe(base, medians, ["measure"]), "left").select(
        *[base[c] for c in base.columns], *[medians[c] for c in medians.columns if c != "measure"]
    )


def total_cost(recs: DataFrame, key: str = C.ID, cost: str = "INDICATIVE_COST", name: str = "total_cost") -> DataFrame:
    """Sum of mid costs per certificate; all unreadable sums to 0."""
    mid = S.parse_cost(F.col(cost))["mid"]
    return recs.groupBy(key).agg(F.coalesce(F.sum(mid), F.lit(0.0)).alias(name))


def cost_effectiveness(
    recs: DataFrame, k: int = 10, measure: str = "IMPROVEMENT_SUMMARY_TEXT", cost: str = "INDICATIVE_COST"
) -> DataFrame:
    """The k most frequent measures (normalised names) with their median cost."""
    rows = recs.select(
        S.measure_name(F.col(measure)).alias("measure"), S.parse_cost(F.col(cost))["mid"].alias("mid")
    ).where(F.col("measure").isNotNull())
    counts = top(
        rows.groupBy("measure").agg(F.count(F.lit(1)).alias("count")), k, F.desc("count"), F.asc("measure")
    )
    medians = exact_percentiles(rows, "mid", {"median_cost": 0.5}, ["measure"])
    return counts.join(medians, "measure", "left")


def per_dwelling(recs: DataFrame, key: str = C.ID, cost: str = "INDICATIVE_COST") -> DataFrame:
    """Mean and median number of measures, and of total cost, per certificate."""
    mid = S.parse_cost(F.col(cost))["mid"]
    each = recs.groupBy(key).agg(
        F.count(F.lit(1)).alias("measures"), F.coalesce(F.sum(mid), F.lit(0.0)).alias("cost")
    )
    means = each.agg(F.struct(F.avg("measures").alias("m"), F.avg("cost").alias("c"))).scalar()
    return (
        exact_percentiles(each, "measures", {"median_measures": 0.5}, bounded=True)
        .withColumn("median_cost", exact_percentiles(each, "cost", {"median_cost": 0.5}).scalar())
        .withColumn("mean_measures", means["m"])
        .withColumn("mean_cost", means["c"])
    )


# --- counts over a domain -------------------------------------------------------------------------


def domain_counts(df: DataFrame, col: str, domain: Iterable[str] = C.BANDS) -> DataFrame:
    """Count and share of every domain value, zero when it does not occur."""
    domain = list(domain)
    counted = df.agg(*[F.count_if(F.col(col) == v).alias(f"d{i}") for i, v in enumerate(domain)])
    rows = counted.select(
        F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.lit(i).alias("ord"), F.col(f"d{i}").alias("n"))
                           for i, v in enumerate(domain)])),
        sum((F.col(f"d{i}") for i in range(len(domain))), F.lit(0)).alias("_all"),
    )
    return rows.select("value", "ord", "n", F.try_divide(F.col("n"), F.col("_all")).alias("share"))


def crosstab(df: DataFrame, row: str, col: str, domain: Iterable[str], normalise: bool = False) -> DataFrame:
    """Counts of row value by column domain; optionally as a share of the row."""
    domain = list(domain)
    counts = df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(str(v)) for v in domain])
    if not normalise:
        return counts
    total = sum((F.col(f"`{v}`") for v in domain), F.lit(0))
    return counts.select(row, *[F.try_divide(F.col(f"`{v}`"), total).alias(str(v)) for v in domain])


def group_profile(df: DataFrame, group: str, score: str, modal: str, bounded: bool = True) -> DataFrame:
    """n, mean, median and modal category per group."""
    base = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))
    median = exact_percentiles(df, score, {"median_score": 0.5}, [group], bounded=bounded)
    return base.join(median, group, "left").join(mode_per_group(df, [group], modal, "modal"), group, "left")


def mean_pivot(df: DataFrame, row: str, col: str, domain: Iterable[str], score: str) -> DataFrame:
    """Mean score per row value and column domain, with the widest gap in the row."""
    domain = list(domain)
    wide = df.groupBy(row).agg(*[F.avg(F.when(F.col(col) == v, F.col(score))).alias(str(v)) for v in domain])
    cells = [F.col(f"`{v}`") for v in domain]
    return wide.withColumn("gap", F.greatest(*cells) - F.least(*cells))


def melt(df: DataFrame, ids: list[str], cols: list[str], key: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, key, value).where(F.col(value).isNotNull())


def cell_means(df: DataFrame, groups: list[str], score: str, k: int = 14) -> DataFrame:
    """The k largest cells with n and mean score."""
    cells = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))
    return top(cells, k, F.desc("n"), *[F.asc(g) for g in groups])


def top_categories(df: DataFrame, col: str, n: int = 8) -> DataFrame:
    """Rows of the n most frequent categories."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    names = top(counts, n, F.desc("_n"), F.asc(col)).select(col)
    return df.join(F.broadcast(names), col, "left_semi")  # n names at most


def quartiles_by_group(df: DataFrame, group: str, score: str, *, bounded: bool = False) -> DataFrame:
    base = df.groupBy(group).agg(
        F.count(score).alias("n"), F.min(score).alias("low"), F.max(score).alias("high")
    )
    return join_groups(base, exact_percentiles(df, score, QUARTILES, [group], bounded=bounded), [group])


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins included."""
    span = df.agg(
        F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    ).scalar()
    located = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), span.alias("s"))
    width = (F.col("s.hi") - F.col("s.lo")) / F.lit(float(bins))
    index = F.least(F.floor(F.try_divide(F.col("v") - F.col("s.lo"), width)), F.lit(bins - 1))
    counts = located.groupBy(F.coalesce(index, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edge_width = (F.col("s.hi") - F.col("s.lo")) / F.lit(float(bins))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("s", span)
    return (
        frame.join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("s.lo") + edge_width * F.col("bin")).alias("left_edge"),
            (F.col("s.lo") + edge_width * (F.col("bin") + 1)).alias("right_edge"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max and percent missing per numeric column."""
    cols = cols or numeric_columns(df)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    base = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.avg(F.col("value").isNull().cast("double")) * 100.0).alias("pct_missing"),
    )
    points = exact_percentiles(long, "value", QUARTILES, ["column"])
    return base.join(points, "column", "left")


def missingness_ranking(df: DataFrame, k: int = 20) -> DataFrame:
    cols = df.columns
    rates = null_rates(df, cols)
    return top(rates.unpivot([], cols, "column", "null_rate"), k, F.desc("null_rate"), F.asc("column"))


def yearly_volume(df: DataFrame, date: str = C.DATE) -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def conditional_counts(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Several conditional counts from one pass."""
    return df.agg(*[F.count_if(t).alias(name) for name, t in tests.items()])


def group_density(df: DataFrame, group: str, test: Column, min_rows: int = 500) -> DataFrame:
    """Rows, matching rows and percentage per group of at least ``min_rows``."""
    dense = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(test).alias("n_match"))
    return dense.where(F.col("n") >= min_rows).withColumn("pct", F.col("n_match") * 100.0 / F.col("n"))


def cardinalities(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct non-null values per column; pairs are de-duplicated before they are counted."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    pairs = long.where(F.col("value").isNotNull()).distinct()
    return pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def kpis(df: DataFrame, score: str, band: str, wanted: Iterable[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        F.avg(F.coalesce(F.col(band).isin(*wanted), F.lit(False)).cast("double")).alias("share_wanted"),
    )


def flag_summary(df: DataFrame, flags: list[str]) -> DataFrame:
    """Mean and non-zero share per flag column."""
    both = df.agg(
        *[F.struct(F.lit(c).alias("flag"), F.avg(c).alias("mean"),
                   F.avg((F.coalesce(F.col(c), F.lit(0)) != 0).cast("double")).alias("nonzero_share")).alias(c)
          for c in flags]
    )
    return both.select(F.inline(F.array(*flags)))


def median_gap(df: DataFrame, group: str, score: str, *, bounded: bool = False) -> DataFrame:
    """Median score per category and the gap between the best and the worst one."""
    medians = exact_percentiles(df.where(F.col(group).isNotNull()), score, {"median_score": 0.5}, [group], bounded=bounded)
    gap = medians.agg((F.max("median_score") - F.min("median_score"))).scalar()
    return medians.withColumn("gap", gap)


def conditional_workbook(df: DataFrame, group: str, score: str, test: Column, *, bounded: bool = False) -> DataFrame:
    """count-if, average-if, sample deviation and inclusive quartiles per group."""
    base = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(test).alias("n_match"),
        F.avg(F.when(test, F.col(score))).alias("mean_match"),
        F.stddev_samp(score).alias("std"),
    )
    return join_groups(base, exact_percentiles(df, score, QUARTILES, [group], bounded=bounded), [group])


def term_frequency(df: DataFrame, text: Column, k: int = 45) -> DataFrame:
    """The k most frequent terms."""
    terms = df.select(text.alias("term")).where(F.col("term").isNotNull() & (F.col("term") != ""))
    return top(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")), k, F.desc("n"), F.asc("term"))


def baskets(df: DataFrame, key: str, item: str, name: str = "items") -> DataFrame:
    """Sorted distinct items per key."""
    pairs = df.where(F.col(item).isNotNull()).select(key, item).distinct()
    return pairs.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))


def fold_aggregate(df: DataFrame, config: str, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of every metric per configuration."""
    aggs = [f(m).alias(f"{m}_{tag}") for m in metrics for f, tag in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return df.groupBy(config).agg(F.count(F.lit(1)).alias("folds"), *aggs)


def arg_max(df: DataFrame, name: str, metric: str) -> DataFrame:
    """The configuration with the best metric; the smallest name wins a tie."""
    return df.agg(
        F.min_by(F.col(name), F.struct(-F.col(metric), F.col(name))).alias(name), F.max(metric).alias(metric)
    )


"""Rank correlation and association between categories."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from hearthline.operators.orderstats import average_ranks
from hearthline.operators.skew import attach_by_key


def with_ranks(df: DataFrame, cols: list[str], bounded: Iterable[str] = ()) -> DataFrame:
    """Add ``<col>_rank`` (average rank on ties) for each column."""
    out = df
    for c in cols:
        ranks = average_ranks(df, c, bounded=c in set(bounded)).select(c, "n", F.col("rank").alias(f"{c}_rank"))
        out = attach_by_key(out, ranks, [c], "n")
    return out


def _pair_rows(ranked: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    row = ranked.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.corr(f"{a}_rank", f"{b}_rank").alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
    )
    entries = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col("n").alias("n"), F.col(f"r{i}").alias("rho"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*entries)))


def spearman(df: DataFrame, cols: list[str], *, pairwise: bool = False, bounded: Iterable[str] = ()) -> DataFrame:
    """Spearman's rho of every pair, over complete rows or (``pairwise``) rows complete in the pair."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    pairs = list(combinations(cols, 2))
    if not pairwise:
        return _pair_rows(with_ranks(numbers.dropna(), cols, bounded), pairs)
    parts = [
        _pair_rows(with_ranks(numbers.select(a, b).dropna(), [a, b], bounded), [(a, b)]) for a, b in pairs
    ]
    return reduce(DataFrame.unionByName, parts)


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramér's V with chi-square and its size; Yates' correction for 2 x 2 tables only."""
    cells = (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
        .agg(F.count(F.lit(1)).alias("o"))
    )
    by_a = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    by_b = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    sizes = by_a.agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.sum("ra").alias("n"), F.sum(1.0 / F.col("ra")).alias("inv"))
    ).scalar()
    cols = by_b.agg(F.struct(F.count(F.lit(1)).alias("cols"), F.sum(1.0 / F.col("cb")).alias("inv"))).scalar()
    filled = cells.join(by_a, "a").join(by_b, "b").withColumn("s", sizes)
    table = filled.agg(
        F.sum(F.col("o") * F.col("o") / (F.col("ra").cast("double") * F.col("cb"))).alias("q"),
        F.max(F.abs(F.col("o") - F.col("ra").cast("double") * F.col("cb") / F.col("s.n"))).alias("dev"),
    ).withColumns({"r": sizes, "c": cols})
    yates = F.pow(F.greatest(F.col("dev") - 0.5, F.lit(0.0)), 2) * F.col("r.n") * F.col("r.inv") * F.col("c.inv")
    plain = F.col("r.n") * (F.col("q") - 1.0)
    chi2 = F.when((F.col("r.rows") == 2) & (F.col("c.cols") == 2), yates).otherwise(plain)
    narrow = F.least(F.col("r.rows"), F.col("c.cols")) - 1
    return table.select(
        F.lit(a).alias("x"),
        F.lit(b).alias("y"),
        F.col("r.n").alias("n"),
        chi2.alias("chi2"),
        F.sqrt(F.try_divide(F.greatest(chi2, F.lit(0.0)), F.col("r.n") * narrow)).alias("v"),
    )

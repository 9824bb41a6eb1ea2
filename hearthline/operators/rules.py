"""Basket rules and item recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from hearthline.session import staged


def basket_patterns(baskets: DataFrame, items: str, min_support: float) -> tuple[DataFrame, DataFrame]:
    """Frequent single items, and the distinct baskets reduced to them with their counts.

    An item of support s sits in s*B baskets, so at most (mean basket size)/s
    items are frequent; their list travels as one scalar value.
    """
    size = baskets.agg(F.count(F.lit(1))).scalar()
    singles = (
        baskets.select(F.explode(items).alias("item"))
        .groupBy("item").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("baskets", size)
        .where(F.col("n") >= F.col("baskets") * F.lit(min_support))
    )
    listed = singles.agg(F.array_sort(F.collect_list("item"))).scalar()
    patterns = (
        baskets.select(F.sort_array(F.array_intersect(F.col(items), listed)).alias("pattern"))
        .groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("baskets", size)
    )
    return singles, patterns


def frequent_itemsets(baskets: DataFrame, items: str = "items", min_support: float = 0.03, max_size: int | None = 3) -> DataFrame:
    """Itemsets of up to ``max_size`` items, of any size where it is None: (itemset, size, n, support).

    Identical baskets are merged before anything is enumerated. A row of a level is a frequent itemset and the items that follow it in some
    baskets, with the number of those baskets; equal rows are merged. The next level adds each following item and keeps the itemsets that are
    frequent, until none is. A level is written once and read twice: to count, and to go on.
    """
    singles, patterns = basket_patterns(staged(baskets.select(items), "baskets"), items, min_support)
    patterns = staged(patterns, "patterns")
    enough = F.col("n") >= F.col("baskets") * F.lit(min_support)
    counts = F.sum("n").alias("n"), F.max("baskets").alias("baskets")
    found = [singles.select(F.array("item").alias("itemset"), "n", "baskets")]
    level = patterns.select("n", "baskets", F.expr("CAST(array() AS array<string>)").alias("itemset"), F.col("pattern").alias("rest"))
    grown = _longer(level).where(F.size("rest") > 0).groupBy("itemset", "rest").agg(*counts)
    size = 1
    while max_size is None or size < max_size:
        size += 1
        grown = staged(_longer(grown), "grown-itemsets")
        kept = staged(grown.groupBy("itemset").agg(*counts).where(enough), "itemsets")
        if kept.isEmpty():
            break
        found.append(kept)
        grown = grown.where(F.size("rest") > 0).join(kept.select("itemset"), "itemset", "left_semi").groupBy("itemset", "rest").agg(*counts)
    return reduce(DataFrame.unionByName, found).select(
        "itemset", F.size("itemset").alias("size"), "n", (F.col("n") / F.col("baskets")).alias("support")
    )


def _longer(level: DataFrame) -> DataFrame:
    """Every itemset with each one of the items that follow it, and what follows that item."""
    grown = level.select("n", "baskets", "itemset", "rest", F.posexplode("rest").alias("j", "item"))
    return grown.select(
        "n", "baskets", F.array_append("itemset", F.col("item")).alias("itemset"), F.expr("slice(rest, j + 2, size(rest))").alias("rest")
    )


def association_rules(itemsets: DataFrame, min_lift: float = 1.05) -> DataFrame:
    """Every split of a frequent itemset into antecedent and consequent, both of any size, with confidence and lift; the itemsets are written once."""
    itemsets = staged(itemsets, "itemsets")
    halves = F.expr(
        "transform(sequence(1L, shiftleft(1L, size) - 2), m -> struct("
        "filter(itemset, (x, i) -> (shiftright(m, i) & 1) = 1) AS antecedent, filter(itemset, (x, i) -> (shiftright(m, i) & 1) = 0) AS consequent))"
    )
    splits = itemsets.where(F.col("size") >= 2).select("support", F.inline(halves))
    sides = itemsets.select("itemset", F.col("support").alias("s"))
    left = sides.withColumnsRenamed({"itemset": "antecedent", "s": "support_a"})
    right = sides.withColumnsRenamed({"itemset": "consequent", "s": "support_c"})
    rules = splits.join(left, "antecedent").join(right, "consequent")
    return rules.select(
        "antecedent",
        "consequent",
        "support",
        (F.col("support") / F.col("support_a")).alias("confidence"),
        (F.col("support") / (F.col("support_a") * F.col("support_c"))).alias("lift"),
    ).where(F.col("lift") >= min_lift)


def top_rules(rules: DataFrame, k: int = 10) -> DataFrame:
    joined = rules.select(
        F.array_join("antecedent", ", ").alias("antecedent"), F.array_join("consequent", ", ").alias("consequent"),
        "support", "confidence", "lift",
    )
    return joined.orderBy(F.desc(F.round("lift", 9)), "antecedent", "consequent").limit(k)


# --- recommendations ------------------------------------------------------------------------------


def recommend_from_neighbours(neighbours: DataFrame, baskets: DataFrame, n: int = 5, items: str = "items") -> DataFrame:
    """Items of a query's neighbours by votes; ``neighbours`` is (query, neighbour), ``baskets`` (neighbour, items)."""
    votes = (
        neighbours.join(baskets, "neighbour")
        .select("query", F.explode(items).alias("item"))
        .groupBy("query", "item").agg(F.count(F.lit(1)).alias("votes"))
    )
    order = Window.partitionBy("query").orderBy(F.desc("votes"), F.asc("item"))
    return votes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def popular_items(baskets: DataFrame, n: int = 5, items: str = "items") -> DataFrame:
    counts = baskets.select(F.explode(items).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("votes"))
    return counts.orderBy(F.desc("votes"), F.asc("item")).limit(n)


def recommendation_quality(actual: DataFrame, recommended: DataFrame, n: int = 5) -> DataFrame:
    """hit-rate, precision@n, recall@n of (query, recs) against (query, items); a query without recs scores 0."""
    both = actual.join(recommended, "query", "left")
    hits = F.size(F.array_intersect(F.col("items"), F.coalesce(F.col("recs"), F.array().cast("array<string>"))))
    return both.select(hits.alias("h"), F.size("items").alias("a")).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg((F.col("h") > 0).cast("double")).alias("hit_rate"),
        F.avg(F.col("h") / F.lit(float(n))).alias("precision_at_n"),
        F.avg(F.col("h") / F.greatest(F.col("a"), F.lit(1))).alias("recall_at_n"),
    )


def as_lists(ranked: DataFrame) -> DataFrame:
    """(query, item, rank) rows to one list per query."""
    return ranked.groupBy("query").agg(F.array_sort(F.collect_list("item")).alias("recs"))

"""Basket rules, nearest neighbours and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.functions import scalars as S
from hearthline.functions.hashing import uniform
from hearthline.operators import rules as U
from hearthline.operators.neighbours import nearest_neighbours
from hearthline.operators.vector_index import build_index, search
from hearthline.operators.summary import baskets
from hearthline.queries.q_summary import NAME_SQL
from hearthline.queries.registry import query, rounded, rsql
from hearthline.queries.roles import rec_cte, recommendations, table, uniform_sql


def _baskets(spark, d):
    recs = recommendations(spark, d, "LMK_KEY", "IMPROVEMENT_SUMMARY_TEXT")
    named = recs.select("LMK_KEY", S.measure_name(F.col("IMPROVEMENT_SUMMARY_TEXT")).alias("item"))
    return baskets(named, "LMK_KEY", "item")


_ITEMS = f"{rec_cte()}, bi AS (SELECT DISTINCT LMK_KEY AS b, {NAME_SQL} AS i FROM rec WHERE IMPROVEMENT_SUMMARY_TEXT IS NOT NULL), nb AS (SELECT count(DISTINCT b)::DOUBLE AS nb FROM bi)"


def _sets_sql(items: str, support: float) -> str:
    return f"""{items}, s1 AS (SELECT i AS a, count(*) AS n FROM bi GROUP BY 1), f1 AS (SELECT a, n FROM s1, nb WHERE n >= nb * {support}::DOUBLE),
 f2 AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM bi x JOIN bi y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= (SELECT nb FROM nb) * {support}::DOUBLE),
 f3 AS (SELECT x.i AS a, y.i AS b, z.i AS c, count(*) AS n FROM bi x JOIN bi y ON x.b = y.b AND x.i < y.i JOIN bi z ON y.b = z.b AND y.i < z.i GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT nb FROM nb) * {support}::DOUBLE),
 sets AS (SELECT [a] AS s, n FROM f1 UNION ALL SELECT [a, b], n FROM f2 UNION ALL SELECT [a, b, c], n FROM f3)"""


_SETS = _sets_sql(_ITEMS, 0.03)
_RULES = f"""{_SETS}, sp AS (SELECT a, c, n FROM (SELECT list_filter(s, lambda v: v = x) AS a, list_filter(s, lambda v: v <> x) AS c, n FROM (SELECT s, n, unnest(s) AS x FROM sets WHERE len(s) >= 2))
 UNION ALL SELECT a, c, n FROM (SELECT list_filter(s, lambda v: v <> x) AS a, list_filter(s, lambda v: v = x) AS c, n FROM (SELECT s, n, unnest(s) AS x FROM sets WHERE len(s) = 3))),
 ru AS (SELECT array_to_string(a, ', ') AS antecedent, array_to_string(c, ', ') AS consequent, sp.n / nb AS support, sp.n::DOUBLE / sa.n AS confidence,
 (sp.n / nb) / ((sa.n / nb) * (sc.n / nb)) AS lift FROM sp JOIN sets sa ON sa.s = sp.a JOIN sets sc ON sc.s = sp.c, nb)"""


@query("rec1_frequent_itemsets", rsql(f"WITH {_SETS} SELECT array_to_string(s, '|') AS itemset, CAST(len(s) AS INT) AS size, CAST(n AS BIGINT) AS n, n / nb AS support FROM sets, nb", "support"))
def rec1(spark, d):
    return rounded(U.frequent_itemsets(_baskets(spark, d)).withColumn("itemset", F.array_join("itemset", "|")))


@query("rec2_association_rules", rsql(f"WITH {_RULES} SELECT * FROM ru WHERE lift >= 1.05", "support confidence lift"))
def rec2(spark, d):
    found = U.association_rules(U.frequent_itemsets(_baskets(spark, d)))
    return rounded(found.withColumns({c: F.array_join(c, ", ") for c in ("antecedent", "consequent")}))


@query("rec2_top_rules", rsql(f"WITH {_RULES} SELECT * FROM ru WHERE lift >= 1.05 ORDER BY round(lift, 9) DESC, antecedent, consequent LIMIT 10", "support confidence lift"))
def rec2_top(spark, d):
    return rounded(U.top_rules(U.association_rules(U.frequent_itemsets(_baskets(spark, d)))))


_PART_ITEMS = "bi AS (SELECT DISTINCT l_orderkey AS b, p_type AS i FROM lineitem JOIN part ON l_partkey = p_partkey), nb AS (SELECT count(DISTINCT b)::DOUBLE AS nb FROM bi)"


@query("rec1_part_type_itemsets", rsql(f"WITH {_sets_sql(_PART_ITEMS, 0.03)} SELECT array_to_string(s, '|') AS itemset, CAST(len(s) AS INT) AS size, CAST(n AS BIGINT) AS n, n / nb AS support FROM sets, nb", "support"))
def rec1_parts(spark, d):
    kinds = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(kinds, "l_partkey")
    found = U.frequent_itemsets(baskets(pairs, "l_orderkey", "p_type"))
    return rounded(found.withColumn("itemset", F.array_join("itemset", "|")))


# Every subset of every basket, by the bits of a number.
_ANY = f"""{_ITEMS}, li AS (SELECT b, list(i ORDER BY i) AS s FROM bi GROUP BY 1), m AS (SELECT s, unnest(range(1, CAST(pow(2, len(s)) AS BIGINT))) AS m FROM li),
 su AS (SELECT list_filter(s, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM m), sets AS (SELECT s, count(*) AS n FROM su GROUP BY 1 HAVING count(*) >= (SELECT nb FROM nb) * 0.01::DOUBLE)"""


@query("rec1_any_size_itemsets", rsql(f"WITH {_ANY} SELECT array_to_string(s, '|') AS itemset, CAST(len(s) AS INT) AS size, CAST(n AS BIGINT) AS n, n / nb AS support FROM sets, nb", "support"))
def rec1_any(spark, d):
    """Itemsets of any size, level by level until none is frequent."""
    found = U.frequent_itemsets(_baskets(spark, d), min_support=0.01, max_size=None)
    return rounded(found.withColumn("itemset", F.array_join("itemset", "|")))


# --- neighbours -----------------------------------------------------------------------------------

_HELD = f"{uniform_sql(7, 'vec_id')} < 0.2::DOUBLE"
_KNN = f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, {_HELD} AS held FROM embeddings),
 sim AS (SELECT q.vec_id AS query, c.vec_id AS neighbour, round(list_cosine_similarity(q.v, c.v), 9) AS s FROM e q JOIN e c ON q.held AND NOT c.held),
 nn AS (SELECT query, neighbour, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rn FROM sim QUALIFY rn <= 15)"""


def _neighbours(spark, d):
    e = table(spark, d, "embeddings").withColumn("held", uniform(7, F.col("vec_id")) < 0.2)
    return nearest_neighbours(e.where("held"), e.where("NOT held"), "vec_id", "embedding", 15)


@query("jn5_nearest_neighbours", rsql(f"WITH {_KNN} SELECT query, neighbour, CAST(rn AS INT) AS rank, s AS similarity FROM nn", "similarity"))
def jn5(spark, d):
    return rounded(_neighbours(spark, d))


_KNN_TEXT = _KNN.replace("SELECT vec_id, CAST", "SELECT concat('v', vec_id) AS vec_id, CAST")


@query("jn5_text_keys", rsql(f"WITH {_KNN_TEXT} SELECT query, neighbour, CAST(rn AS INT) AS rank, s AS similarity FROM nn", "similarity"))
def jn5_text(spark, d):
    """Text keys, and more queries than a block holds."""
    e = table(spark, d, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("key"), "embedding", (uniform(7, F.col("vec_id")) < 0.2).alias("held"))
    return rounded(nearest_neighbours(e.where("held"), e.where("NOT held"), "key", "embedding", 15, block_bytes=256 << 10))


# The queries are every vector whose id is divisible by 50, against all vectors, themselves included.
_ASKED = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 sim AS (SELECT q.vec_id AS query, c.vec_id AS neighbour, round(list_cosine_similarity(q.v, c.v), 9) AS s FROM e q JOIN e c ON q.vec_id % 50 = 0),
 nn AS (SELECT query, neighbour, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rn FROM sim QUALIFY rn <= 15)"""


@query("jn5_index_exact", rsql(f"WITH {_ASKED} SELECT query, neighbour, CAST(rn AS INT) AS rank, s AS similarity FROM nn", "similarity"))
def jn5_index_exact(spark, d):
    """The index with every list visited that can hold a better row."""
    e = table(spark, d, "embeddings")
    return rounded(search(build_index(e, "vec_id", "embedding"), e.where("vec_id % 50 = 0"), "vec_id", "embedding", 15, exact=True))


@query("jn5_index_recall", f"WITH {_ASKED} SELECT count(DISTINCT query) AS queries, count(*) AS found, TRUE AS recall_reached, CAST(0 AS BIGINT) AS better_than_exact FROM nn")
def jn5_index_recall(spark, d):
    """Probed lists only, measured against the exact join: at least 0.9 of its pairs."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    probed = search(build_index(e, "vec_id", "embedding"), asked, "vec_id", "embedding", 15)
    exact = nearest_neighbours(asked, e, "vec_id", "embedding", 15).select("query", "neighbour", F.col("rank").alias("at"), F.lit(1).alias("hit"))
    both = probed.join(exact, ["query", "neighbour"], "full")
    return both.agg(
        F.count_distinct("query").alias("queries"), F.count("rank").alias("found"),
        (F.count_if(F.col("rank").isNotNull() & F.col("hit").isNotNull()) >= 0.9 * F.count("hit")).alias("recall_reached"),
        F.count_if(F.col("rank") > F.col("at")).alias("better_than_exact"),
    )


# Every vector stands for the certificate of the same number; its basket is that certificate's measures.
_REC_BASE = f"{rec_cte()}, bk AS (SELECT DISTINCT LMK_KEY AS k, {NAME_SQL} AS item FROM rec WHERE IMPROVEMENT_SUMMARY_TEXT IS NOT NULL), {_KNN}"
_VOTES = f"{_REC_BASE}, vo AS (SELECT query, item, count(*) AS votes FROM nn JOIN bk ON bk.k = nn.neighbour GROUP BY 1, 2), top5 AS (SELECT query, item, votes, row_number() OVER (PARTITION BY query ORDER BY votes DESC, item) AS rank FROM vo QUALIFY rank <= 5)"


def _recommended(spark, d):
    found = _neighbours(spark, d).select("query", "neighbour")
    return U.recommend_from_neighbours(found, _baskets(spark, d).withColumnRenamed("LMK_KEY", "neighbour"))


@query("rec3_neighbour_recommendations", f"WITH {_VOTES} SELECT query, item, votes, CAST(rank AS INT) AS rank FROM top5")
def rec3(spark, d):
    return _recommended(spark, d)


@query("win6_top_items_per_query", f"WITH {_VOTES} SELECT query, item FROM top5")
def win6(spark, d):
    return _recommended(spark, d).select("query", "item")


_POP = f"{_REC_BASE}, pop AS (SELECT item, count(*) AS votes FROM bk JOIN e ON e.vec_id = bk.k AND NOT held GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"


def _sides(spark, d):
    e = table(spark, d, "embeddings").select("vec_id").withColumn("held", uniform(7, F.col("vec_id")) < 0.2)
    return e.join(_baskets(spark, d).withColumnRenamed("LMK_KEY", "vec_id"), "vec_id")


@query("rec4_popular_items", f"WITH {_POP} SELECT item, votes FROM pop")
def rec4(spark, d):
    return U.popular_items(_sides(spark, d).where("NOT held"))


def _quality(recs: str) -> str:
    return f"""h AS (SELECT e.vec_id AS q, count(DISTINCT bk.item) AS a, count(DISTINCT CASE WHEN r.item IS NOT NULL THEN bk.item END) AS h
 FROM e JOIN bk ON bk.k = e.vec_id LEFT JOIN {recs} r ON r.item = bk.item AND (r.query IS NULL OR r.query = e.vec_id) WHERE held GROUP BY 1)"""


_Q_OUT = "count(*) AS queries, avg(CAST(h > 0 AS DOUBLE)) AS hit_rate, avg(h / 5.0::DOUBLE) AS precision_at_n, avg(h::DOUBLE / a) AS recall_at_n FROM h"


@query("rec5_recommendation_quality", rsql(f"WITH {_VOTES}, {_quality('top5')} SELECT {_Q_OUT}", "hit_rate precision_at_n recall_at_n"))
def rec5(spark, d):
    actual = _sides(spark, d).where("held").select(F.col("vec_id").alias("query"), "items")
    return rounded(U.recommendation_quality(actual, U.as_lists(_recommended(spark, d))))


@query("rec5_popularity_quality", rsql(f"WITH {_POP}, pq AS (SELECT item, NULL::BIGINT AS query FROM pop), {_quality('pq')} SELECT {_Q_OUT}", "hit_rate precision_at_n recall_at_n"))
def rec5_popularity(spark, d):
    sides = _sides(spark, d)
    popular = U.popular_items(sides.where("NOT held")).agg(F.array_sort(F.collect_list("item")).alias("r")).scalar()
    actual = sides.where("held").select(F.col("vec_id").alias("query"), "items")
    return rounded(U.recommendation_quality(actual, actual.select("query", popular.alias("recs"))))

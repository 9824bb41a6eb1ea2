"""Segmentation of mixed numeric and categorical rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.operators import segments as G
from hearthline.queries.registry import query, rounded, rsql
from hearthline.queries.roles import cert_cte, certificates, table

NUM, CAT, KS = ["p_size", "p_retailprice"], ["p_brand", "p_type"], [0, 1, 2]
LABELLED_SQL = "l AS (SELECT p_partkey, CAST((p_size + p_partkey) % 3 AS INT) AS cluster, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, p_brand, p_type FROM part)"


def _frame(spark, d):
    return G.mixed_frame(table(spark, d, "part"), NUM, CAT, keep=["p_partkey"])


def _labelled(spark, d):
    label = F.pmod(F.col("p_size").cast("int") + F.col("p_partkey"), F.lit(3)).cast("int")
    return _frame(spark, d).withColumn("cluster", label)


@query("clu1_mixed_frame", f"WITH {cert_cte()} SELECT LMK_KEY, TOTAL_FLOOR_AREA, NUMBER_HABITABLE_ROOMS, PROPERTY_TYPE, BUILT_FORM FROM cert "
       "WHERE TOTAL_FLOOR_AREA IS NOT NULL AND NUMBER_HABITABLE_ROOMS IS NOT NULL AND BUILT_FORM IS NOT NULL")
def clu1(spark, d):
    return G.mixed_frame(certificates(spark, d), ["TOTAL_FLOOR_AREA", "NUMBER_HABITABLE_ROOMS"], ["PROPERTY_TYPE", "BUILT_FORM"], ["LMK_KEY"])


_Z = "z AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS p_size, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS p_retailprice, p_brand, p_type, cluster FROM l)"


@query("mlp5_standardise", rsql(f"WITH {LABELLED_SQL}, {_Z} SELECT p_partkey, p_size, p_retailprice FROM z", "p_size p_retailprice"))
def mlp5(spark, d):
    return rounded(G.standardise(_frame(spark, d), NUM).select("p_partkey", *NUM))


_CENTRES = G.Prototypes(
    tuple(NUM), tuple(CAT), ((-1.0, -1.0), (0.0, 0.5), (1.0, 0.25)),
    (("Brand#1", "SMALL"), ("Brand#2", "PROMO"), ("Brand#3", "LARGE")), 0.5,
)


def _cost(i: int) -> str:
    (a, b), (x, y) = _CENTRES.means[i], _CENTRES.modes[i]
    return (f"((p_size - {a}::DOUBLE) * (p_size - {a}::DOUBLE) + (p_retailprice - {b}::DOUBLE) * (p_retailprice - {b}::DOUBLE) + CASE WHEN p_brand <> '{x}' THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN p_type <> '{y}' THEN 0.5::DOUBLE ELSE 0 END)")


@query("clu2_assignment_step", rsql(
    f"WITH {LABELLED_SQL}, {_Z}, c AS (SELECT p_partkey, {_cost(0)} AS c0, {_cost(1)} AS c1, {_cost(2)} AS c2 FROM z) "
    "SELECT p_partkey, CAST(CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS INT) AS cluster, least(c0, c1, c2) AS cost FROM c", "cost"))
def clu2_step(spark, d):
    return rounded(_CENTRES.assign(G.standardise(_frame(spark, d), NUM), cost="cost").select("p_partkey", "cluster", "cost"))


def _fitted(spark, d):
    df = G.standardise(_frame(spark, d), NUM)
    return df, G.fit_prototypes(df, NUM, CAT, 3, "p_partkey")


@query("clu2_fit_prototypes")
def clu2(spark, d):
    df, model = _fitted(spark, d)
    return model.assign(df).select("p_partkey", "cluster")


@query("clu2_cost_path", "SELECT count(*) AS n, 0 AS rises, 3::BIGINT AS clusters FROM part")
def clu2_path(spark, d):
    """Every row has a cluster, and no round of the kept start raises the cost."""
    df, model = _fitted(spark, d)
    rises = sum(b > a * (1 + 1e-9) for a, b in zip(model.cost_path, model.cost_path[1:]))
    return model.assign(df).agg(F.count("cluster").alias("n"), F.lit(rises).alias("rises"), F.countDistinct("cluster").alias("clusters"))


_PAIRS = f"""WITH {LABELLED_SQL}, r AS (SELECT max(p_size) - min(p_size) AS rs, max(p_retailprice) - min(p_retailprice) AS rp FROM l),
 d AS (SELECT a.p_partkey AS i, a.cluster AS ci, b.cluster AS cj, (abs(a.p_size - b.p_size) / rs + abs(a.p_retailprice - b.p_retailprice) / rp
 + CAST(a.p_brand <> b.p_brand AS INT) + CAST(a.p_type <> b.p_type AS INT)) / 4.0::DOUBLE AS dist FROM l a, l b, r WHERE a.p_partkey <> b.p_partkey),
 g AS (SELECT i, ci, cj, avg(dist) AS m FROM d GROUP BY ALL)"""


@query("clu3_mean_gower_distance", rsql(f"{_PAIRS} SELECT i AS p_partkey, ci AS cluster, max(m) FILTER (cj = 0) AS mean0, max(m) FILTER (cj = 1) AS mean1, max(m) FILTER (cj = 2) AS mean2 FROM g GROUP BY ALL", "mean0 mean1 mean2"))
def clu3(spark, d):
    dist = G.group_distances(_labelled(spark, d), "p_partkey", "cluster", NUM, CAT, KS)
    return rounded(G.mean_group_distance(dist, "p_partkey", "cluster", KS))


@query("clu4_silhouette", rsql(f"{_PAIRS}, ab AS (SELECT i, ci, max(m) FILTER (cj = ci) AS a, min(m) FILTER (cj <> ci) AS b FROM g GROUP BY ALL) "
       "SELECT ci AS cluster, count(*) AS n, avg((b - a) / greatest(a, b)) AS silhouette FROM ab GROUP BY 1", "silhouette"))
def clu4(spark, d):
    dist = G.group_distances(_labelled(spark, d), "p_partkey", "cluster", NUM, CAT, KS)
    widths = G.silhouette(dist, "p_partkey", "cluster", KS)
    return rounded(widths.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette")))


_LONG = f"""WITH {LABELLED_SQL}, {_Z}, lv AS (SELECT DISTINCT 'b' || p_brand AS f FROM l UNION SELECT DISTINCT 't' || p_type FROM l),
 x AS (SELECT p_partkey, cluster, 'size' AS f, p_size AS v FROM z UNION ALL SELECT p_partkey, cluster, 'price', p_retailprice FROM z
 UNION ALL SELECT p_partkey, cluster, f, CAST(f = 'b' || p_brand OR f = 't' || p_type AS DOUBLE) FROM z, lv),
 c AS (SELECT cluster, f, avg(v) AS m FROM x GROUP BY 1, 2), w AS (SELECT x.cluster, x.p_partkey, sum((v - m) * (v - m)) AS d2 FROM x JOIN c USING (cluster, f) GROUP BY 1, 2),
 o AS (SELECT f, avg(v) AS m FROM x GROUP BY 1), t AS (SELECT sum((v - m) * (v - m)) AS tss FROM x JOIN o USING (f)), s AS (SELECT cluster, avg(sqrt(d2)) AS s FROM w GROUP BY 1),
 k AS (SELECT count(*) AS k FROM s), n AS (SELECT count(*) AS n, sum(d2) AS wss FROM w),
 r AS (SELECT a.cluster, max((sa.s + sb.s) / g) AS r FROM (SELECT a.cluster, b.cluster AS other, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS g FROM c a JOIN c b ON a.f = b.f AND a.cluster <> b.cluster GROUP BY 1, 2) a
 JOIN s sa ON sa.cluster = a.cluster JOIN s sb ON sb.cluster = a.other GROUP BY 1)"""


@query("clu5_separation_indices", rsql(f"{_LONG} SELECT (tss - wss) * (n - k) / (wss * (k - 1)) AS calinski_harabasz, (SELECT avg(r) FROM r) AS davies_bouldin FROM t, n, k", "calinski_harabasz davies_bouldin"))
def clu5(spark, d):
    return rounded(G.separation_indices(G.standardise(_labelled(spark, d), NUM), "cluster", NUM, CAT))


@query("clu6_k_sweep")
def clu6(spark, d):
    df = G.standardise(_frame(spark, d), NUM)
    return G.sweep(df, NUM, CAT, "p_partkey")


@query("clu6_best_k")
def clu6_best(spark, d):
    """The k of 2 to 7 with the widest silhouette."""
    return rounded(G.best_k(clu6(spark, d)))


@query("clu7_segment_profile", rsql(
    f"WITH {LABELLED_SQL}, mb AS (SELECT cluster, p_brand, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, p_brand) AS rn FROM l GROUP BY 1, 2), "
    "mt AS (SELECT cluster, p_type, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, p_type) AS rn FROM l GROUP BY 1, 2) "
    "SELECT l.cluster, count(*) AS n, avg(p_retailprice) AS mean_score, avg(p_size) AS mean_p_size, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM l) AS pct, any_value(mb.p_brand) AS modal_p_brand, any_value(mt.p_type) AS modal_p_type "
    "FROM l JOIN mb ON mb.cluster = l.cluster AND mb.rn = 1 JOIN mt ON mt.cluster = l.cluster AND mt.rn = 1 GROUP BY 1", "mean_score mean_p_size pct"))
def clu7(spark, d):
    return rounded(G.segment_profile(_labelled(spark, d), "cluster", "p_retailprice", ["p_size"], CAT))


@query("clu8_standardised_profile", rsql(
    f"WITH {LABELLED_SQL}, s AS (SELECT avg(p_size) ms, stddev_samp(p_size) ss, avg(p_retailprice) mp, stddev_samp(p_retailprice) sp FROM l) "
    "SELECT cluster, (avg(p_size) - any_value(ms)) / any_value(ss) AS z_p_size, (avg(p_retailprice) - any_value(mp)) / any_value(sp) AS z_p_retailprice FROM l, s GROUP BY 1", "z_p_size z_p_retailprice"))
def clu8(spark, d):
    return rounded(G.standardised_profile(_labelled(spark, d), "cluster", NUM))

"""Descriptive tables and associations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.operators import association, repair as R, summary as A
from hearthline.queries.q_scalars import AGE_SQL, NO_LOFT_SQL, FLAG_SQL, era_sql
from hearthline.queries.registry import query, rounded, rsql
from hearthline.queries.roles import band_sql, cert_cte, certificates, pred_cte, predictions, rec_cte, recommendations, table

NAME_SQL = "trim(split_part(IMPROVEMENT_SUMMARY_TEXT, ',', 1))"
MID = "(cost_low + cost_high) / 2.0"


def _q(expr: str, p: float) -> str:
    return f"CAST(quantile_cont(CAST({expr} AS DOUBLE), {p}::DOUBLE) AS DOUBLE)"


@query("agg1_measure_summary", rsql(
    f'WITH {rec_cte()} SELECT IMPROVEMENT_SUMMARY_TEXT AS measure, count(*) AS "count", avg({MID}) AS cost_mid_mean, {_q("cost_low", .5)} AS cost_low_median, '
    f'{_q("cost_high", .5)} AS cost_high_median, {_q(MID, .5)} AS cost_mid_median FROM rec GROUP BY 1',
    "cost_mid_mean cost_low_median cost_high_median cost_mid_median"))
def agg1(spark, d):
    return rounded(A.measure_summary(recommendations(spark, d, "IMPROVEMENT_SUMMARY_TEXT", "INDICATIVE_COST")))


@query("agg2_total_cost", f"WITH {rec_cte()} SELECT LMK_KEY, coalesce(sum({MID}), 0.0) AS total_cost FROM rec GROUP BY 1")
def agg2(spark, d):
    return A.total_cost(recommendations(spark, d, "LMK_KEY", "INDICATIVE_COST"))


@query("agg3_cost_effectiveness", f'WITH {rec_cte()}, r AS (SELECT {NAME_SQL} AS measure, {MID} AS mid FROM rec) SELECT measure, count(*) AS "count", '
       f'{_q("mid", .5)} AS median_cost FROM r WHERE measure IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')
def agg3(spark, d):
    return A.cost_effectiveness(recommendations(spark, d, "IMPROVEMENT_SUMMARY_TEXT", "INDICATIVE_COST"))


def _domain_rows(col: str, source: str) -> str:
    dom = ", ".join(f"('{b}', {i})" for i, b in enumerate(C.BANDS))
    return (
        f"SELECT v.value, CAST(v.ord AS INT) AS ord, count(s.b) AS n, count(s.b)::DOUBLE / sum(count(s.b)) OVER () AS share "
        f"FROM (VALUES {dom}) v(value, ord) LEFT JOIN (SELECT {col} AS b FROM {source}) s ON s.b = v.value GROUP BY 1, 2"
    )


@query("agg4_domain_counts", rsql(f"WITH {cert_cte()} {_domain_rows('CURRENT_ENERGY_RATING', '(SELECT * FROM cert WHERE CURRENT_ENERGY_EFFICIENCY < 80)')}", "share"))
def agg4(spark, d):
    df = certificates(spark, d, C.TARGET, C.SCORE).where(F.col(C.SCORE) < 80)
    return rounded(A.domain_counts(df, C.TARGET))


@query("agg4_all_domain_counts", rsql(f"WITH {cert_cte()} {_domain_rows('CURRENT_ENERGY_RATING', 'cert')}", "share"))
def agg4_all(spark, d):
    return rounded(A.domain_counts(certificates(spark, d, C.TARGET), C.TARGET))


def _pivot_sql(row: str, col: str, source: str, share: bool = False) -> str:
    total = " + ".join(f"count(*) FILTER ({col} = '{b}')" for b in C.BANDS)
    cells = ", ".join(
        f"count(*) FILTER ({col} = '{b}')" + (f"::DOUBLE / nullif({total}, 0)" if share else "") + f" AS {b}" for b in C.BANDS
    )
    return f"SELECT {row}, {cells} FROM {source} GROUP BY {row}"


@query("agg5_crosstab", f"WITH {cert_cte()} {_pivot_sql('PROPERTY_TYPE', 'CURRENT_ENERGY_RATING', 'cert')}")
def agg5(spark, d):
    return A.crosstab(certificates(spark, d, "PROPERTY_TYPE", C.TARGET), "PROPERTY_TYPE", C.TARGET, C.BANDS)


@query("agg6_row_shares", rsql(f"WITH {cert_cte()} {_pivot_sql('BUILT_FORM', 'CURRENT_ENERGY_RATING', 'cert', True)}", " ".join(C.BANDS)))
def agg6(spark, d):
    return rounded(A.crosstab(certificates(spark, d, "BUILT_FORM", C.TARGET), "BUILT_FORM", C.TARGET, C.BANDS, normalise=True))


@query("agg7_group_profile", rsql(
    f"WITH {cert_cte()}, m AS (SELECT PROPERTY_TYPE, BUILT_FORM, row_number() OVER (PARTITION BY PROPERTY_TYPE ORDER BY count(*) DESC, BUILT_FORM) AS rn "
    "FROM cert WHERE BUILT_FORM IS NOT NULL GROUP BY 1, 2) "
    f"SELECT c.PROPERTY_TYPE, count(*) AS n, avg(CURRENT_ENERGY_EFFICIENCY) AS mean_score, {_q('CURRENT_ENERGY_EFFICIENCY', .5)} AS median_score, "
    "any_value(m.BUILT_FORM) AS modal FROM cert c LEFT JOIN m ON m.PROPERTY_TYPE = c.PROPERTY_TYPE AND m.rn = 1 GROUP BY 1", "mean_score median_score"))
def agg7(spark, d):
    return rounded(A.group_profile(certificates(spark, d, "PROPERTY_TYPE", C.SCORE, "BUILT_FORM"), "PROPERTY_TYPE", C.SCORE, "BUILT_FORM"))


_ERAS = [lab for _, _, lab in C.ERA_LEFT_CLOSED]
_TYPES = ["House", "Flat", "Bungalow", "Maisonette", "Park home"]


def _eras(spark, d):
    df = certificates(spark, d, "CONSTRUCTION_AGE_BAND", "PROPERTY_TYPE", C.SCORE)
    aged = df.withColumn("age", S.construction_age_num(F.col("CONSTRUCTION_AGE_BAND")))
    return aged.where(F.col("age").between(0, 2099)).withColumn("era", S.era(F.col("age")))


_ERA_CTE = f"e AS (SELECT {era_sql(AGE_SQL, C.ERA_LEFT_CLOSED, False)} AS era, PROPERTY_TYPE, CURRENT_ENERGY_EFFICIENCY AS score FROM cert)"
_WIDE = ", ".join(f"avg(score) FILTER (PROPERTY_TYPE = '{t}') AS \"{t}\"" for t in _TYPES)
_CELLS = ", ".join(f'"{t}"' for t in _TYPES)


@query("agg8_mean_pivot", rsql(
    f"WITH {cert_cte()}, {_ERA_CTE}, w AS (SELECT era, {_WIDE} FROM e WHERE era IS NOT NULL GROUP BY era) SELECT *, greatest({_CELLS}) - least({_CELLS}) AS gap FROM w",
    'House Flat Bungalow Maisonette "Park home" gap'.replace('"Park home"', ""))
    .replace("REPLACE (", 'REPLACE (floor("Park home" * 1e6::DOUBLE + 0.50001::DOUBLE) / 1e6::DOUBLE AS "Park home", '))
def agg8(spark, d):
    return rounded(A.mean_pivot(_eras(spark, d), "era", "PROPERTY_TYPE", _TYPES, C.SCORE))


@query("agg8_mean_long", rsql(f"WITH {cert_cte()}, {_ERA_CTE} SELECT era, PROPERTY_TYPE AS variable, avg(score) AS \"value\" FROM e WHERE era IS NOT NULL GROUP BY ALL", "value"))
def agg8_long(spark, d):
    wide = A.mean_pivot(_eras(spark, d), "era", "PROPERTY_TYPE", _TYPES, C.SCORE)
    return rounded(A.melt(wide, ["era"], _TYPES))


@query("agg9_cell_means", rsql(f"WITH {cert_cte()} SELECT PROPERTY_TYPE, BUILT_FORM, count(*) AS n, avg(CURRENT_ENERGY_EFFICIENCY) AS mean_score FROM cert "
       "WHERE BUILT_FORM IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 14", "mean_score"))
def agg9(spark, d):
    df = certificates(spark, d, "PROPERTY_TYPE", "BUILT_FORM", C.SCORE).where(F.col("BUILT_FORM").isNotNull())
    return rounded(A.cell_means(df, ["PROPERTY_TYPE", "BUILT_FORM"], C.SCORE))


_QUART = lambda e: ", ".join(f"{_q(e, p)} AS {n}" for n, p in A.QUARTILES.items())


@query("agg10_top_category_spread", rsql(
    "WITH t AS (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 8) SELECT p_name, count(p_retailprice) AS n, min(p_retailprice) AS low, "
    f"max(p_retailprice) AS high, {_QUART('p_retailprice')} FROM part WHERE p_name IN (SELECT p_name FROM t) GROUP BY 1", "low high q1 median q3"))
def agg10(spark, d):
    part = table(spark, d, "part").select("p_name", "p_retailprice")
    return rounded(A.quartiles_by_group(A.top_categories(part, "p_name", 8), "p_name", "p_retailprice"))


@query("agg11_quartiles_by_group", rsql(f"SELECT o_orderpriority, count(o_totalprice) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, {_QUART('o_totalprice')} "
       "FROM orders GROUP BY 1", "low high q1 median q3"))
def agg11(spark, d):
    return rounded(A.quartiles_by_group(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


@query("agg12_histogram", rsql(
    f"WITH {cert_cte()}, s AS (SELECT min(TOTAL_FLOOR_AREA) AS lo, max(TOTAL_FLOOR_AREA) AS hi FROM cert), "
    "c AS (SELECT CAST(least(floor((TOTAL_FLOOR_AREA - lo) / ((hi - lo) / 40.0)), 39) AS INT) AS bin, count(*) AS n FROM cert, s WHERE TOTAL_FLOOR_AREA IS NOT NULL GROUP BY 1) "
    f"SELECT CAST(g.bin AS INT) AS bin, lo + (hi - lo) / 40.0 * g.bin AS left_edge, lo + (hi - lo) / 40.0 * (g.bin + 1) AS right_edge, coalesce(n, 0) AS n, "
    f"{band_sql('(lo + (hi - lo) / 40.0 * g.bin)')} AS band FROM range(40) g(bin) LEFT JOIN c USING (bin), s", "left_edge right_edge"))
def agg12(spark, d):
    bins = A.histogram(certificates(spark, d, "TOTAL_FLOOR_AREA"), "TOTAL_FLOOR_AREA")
    return rounded(bins.withColumn("band", S.score_to_band(F.col("left_edge"))))


_DESC = ["TOTAL_FLOOR_AREA", "NUMBER_HABITABLE_ROOMS", "CO2_EMISSIONS_CURRENT", "CURRENT_ENERGY_EFFICIENCY"]


@query("agg13_describe", rsql(
    f"WITH {cert_cte()} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS \"min\", CAST(max({c}) AS DOUBLE) AS \"max\", "
        f"avg(CAST({c} IS NULL AS DOUBLE)) * 100 AS pct_missing, {_QUART(c)} FROM cert" for c in _DESC), "mean std pct_missing q1 median q3")
    .replace("REPLACE (", 'REPLACE (floor("min" * 1e6::DOUBLE + 0.50001::DOUBLE) / 1e6::DOUBLE AS "min", floor("max" * 1e6::DOUBLE + 0.50001::DOUBLE) / 1e6::DOUBLE AS "max", '))
def agg13(spark, d):
    return rounded(A.describe(certificates(spark, d, *_DESC)))


_MISS = ["UPRN", "POSTCODE", "BUILT_FORM", "FLOOR_LEVEL", "NUMBER_HEATED_ROOMS", "TENURE", "WALLS_DESCRIPTION", "CURRENT_ENERGY_RATING", "MAIN_FUEL"]


@query("agg14_missingness_ranking", rsql(
    f"WITH {cert_cte()} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(CAST({c} IS NULL AS DOUBLE)) AS null_rate FROM cert" for c in _MISS)
    + ") ORDER BY null_rate DESC, 1 LIMIT 5", "null_rate"))
def agg14(spark, d):
    return rounded(A.missingness_ranking(certificates(spark, d, *_MISS), 5))


@query("agg15_yearly_volume", f"WITH {cert_cte()} SELECT year(INSPECTION_DATE) AS \"year\", count(*) AS n FROM cert GROUP BY 1")
def agg15(spark, d):
    return A.yearly_volume(certificates(spark, d, "INSPECTION_DATE"))


@query("agg15_event_volume", "SELECT year(ts) AS \"year\", count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def agg15_events(spark, d):
    return A.yearly_volume(table(spark, d, "events").where("event_type = 'purchase'"), "ts")


@query("agg16_cohort_counts", f"WITH {cert_cte()}, e AS (SELECT {AGE_SQL} AS age, {FLAG_SQL['FLAG_SOLID_BRICK_BARE']} AS sb, {NO_LOFT_SQL} AS nl, {FLAG_SQL['FLAG_SINGLE_GLAZED']} AS sg FROM cert) "
       "SELECT count(*) AS n_total, count(*) FILTER (age < 1930) AS pre_1930, count(*) FILTER (sb = 1) AS solid_bare, count(*) FILTER (nl = 1) AS no_loft, "
       "count(*) FILTER (sg = 1) AS single_glazed, count(*) FILTER (age >= 1900 AND age < 1950 AND sg = 1) AS single_glazed_1900_1949 FROM e")
def agg16(spark, d):
    age = F.col("age")
    single = S.text_flag(F.col("WINDOWS_DESCRIPTION"), C.TEXT_FLAGS["FLAG_SINGLE_GLAZED"][1]) == 1
    df = certificates(spark, d, "CONSTRUCTION_AGE_BAND", "WALLS_DESCRIPTION", "ROOF_DESCRIPTION", "WINDOWS_DESCRIPTION")
    df = df.withColumn("age", S.construction_age_num(F.col("CONSTRUCTION_AGE_BAND")))
    return A.conditional_counts(df, {
        "n_total": F.lit(True), "pre_1930": age < 1930,
        "solid_bare": S.text_flag(F.col("WALLS_DESCRIPTION"), C.TEXT_FLAGS["FLAG_SOLID_BRICK_BARE"][1]) == 1,
        "no_loft": S.text_flag(F.col("ROOF_DESCRIPTION"), C.NO_LOFT_PATTERN) == 1, "single_glazed": single,
        "single_glazed_1900_1949": (age >= 1900) & (age < 1950) & single,
    })


@query("agg17_district_density", rsql(
    f"WITH {cert_cte()}, e AS (SELECT coalesce(split_part(upper(POSTCODE), ' ', 1), 'UNK') AS district, {AGE_SQL} AS age FROM cert) "
    "SELECT district, count(*) AS n, count(*) FILTER (age < 1900) AS n_match, count(*) FILTER (age < 1900) * 100.0::DOUBLE / count(*) AS pct FROM e GROUP BY 1 HAVING count(*) >= 500", "pct"))
def agg17(spark, d):
    df = certificates(spark, d, "POSTCODE", "CONSTRUCTION_AGE_BAND").withColumn("district", S.postcode_district(F.col("POSTCODE")))
    return rounded(A.group_density(df, "district", S.construction_age_num(F.col("CONSTRUCTION_AGE_BAND")) < 1900))


@query("agg18_cardinalities", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")))
def agg18(spark, d):
    return A.cardinalities(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"])


@query("agg19_kpis", rsql(f"WITH {cert_cte()} SELECT count(*) AS n, avg(CURRENT_ENERGY_EFFICIENCY) AS mean_score, avg(CAST(coalesce(CURRENT_ENERGY_RATING IN ('A', 'B', 'C'), false) AS DOUBLE)) AS share_wanted FROM cert", "mean_score share_wanted"))
def agg19(spark, d):
    return rounded(A.kpis(certificates(spark, d, C.SCORE, C.TARGET), C.SCORE, C.TARGET, ["A", "B", "C"]))


@query("agg20_per_dwelling", rsql(f"WITH {rec_cte()}, e AS (SELECT LMK_KEY, count(*) AS m, coalesce(sum({MID}), 0) AS c FROM rec GROUP BY 1) "
       f"SELECT {_q('m', .5)} AS median_measures, {_q('c', .5)} AS median_cost, avg(m) AS mean_measures, avg(c) AS mean_cost FROM e", "median_measures median_cost mean_measures mean_cost", 4), )
def agg20(spark, d):
    return rounded(A.per_dwelling(recommendations(spark, d, "LMK_KEY", "INDICATIVE_COST")), 4)


_FLAGS3 = ["FLAG_HEAT_PUMP", "FLAG_TRIPLE_GLAZED", "FLAG_GAS_BOILER"]


@query("agg21_flag_summary", rsql(f"WITH {cert_cte()}, e AS (SELECT {', '.join(f'{FLAG_SQL[f]} AS {f}' for f in _FLAGS3)} FROM cert) "
       + " UNION ALL ".join(f"SELECT '{f}' AS flag, avg({f}) AS mean, avg(CAST({f} <> 0 AS DOUBLE)) AS nonzero_share FROM e" for f in _FLAGS3), "mean nonzero_share"))
def agg21(spark, d):
    df = certificates(spark, d, *{C.TEXT_FLAGS[f][0] for f in _FLAGS3})
    flags = df.select(*[S.text_flag(F.col(C.TEXT_FLAGS[f][0]), C.TEXT_FLAGS[f][1]).alias(f) for f in _FLAGS3])
    return rounded(A.flag_summary(flags, _FLAGS3))


@query("agg22_median_gap", rsql(f"WITH {cert_cte()}, m AS (SELECT PROPERTY_TYPE, {_q('TOTAL_FLOOR_AREA', .5)} AS median_score FROM cert GROUP BY 1) "
       "SELECT *, (SELECT max(median_score) - min(median_score) FROM m) AS gap FROM m", "median_score gap"))
def agg22(spark, d):
    return rounded(A.median_gap(certificates(spark, d, "PROPERTY_TYPE", "TOTAL_FLOOR_AREA"), "PROPERTY_TYPE", "TOTAL_FLOOR_AREA"))


@query("agg23_conditional_workbook", rsql(
    f"WITH {cert_cte()} SELECT REPORT_TYPE, count(*) AS n, count(*) FILTER (TOTAL_FLOOR_AREA > 100) AS n_match, avg(CURRENT_ENERGY_EFFICIENCY) FILTER (TOTAL_FLOOR_AREA > 100) AS mean_match, "
    f"stddev_samp(CURRENT_ENERGY_EFFICIENCY) AS std, {_QUART('CURRENT_ENERGY_EFFICIENCY')} FROM cert GROUP BY 1", "mean_match std q1 median q3"))
def agg23(spark, d):
    df = certificates(spark, d, "REPORT_TYPE", C.SCORE, "TOTAL_FLOOR_AREA")
    return rounded(A.conditional_workbook(df, "REPORT_TYPE", C.SCORE, F.col("TOTAL_FLOOR_AREA") > 100, bounded=True))


_SPEAR = ["TOTAL_FLOOR_AREA", "NUMBER_HABITABLE_ROOMS", "CO2_EMISSIONS_CURRENT"]


def _rank_sql(c: str, part: str = "") -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"


def _rho_sql(source: str, pairs) -> str:
    cols = sorted({c for p in pairs for c in p})
    ranks = f"(SELECT {', '.join(f'{_rank_sql(c)} AS r_{c}' for c in cols)} FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)})"
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, corr(r_{a}, r_{b}) AS rho FROM {ranks}" for a, b in pairs)


_PAIRS = [(_SPEAR[0], _SPEAR[1]), (_SPEAR[0], _SPEAR[2]), (_SPEAR[1], _SPEAR[2])]


@query("agg24_spearman_complete", rsql(f"WITH {cert_cte()} {_rho_sql('cert', _PAIRS)}", "rho"))
def agg24(spark, d):
    return rounded(association.spearman(certificates(spark, d, *_SPEAR), _SPEAR, bounded=_SPEAR[1:]))


@query("agg24_spearman_pairwise", rsql(f"WITH {cert_cte()} " + " UNION ALL ".join(_rho_sql("cert", [p]) for p in _PAIRS), "rho"))
def agg24_pairwise(spark, d):
    return rounded(association.spearman(certificates(spark, d, *_SPEAR), _SPEAR, pairwise=True, bounded=_SPEAR[1:]))


def _cramer_sql(source: str, a: str, b: str) -> str:
    return f"""c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
 ra AS (SELECT a, sum(o)::DOUBLE AS r FROM c GROUP BY a), cb AS (SELECT b, sum(o)::DOUBLE AS k FROM c GROUP BY b), t AS (SELECT sum(o)::DOUBLE AS n FROM c),
 z AS (SELECT (SELECT count(*) FROM ra) AS nr, (SELECT count(*) FROM cb) AS nc),
 g AS (SELECT coalesce(o, 0)::DOUBLE AS o, r * k / n AS e FROM ra CROSS JOIN cb CROSS JOIN t LEFT JOIN c ON c.a = ra.a AND c.b = cb.b),
 x AS (SELECT sum(power(CASE WHEN nr = 2 AND nc = 2 THEN greatest(abs(o - e) - 0.5, 0.0) ELSE o - e END, 2) / e) AS chi2 FROM g, z)
 SELECT '{a}' AS x, '{b}' AS y, CAST(n AS BIGINT) AS n, chi2, sqrt(chi2 / (n * (least(nr, nc) - 1))) AS v FROM x, t, z"""


@query("agg25_cramers_v", rsql(f"WITH {cert_cte()}, {_cramer_sql('cert', 'WALLS_DESCRIPTION', 'CURRENT_ENERGY_RATING')}", "chi2 v", 5))
def agg25(spark, d):
    return rounded(association.cramers_v(certificates(spark, d, "WALLS_DESCRIPTION", C.TARGET), "WALLS_DESCRIPTION", C.TARGET), 5)


@query("agg25_cramers_v_yates", rsql(f"WITH {_cramer_sql('labels', 'quality', 'toxic')}", "chi2 v", 5))
def agg25_yates(spark, d):
    return rounded(association.cramers_v(table(spark, d, "labels"), "quality", "toxic"), 5)


@query("agg26_term_frequency", f"WITH {rec_cte()} SELECT {NAME_SQL} AS term, count(*) AS n FROM rec WHERE IMPROVEMENT_SUMMARY_TEXT IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 45")
def agg26(spark, d):
    return A.term_frequency(recommendations(spark, d, "IMPROVEMENT_SUMMARY_TEXT"), S.measure_name(F.col("IMPROVEMENT_SUMMARY_TEXT")))


@query("agg26_document_terms", "SELECT term, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS term FROM documents) WHERE term <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 45")
def agg26_documents(spark, d):
    return A.term_frequency(table(spark, d, "documents"), F.explode(F.split(F.lower("text"), " ")))


@query("agg27_baskets", f"WITH {rec_cte()} SELECT LMK_KEY, string_agg(DISTINCT {NAME_SQL}, '|' ORDER BY {NAME_SQL}) AS items FROM rec WHERE IMPROVEMENT_SUMMARY_TEXT IS NOT NULL GROUP BY 1")
def agg27(spark, d):
    recs = recommendations(spark, d, "LMK_KEY", "IMPROVEMENT_SUMMARY_TEXT")
    named = recs.select("LMK_KEY", S.measure_name(F.col("IMPROVEMENT_SUMMARY_TEXT")).alias("item"))
    return A.baskets(named, "LMK_KEY", "item").withColumn("items", F.array_join("items", "|"))


@query("agg28_fold_aggregate", rsql(
    f"WITH {pred_cte()}, f AS (SELECT seg, part % 5 AS fold, avg(abs(y - yhat)) AS mae, avg(CAST(t = p AS DOUBLE)) AS acc FROM pred GROUP BY ALL) "
    "SELECT seg, count(*) AS folds, avg(mae) AS mae_mean, stddev_samp(mae) AS mae_std, avg(acc) AS acc_mean, stddev_samp(acc) AS acc_std FROM f GROUP BY 1", "mae_mean mae_std acc_mean acc_std"))
def agg28(spark, d):
    folds = predictions(spark, d).groupBy("seg", (F.col("part") % 5).alias("fold")).agg(
        F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"), F.avg((F.col("t") == F.col("p")).cast("double")).alias("acc"))
    return rounded(A.fold_aggregate(folds, "seg", ["mae", "acc"]))


@query("top1_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def top1(spark, d):
    return A.top(table(spark, d, "part").select("p_partkey", "p_retailprice"), 20, F.desc("p_retailprice"), F.asc("p_partkey"))


@query("top2_top_categories", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 8)")
def top2(spark, d):
    return A.top_categories(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 8).select("p_partkey", "p_brand")


@query("top3_arg_max", rsql(f"WITH {pred_cte()}, m AS (SELECT seg, avg(CAST(t = p AS DOUBLE)) AS accuracy FROM pred GROUP BY 1) SELECT seg, accuracy FROM m ORDER BY accuracy DESC, seg LIMIT 1", "accuracy"))
def top3(spark, d):
    m = predictions(spark, d, "seg", "t", "p").groupBy("seg").agg(F.avg((F.col("t") == F.col("p")).cast("double")).alias("accuracy"))
    return rounded(A.arg_max(m, "seg", "accuracy"))

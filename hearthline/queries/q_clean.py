"""Sources, sinks, projections, filters, cleaning, splits, windows and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.functions.hashing import uniform
from hearthline.operators import checks, dedup, joins, repair as R, roles as P, splits as L
from hearthline.operators.evaluation import with_quantile_bin
from hearthline.operators.summary import baskets
from hearthline.plans import cleaning, featuring
from hearthline.queries.q_scalars import AGE_SQL, HEATED_CAPPED, WALL_SQL, engineered_cte
from hearthline.queries.registry import query, rounded, rsql
from hearthline.queries.roles import (
    CERTIFICATE, cert_cte, certificates, code_sql, hash_sql, pred_cte, predictions, rec_cte, recommendations, table, uniform_sql,
)
from hearthline.session import scratch_path
from hearthline.sources import readers, sinks

CUT = "1999-12-31"

# --- sources and sinks ----------------------------------------------------------------------------


def _written_csv(spark, d, df, label):
    path = scratch_path(spark, label)
    df.write.option("header", True).csv(path)
    return path


@query(
    "src1_read_certificates",
    f"WITH {cert_cte()} SELECT CAST(LMK_KEY AS VARCHAR) AS LMK_KEY, UPRN, INSPECTION_DATE, REPORT_TYPE, CURRENT_ENERGY_EFFICIENCY, "
    f"TOTAL_FLOOR_AREA, CASE WHEN upper(trim(MAIN_FUEL)) IN {C.SENTINELS} THEN NULL ELSE MAIN_FUEL END AS MAIN_FUEL, "
    "POSTCODE FROM cert",
)
def src1(spark, d):
    cols = ["LMK_KEY", "UPRN", "INSPECTION_DATE", "REPORT_TYPE", "CURRENT_ENERGY_EFFICIENCY", "TOTAL_FLOOR_AREA", "MAIN_FUEL", "POSTCODE"]
    source = certificates(spark, d, *cols)
    return readers.read_certificates(spark, _written_csv(spark, d, source, "certificates")).select(*cols)


@query(
    "src2_read_recommendations",
    f"WITH {rec_cte()} SELECT CAST(LMK_KEY AS VARCHAR) AS LMK_KEY, CAST(IMPROVEMENT_ITEM AS VARCHAR) AS IMPROVEMENT_ITEM, "
    "INDICATIVE_COST FROM rec",
)
def src2(spark, d):
    cols = ["LMK_KEY", "IMPROVEMENT_ITEM", "INDICATIVE_COST"]
    path = _written_csv(spark, d, recommendations(spark, d, *cols), "recommendations")
    return readers.read_recommendations(spark, path, cols)


@query("src3_reconcile_aliases", "SELECT o_orderkey AS ENVIRONMENTAL_IMPACT_CURRENT, o_custkey AS ENVIRONMENTAL_IMPACT_POTENTIAL FROM orders")
def src3(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey AS ENVIRONMENT_IMPACT_CURRENT", "o_custkey AS ENVIRONMENTAL_IMPACT_POTENTIAL")
    return P.reconcile_aliases(df)


@query(
    "src4_read_published",
    f"WITH {cert_cte()} SELECT LMK_KEY, CAST(CURRENT_ENERGY_EFFICIENCY AS DOUBLE) AS CURRENT_ENERGY_EFFICIENCY, "
    "year(INSPECTION_DATE) AS INSPECTION_YEAR, CO2_EMISSIONS_CURRENT FROM cert",
)
def src4(spark, d):
    path = scratch_path(spark, "published")
    published = certificates(spark, d, "LMK_KEY", "CURRENT_ENERGY_EFFICIENCY", "INSPECTION_DATE", "CO2_EMISSIONS_CURRENT")
    sinks.write_published(published, path)
    return readers.read_published(spark, path).select("LMK_KEY", C.SCORE, "INSPECTION_YEAR", "CO2_EMISSIONS_CURRENT")


@query("src5_read_scored_split", f"WITH {pred_cte()} SELECT seg, count(*) AS n FROM pred WHERE split = 'test' GROUP BY seg")
def src5(spark, d):
    path = scratch_path(spark, "scored")
    sinks.write_predictions(predictions(spark, d, "seg", "y", "yhat", "split"), path)
    return readers.read_scored(spark, path).groupBy("seg").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src6_declared_schema",
    f"WITH {cert_cte()} SELECT CAST(LMK_KEY AS VARCHAR) AS LMK_KEY, UPRN, REPORT_TYPE, TOTAL_FLOOR_AREA, INSPECTION_DATE FROM cert",
)
def src6(spark, d):
    wanted = {c: C.CERTIFICATE_TYPES[c] for c in ("LMK_KEY", "UPRN", "REPORT_TYPE", "TOTAL_FLOOR_AREA", "INSPECTION_DATE")}
    schema = readers.declared_schema(wanted)
    path = _written_csv(spark, d, certificates(spark, d, *wanted), "declared")
    return spark.read.schema(schema).option("header", True).csv(path)


@query("snk1_write_published", f"WITH {cert_cte()} SELECT CAST(year(INSPECTION_DATE) AS INT) AS _year, count(*) AS n FROM cert GROUP BY 1")
def snk1(spark, d):
    path = scratch_path(spark, "sink-published")
    sinks.write_published(P.publishable(certificates(spark, d)), path)
    return spark.read.parquet(path).groupBy("_year").agg(F.count(F.lit(1)).alias("n"))


@query("snk3_write_predictions", f"WITH {pred_cte()} SELECT split, count(*) AS n FROM pred GROUP BY 1")
def snk3(spark, d):
    path = scratch_path(spark, "sink-predictions")
    sinks.write_predictions(predictions(spark, d), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("snk4_write_report", f"WITH {pred_cte()} SELECT seg, t, count(*) AS n FROM pred GROUP BY 1, 2")
def snk4(spark, d):
    path = scratch_path(spark, "sink-report")
    sinks.write_report(predictions(spark, d).groupBy("seg", "t").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("seg string, t int, n bigint").json(path)


# --- projections and filters ----------------------------------------------------------------------


@query("prj1_drop_role", f"WITH {cert_cte()} SELECT * EXCLUDE (CURRENT_ENERGY_EFFICIENCY, POTENTIAL_ENERGY_RATING, CO2_EMISSIONS_CURRENT, "
       "ENERGY_CONSUMPTION_CURRENT, WALLS_ENERGY_EFF, INSPECTION_DATE) FROM cert")
def prj1(spark, d):
    return P.drop_role(certificates(spark, d).drop("INSPECTION_DATE"), "leakage", "element")


@query("prj2_publishable", f"WITH {cert_cte()} SELECT * EXCLUDE (UPRN, BUILDING_REFERENCE_NUMBER, ADDRESS1, POSTCODE, LOCAL_AUTHORITY, "
       "INSPECTION_DATE) FROM cert")
def prj2(spark, d):
    return P.publishable(certificates(spark, d)).drop("INSPECTION_DATE")


_FLAGGED = ["NUMBER_HABITABLE_ROOMS", "BUILT_FORM", "CONSTRUCTION_AGE_BAND", "WALLS_DESCRIPTION", "ROOF_DESCRIPTION",
            "WINDOWS_DESCRIPTION", "MAINHEAT_DESCRIPTION", "TENURE"]


@query(
    "prj3_model_matrix",
    f"WITH {cert_cte()} SELECT LMK_KEY, CURRENT_ENERGY_RATING AS label_band, CURRENT_ENERGY_EFFICIENCY AS label_score, TOTAL_FLOOR_AREA, "
    f"NUMBER_HABITABLE_ROOMS, PROPERTY_TYPE, {', '.join(f'CAST({c} IS NULL AS DOUBLE) AS {c}_IS_MISSING' for c in _FLAGGED)} FROM cert",
)
def prj3(spark, d):
    df = certificates(spark, d, "LMK_KEY", "POSTCODE", "FLOOR_LEVEL", "CURRENT_ENERGY_RATING", "CURRENT_ENERGY_EFFICIENCY",
                      "WALLS_ENERGY_EFF", "TOTAL_FLOOR_AREA", "PROPERTY_TYPE", *_FLAGGED)
    matrix = P.model_matrix(df, drop_raw_descriptions=False, keep=["LMK_KEY"])
    return matrix.drop("BUILT_FORM", "CONSTRUCTION_AGE_BAND", "WALLS_DESCRIPTION", "ROOF_DESCRIPTION", "WINDOWS_DESCRIPTION",
                       "MAINHEAT_DESCRIPTION", "TENURE")


@query("prj4_feature_contract", f"WITH {cert_cte()} SELECT TOTAL_FLOOR_AREA, PROPERTY_TYPE, REPORT_TYPE FROM cert")
def prj4(spark, d):
    return P.conform(certificates(spark, d), ["TOTAL_FLOOR_AREA", "PROPERTY_TYPE", "REPORT_TYPE"])


@query("flt1_region_guard", f"WITH {cert_cte()} SELECT LMK_KEY, LOCAL_AUTHORITY FROM cert WHERE LOCAL_AUTHORITY = 'R1'")
def flt1(spark, d):
    return cleaning.region_guard(certificates(spark, d, "LMK_KEY", "LOCAL_AUTHORITY"), "R1")


@query("flt1_region_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey "
       "JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def flt1_lookup(spark, d):
    asia = cleaning.region_guard(table(spark, d, "region"), "ASIA", "r_name")
    nations = table(spark, d, "nation").join(asia, F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("flt2_valid_domain", f"WITH {cert_cte()} SELECT LMK_KEY, CURRENT_ENERGY_RATING FROM cert WHERE CURRENT_ENERGY_RATING IN {C.BANDS}")
def flt2(spark, d):
    return R.valid_domain(certificates(spark, d, "LMK_KEY", "CURRENT_ENERGY_RATING"))


@query("flt3_at_least", f"WITH {cert_cte()} SELECT LMK_KEY, TOTAL_FLOOR_AREA FROM cert WHERE coalesce(TOTAL_FLOOR_AREA, 99) >= 10")
def flt3(spark, d):
    return R.at_least(certificates(spark, d, "LMK_KEY", "TOTAL_FLOOR_AREA"), "TOTAL_FLOOR_AREA", 10.0)


@query("flt4_complete_cases", f"WITH {cert_cte()} SELECT LMK_KEY, NUMBER_HABITABLE_ROOMS, BUILT_FORM FROM cert "
       "WHERE NUMBER_HABITABLE_ROOMS IS NOT NULL AND BUILT_FORM IS NOT NULL")
def flt4(spark, d):
    df = certificates(spark, d, "LMK_KEY", "NUMBER_HABITABLE_ROOMS", "BUILT_FORM")
    return R.complete_cases(df, ["NUMBER_HABITABLE_ROOMS", "BUILT_FORM"])


@query("flt5_whitelist_and_range", f"WITH {cert_cte()} SELECT LMK_KEY FROM cert WHERE PROPERTY_TYPE IN ('House', 'Flat') "
       "AND year(INSPECTION_DATE) BETWEEN 1997 AND 1999 AND ENERGY_CONSUMPTION_CURRENT > 0")
def flt5(spark, d):
    df = certificates(spark, d, "LMK_KEY", "PROPERTY_TYPE", "INSPECTION_DATE", "ENERGY_CONSUMPTION_CURRENT")
    wanted = F.col("PROPERTY_TYPE").isin("House", "Flat") & F.year("INSPECTION_DATE").between(1997, 1999)
    return df.where(wanted & (F.col("ENERGY_CONSUMPTION_CURRENT") > 0)).select("LMK_KEY")


@query(
    "rep6_winsorise",
    f"WITH {cert_cte()}, cap AS (SELECT quantile_cont(TOTAL_FLOOR_AREA, 0.995::DOUBLE) AS c FROM cert) "
    "SELECT LMK_KEY, floor((CASE WHEN TOTAL_FLOOR_AREA > c THEN c ELSE TOTAL_FLOOR_AREA END) * 1e6::DOUBLE + 0.50001::DOUBLE) / 1e6::DOUBLE AS TOTAL_FLOOR_AREA FROM cert, cap",
)
def rep6(spark, d):
    return rounded(R.winsorise(certificates(spark, d, "LMK_KEY", "TOTAL_FLOOR_AREA"), "TOTAL_FLOOR_AREA"))


@query("rep7_drop_fully_missing", f"WITH {cert_cte()} SELECT LMK_KEY, BUILT_FORM, UPRN FROM cert")
def rep7(spark, d):
    return R.drop_fully_missing(certificates(spark, d, "LMK_KEY", "BUILT_FORM", "UPRN", "TENURE"))


_NUL2 = ["BUILT_FORM", "POSTCODE", "WINDOWS_DESCRIPTION", "NUMBER_HEATED_ROOMS"]


@query(
    "nul2_missing_flags",
    f"WITH {cert_cte()} SELECT LMK_KEY, CAST(BUILT_FORM IS NULL AS INT) AS BUILT_FORM_IS_MISSING, "
    "CAST(POSTCODE IS NULL AS INT) AS POSTCODE_IS_MISSING, CAST(WINDOWS_DESCRIPTION IS NULL AS INT) AS WINDOWS_DESCRIPTION_IS_MISSING FROM cert",
)
def nul2(spark, d):
    df = certificates(spark, d, "LMK_KEY", "INSPECTION_DATE", *_NUL2)
    train = L.temporal_split(cutoff=CUT) == "train"
    return R.add_missing_flags(df, 0.05, train, cols=_NUL2).drop("INSPECTION_DATE", *_NUL2)


_LOG_SQL = f"""WITH {cert_cte()}, a AS (SELECT *, {HEATED_CAPPED} AS heated FROM cert), r AS (
 SELECT 'heated > habitable' AS rule, count(*) FILTER (NUMBER_HEATED_ROOMS > NUMBER_HABITABLE_ROOMS) AS n_rows_affected, 'clip heated to habitable' AS action, true AS always FROM a
 UNION ALL SELECT 'NUMBER_HEATED_ROOMS == 0', count(*) FILTER (heated = 0), 'set NaN (impossible value)', false FROM a
 UNION ALL SELECT 'NUMBER_HABITABLE_ROOMS == 0', count(*) FILTER (NUMBER_HABITABLE_ROOMS = 0), 'set NaN (impossible value)', false FROM a
 UNION ALL SELECT 'TOTAL_FLOOR_AREA == 0', count(*) FILTER (TOTAL_FLOOR_AREA = 0), 'set NaN (impossible value)', false FROM a
 UNION ALL SELECT 'negative emissions/consumption', count(*) FILTER (CO2_EMISSIONS_CURRENT < 0 OR ENERGY_CONSUMPTION_CURRENT < 0), 'added HAS_ONSITE_GENERATION=1', true FROM a
 UNION ALL SELECT 'habitable_rooms > 30 (HMO)', count(*) FILTER (NUMBER_HABITABLE_ROOMS > 30), 'kept; tracked only', false FROM a)
SELECT rule, n_rows_affected, action FROM r WHERE always OR n_rows_affected > 0"""


@query("snk2_write_cleaning_log", f"SELECT rule, CAST(n_rows_affected AS VARCHAR) AS n_rows_affected, action FROM ({_LOG_SQL})")
def snk2(spark, d):
    path = scratch_path(spark, "sink-log")
    sinks.write_log(R.cleaning_log(certificates(spark, d)), path)
    return spark.read.option("header", True).csv(path)


@query("log1_cleaning_log", _LOG_SQL)
def log1(spark, d):
    return R.cleaning_log(certificates(spark, d))


_CORE_COUNT = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in C.ROLES["core"])
_REPAIRED = f"""fixed AS (SELECT * REPLACE (nullif({HEATED_CAPPED}, 0) AS NUMBER_HEATED_ROOMS, nullif(NUMBER_HABITABLE_ROOMS, 0) AS NUMBER_HABITABLE_ROOMS,
 nullif(TOTAL_FLOOR_AREA, 0) AS TOTAL_FLOOR_AREA),
 CAST(coalesce(CO2_EMISSIONS_CURRENT < 0, false) OR coalesce(ENERGY_CONSUMPTION_CURRENT < 0, false) AS INT) AS HAS_ONSITE_GENERATION
 FROM cert WHERE LOCAL_AUTHORITY = 'R1')"""
_BEST = f"""best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY UPRN ORDER BY
 (coalesce(year(INSPECTION_DATE), 2007) - 2007) * 10 + {_CORE_COUNT} DESC, INSPECTION_DATE DESC, LMK_KEY DESC) AS rn FROM fixed) WHERE UPRN IS NULL OR rn = 1)"""
_CLEAN_COLS = ["LMK_KEY", "UPRN", "NUMBER_HEATED_ROOMS", "NUMBER_HABITABLE_ROOMS", "TOTAL_FLOOR_AREA", "HAS_ONSITE_GENERATION",
               "CURRENT_ENERGY_RATING", "CURRENT_ENERGY_EFFICIENCY", "MAIN_FUEL"]


def _capped_sql(source: str) -> str:
    return f"""cap AS (SELECT quantile_cont(TOTAL_FLOOR_AREA, 0.995::DOUBLE) AS c FROM {source}),
 capped AS (SELECT * REPLACE (CASE WHEN TOTAL_FLOOR_AREA > c THEN c ELSE TOTAL_FLOOR_AREA END AS TOTAL_FLOOR_AREA) FROM {source}, cap),
 clean AS (SELECT * FROM capped WHERE coalesce(TOTAL_FLOOR_AREA, 99) >= 10 AND CURRENT_ENERGY_RATING IN {C.BANDS})"""


CLEAN_CTES = f"{cert_cte()}, {_REPAIRED}, {_BEST}, {_capped_sql('best')}"
LONG_CTES = f"{cert_cte()}, {_REPAIRED}, {_capped_sql('fixed')}"


def _clean_out(df):
    out = df.select(*_CLEAN_COLS, F.lit("TENURE" in df.columns).alias("has_tenure"))
    return rounded(out.withColumn(C.SCORE, F.col(C.SCORE).cast("double")))


_CLEAN_SELECT = (
    f"SELECT {', '.join(_CLEAN_COLS)}, (SELECT avg(CAST(TENURE IS NULL AS DOUBLE)) < 0.999 FROM capped "
    "WHERE coalesce(TOTAL_FLOOR_AREA, 99) >= 10) AS has_tenure FROM clean"
)


@query("cln1_build_clean", rsql(f"WITH {CLEAN_CTES} {_CLEAN_SELECT}", "TOTAL_FLOOR_AREA CURRENT_ENERGY_EFFICIENCY"))
def cln1(spark, d):
    return _clean_out(cleaning.build_clean(certificates(spark, d), "R1"))


@query("cln2_build_longitudinal", rsql(f"WITH {LONG_CTES} {_CLEAN_SELECT}", "TOTAL_FLOOR_AREA CURRENT_ENERGY_EFFICIENCY"))
def cln2(spark, d):
    return _clean_out(cleaning.build_longitudinal(certificates(spark, d), "R1"))


# --- joins ----------------------------------------------------------------------------------------


@query("jn1_of_kept_certificates", f"WITH {cert_cte()}, {rec_cte()} SELECT LMK_KEY, IMPROVEMENT_ITEM, INDICATIVE_COST FROM rec "
       "WHERE LMK_KEY IN (SELECT LMK_KEY FROM cert WHERE LOCAL_AUTHORITY = 'R1')")
def jn1(spark, d):
    kept = cleaning.region_guard(certificates(spark, d, "LMK_KEY", "LOCAL_AUTHORITY"), "R1")
    return joins.of_kept_certificates(recommendations(spark, d, "LMK_KEY", "IMPROVEMENT_ITEM", "INDICATIVE_COST"), kept)


@query("jn2_with_attribute", "SELECT l_orderkey, l_linenumber, l_quantity, p_type FROM lineitem JOIN (SELECT p_partkey, "
       "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS p_type FROM part) ON l_partkey = p_partkey WHERE p_type IS NOT NULL")
def jn2(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_partkey").alias("k"))
    kinds = table(spark, d, "part").selectExpr("p_partkey AS k", "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS p_type")
    return joins.with_attribute(items, kinds, "k").drop("k")


@query("jn3_with_basket", f"WITH {cert_cte()}, {rec_cte()}, b AS (SELECT LMK_KEY, string_agg(DISTINCT IMPROVEMENT_ITEM::VARCHAR, ',' ORDER BY IMPROVEMENT_ITEM::VARCHAR) AS items "
       "FROM rec GROUP BY LMK_KEY) SELECT LMK_KEY, PROPERTY_TYPE, items FROM cert JOIN b USING (LMK_KEY)")
def jn3(spark, d):
    recs = recommendations(spark, d, "LMK_KEY", "IMPROVEMENT_ITEM").withColumn("IMPROVEMENT_ITEM", F.col("IMPROVEMENT_ITEM").cast("string"))
    found = joins.with_basket(certificates(spark, d, "LMK_KEY", "PROPERTY_TYPE"), baskets(recs, "LMK_KEY", "IMPROVEMENT_ITEM"))
    return found.withColumn("items", F.array_join("items", ","))


_LOOKUP = f"""WITH {cert_cte()}, r AS (SELECT LMK_KEY, {WALL_SQL} AS wall, CURRENT_ENERGY_EFFICIENCY AS score, CASE WHEN UPRN % 10 = 3 THEN 'x' ELSE PROPERTY_TYPE END AS kind,
 INSPECTION_DATE <= DATE '{CUT}' AND coalesce(UPRN % 10, 0) <> 3 AS train FROM cert),
 m AS (SELECT wall, kind, quantile_cont(score, 0.5) AS med FROM r WHERE train GROUP BY ALL), g AS (SELECT quantile_cont(score, 0.5) AS med FROM r WHERE train)
 SELECT LMK_KEY, CAST(coalesce(m.med, g.med) AS DOUBLE) AS lookup FROM r LEFT JOIN m USING (wall, kind), g"""


@query("jn4_lookup_with_fallback", _LOOKUP)
def jn4(spark, d):
    df = certificates(spark, d).select(
        "LMK_KEY", S.wall_type(F.col("WALLS_DESCRIPTION")).alias("wall"), F.col(C.SCORE).alias("score"),
        F.when(F.col("UPRN") % 10 == 3, "x").otherwise(F.col("PROPERTY_TYPE")).alias("kind"),
        ((F.col("INSPECTION_DATE") <= F.lit(CUT).cast("date")) & (F.coalesce(F.col("UPRN") % 10, F.lit(0)) != 3)).alias("train"),
    )
    return joins.with_lookup_median(df, F.col("train"), ["wall", "kind"], "score", bounded=True).select("LMK_KEY", "lookup")


_SPL1 = f"CASE WHEN INSPECTION_DATE <= DATE '{CUT}' THEN 'train' WHEN INSPECTION_DATE > DATE '{CUT}' THEN 'test' END"
_SPL2_STEPS = f"""g AS (SELECT UPRN, max(INSPECTION_DATE) AS last FROM cert WHERE UPRN IS NOT NULL GROUP BY UPRN),
 w AS (SELECT LMK_KEY, row_number() OVER (PARTITION BY UPRN ORDER BY INSPECTION_DATE DESC, LMK_KEY DESC) AS rn FROM cert WHERE UPRN IS NOT NULL),
 sp AS (SELECT LMK_KEY, c.UPRN, INSPECTION_DATE, CASE WHEN c.UPRN IS NULL THEN coalesce({_SPL1}, 'discard') WHEN last <= DATE '{CUT}' THEN 'train'
 WHEN rn = 1 THEN 'test' ELSE 'discard' END AS split FROM cert c LEFT JOIN g USING (UPRN) LEFT JOIN w USING (LMK_KEY))"""
_SPL2 = f"{cert_cte('LMK_KEY', 'UPRN', 'INSPECTION_DATE', 'LOCAL_AUTHORITY')}, {_SPL2_STEPS}"
_LATE_CUT = "2001-06-30"
SPLIT_SQL = _SPL2.replace(CUT, _LATE_CUT)


def split_steps_sql(cutoff: str) -> str:
    """CTEs over ``cert`` that end in ``sp``, the split by dwelling and date."""
    return _SPL2_STEPS.replace(CUT, cutoff)


def _group_split(spark, d):
    return L.group_temporal_split(certificates(spark, d, "LMK_KEY", "UPRN", "INSPECTION_DATE", "LOCAL_AUTHORITY"), _LATE_CUT)


@query("jn6_group_overlap", f"WITH {cert_cte()}, s AS (SELECT UPRN, {_SPL1} AS split FROM cert) SELECT count(*) AS shared_groups FROM "
       "(SELECT UPRN FROM s WHERE split = 'train' AND UPRN IS NOT NULL INTERSECT SELECT UPRN FROM s WHERE split = 'test')")
def jn6(spark, d):
    df = certificates(spark, d, "UPRN", "INSPECTION_DATE").withColumn("split", L.temporal_split(cutoff=CUT))
    return checks.group_overlap(df, "UPRN")


@query("jn6_group_overlap_after_split", f"WITH {SPLIT_SQL} SELECT count(*) AS shared_groups FROM (SELECT UPRN FROM sp WHERE split = 'train' AND UPRN IS NOT NULL "
       "INTERSECT SELECT UPRN FROM sp WHERE split = 'test')")
def jn6_after(spark, d):
    return checks.group_overlap(_group_split(spark, d), "UPRN")


@query("jn7_two_run_equality", "SELECT CAST((SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0) AS BIGINT) AS left_only, "
       "CAST((SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0) AS BIGINT) AS right_only")
def jn7(spark, d):
    first = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    second = first.withColumn("o_custkey", F.when(F.col("o_orderkey") % 50 == 0, -1).otherwise(F.col("o_custkey")))
    return checks.table_differences(first, second)


# --- de-duplication and windows -------------------------------------------------------------------


@query("ded1_latest_per_key", f"WITH {cert_cte()}, r AS (SELECT LMK_KEY, UPRN, INSPECTION_DATE, row_number() OVER (PARTITION BY UPRN ORDER BY INSPECTION_DATE DESC, LMK_KEY DESC) AS rn FROM cert) "
       "SELECT LMK_KEY, UPRN, INSPECTION_DATE FROM r WHERE UPRN IS NULL OR rn = 1")
def ded1(spark, d):
    return dedup.latest_per_key(certificates(spark, d, "LMK_KEY", "UPRN", "INSPECTION_DATE"))


@query("ded2_best_quality_per_key", f"WITH {cert_cte()}, r AS (SELECT LMK_KEY, UPRN, INSPECTION_DATE, row_number() OVER (PARTITION BY UPRN ORDER BY "
       f"(coalesce(year(INSPECTION_DATE), 2007) - 2007) * 10 + {_CORE_COUNT} DESC, INSPECTION_DATE DESC, LMK_KEY DESC) AS rn FROM cert) "
       "SELECT LMK_KEY, UPRN, INSPECTION_DATE FROM r WHERE UPRN IS NULL OR rn = 1")
def ded2(spark, d):
    df = certificates(spark, d, "LMK_KEY", "UPRN", "INSPECTION_DATE", *C.ROLES["core"])
    return dedup.best_quality_per_key(df).select("LMK_KEY", "UPRN", "INSPECTION_DATE")


@query("win1_group_max", f"WITH {cert_cte()} SELECT LMK_KEY, UPRN, CASE WHEN UPRN IS NOT NULL THEN max(INSPECTION_DATE) OVER (PARTITION BY UPRN) END AS last_date FROM cert")
def win1(spark, d):
    return L.with_group_max(certificates(spark, d, "LMK_KEY", "UPRN", "INSPECTION_DATE"), "UPRN", "INSPECTION_DATE", "last_date").drop("INSPECTION_DATE")


@query("win2_latest_in_subset", f"WITH {cert_cte()}, r AS (SELECT LMK_KEY, UPRN, row_number() OVER (PARTITION BY UPRN ORDER BY INSPECTION_DATE DESC, LMK_KEY DESC) AS rn "
       "FROM cert WHERE LOCAL_AUTHORITY = 'R1' AND UPRN IS NOT NULL) SELECT LMK_KEY, UPRN FROM r WHERE rn = 1")
def win2(spark, d):
    df = certificates(spark, d, "LMK_KEY", "UPRN", "INSPECTION_DATE", "LOCAL_AUTHORITY")
    subset = df.where((F.col("LOCAL_AUTHORITY") == "R1") & F.col("UPRN").isNotNull())
    return dedup.latest_per_key(subset).select("LMK_KEY", "UPRN")


@query("win3_row_weights", rsql(
    f"WITH {cert_cte()}, n AS (SELECT LMK_KEY, PROPERTY_TYPE, REPORT_TYPE, CASE WHEN UPRN IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY UPRN) END AS u, "
    "count(*) OVER (PARTITION BY PROPERTY_TYPE) AS p, count(*) OVER (PARTITION BY REPORT_TYPE) AS r, count(*) OVER () AS c FROM cert) "
    "SELECT LMK_KEY, 1.0::DOUBLE / u AS w_key, 1.0::DOUBLE / sqrt(p / c) AS w_class, (1.0::DOUBLE / r) / avg(1.0::DOUBLE / r) OVER () AS w_group FROM n",
    "w_key w_class w_group"))
def win3(spark, d):
    df = certificates(spark, d, "LMK_KEY", "UPRN", "PROPERTY_TYPE", "REPORT_TYPE")
    df = L.inverse_count_weight(df, "UPRN", "w_key")
    df = L.inverse_sqrt_share_weight(df, "PROPERTY_TYPE", "w_class")
    return rounded(L.balanced_weight(df, "REPORT_TYPE", "w_group").select("LMK_KEY", "w_key", "w_class", "w_group"))


@query("win4_quantile_bins", f"WITH {cert_cte()}, e AS (SELECT {', '.join(f'quantile_cont(TOTAL_FLOOR_AREA, {k / 10}::DOUBLE) AS e{k}' for k in range(1, 10))} FROM cert) "
       f"SELECT CASE WHEN TOTAL_FLOOR_AREA IS NOT NULL THEN {' + '.join(f'CAST(TOTAL_FLOOR_AREA >= e{k} AS INT)' for k in range(1, 10))} END AS bin, count(*) AS n FROM cert, e GROUP BY 1")
def win4(spark, d):
    df = certificates(spark, d, "TOTAL_FLOOR_AREA")
    return with_quantile_bin(df, "TOTAL_FLOOR_AREA", 10).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("win5_cumulative_probability", rsql(
    "WITH w AS (SELECT o_orderkey, CAST(o_custkey % 5 + 1 AS DOUBLE) AS a, CAST(o_orderkey % 3 + 1 AS DOUBLE) AS b, CAST(2 AS DOUBLE) AS c FROM orders) "
    "SELECT o_orderkey, a / (a + b + c) AS c1, (a + b) / (a + b + c) AS c2, 1.0::DOUBLE AS c3 FROM w", "c1 c2 c3"))
def win5(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", "double(o_custkey % 5 + 1) a", "double(o_orderkey % 3 + 1) b", "double(2) c")
    total = F.col("a") + F.col("b") + F.col("c")
    cum = S.cumulative(F.transform(F.array("a", "b", "c"), lambda x: x / total))
    return rounded(df.withColumn("cum", cum).select("o_orderkey", *[F.col("cum")[i].alias(f"c{i + 1}") for i in range(3)]))


# --- splits and samples ---------------------------------------------------------------------------


@query("spl1_temporal_split", f"WITH {cert_cte()} SELECT LMK_KEY, {_SPL1} AS split FROM cert")
def spl1(spark, d):
    return certificates(spark, d, "LMK_KEY", "INSPECTION_DATE").select("LMK_KEY", L.temporal_split(cutoff=CUT).alias("split"))


@query("spl1_event_split", "SELECT event_type, CASE WHEN CAST(ts AS DATE) <= DATE '2024-01-20' THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM events GROUP BY ALL")
def spl1_events(spark, d):
    df = table(spark, d, "events").select("event_type", F.col("ts").cast("date").alias("day"))
    return df.groupBy("event_type", L.temporal_split("day", "2024-01-20").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("spl2_group_temporal_split", f"WITH {SPLIT_SQL} SELECT LMK_KEY, split FROM sp")
def spl2(spark, d):
    return _group_split(spark, d).select("LMK_KEY", "split")


@query("spl3_stratified_folds", f"SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hash_sql(42, 'o_orderkey')}, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
def spl3(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return L.stratified_folds(df, "o_orderpriority", "o_orderkey").select("o_orderkey", "fold")


_GROUP_KEY = "coalesce(CAST(UPRN AS VARCHAR), 'row:' || CAST(LMK_KEY AS VARCHAR))"


@query("spl4_group_folds", f"WITH {cert_cte()} SELECT LMK_KEY, CAST({hash_sql(42, _GROUP_KEY)} % 5 AS INT) AS fold FROM cert")
def spl4(spark, d):
    return certificates(spark, d, "LMK_KEY", "UPRN").select("LMK_KEY", L.group_fold("UPRN", "LMK_KEY").alias("fold"))


@query("spl5_group_shuffle_split", f"WITH {cert_cte()} SELECT LMK_KEY, {uniform_sql(42, _GROUP_KEY)} < 0.15::DOUBLE AS held_out FROM cert")
def spl5(spark, d):
    return certificates(spark, d, "LMK_KEY", "UPRN").select("LMK_KEY", L.group_shuffle_split("UPRN", "LMK_KEY").alias("held_out"))


@query("spl6_latest_slice", f"WITH {cert_cte()} SELECT LMK_KEY, percent_rank() OVER (ORDER BY INSPECTION_DATE) > 0.85::DOUBLE AS is_validation FROM cert")
def spl6(spark, d):
    return L.latest_slice(certificates(spark, d, "LMK_KEY", "INSPECTION_DATE")).select("LMK_KEY", "is_validation")


@query("smp1_hash_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {hash_sql(7, 'o_orderkey')}, o_orderkey LIMIT 500")
def smp1(spark, d):
    return L.hash_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 500, "o_orderkey", 7)


# --- sets and checks ------------------------------------------------------------------------------


@query("set1_union_keyed_unkeyed", f"WITH {cert_cte()} SELECT LMK_KEY, UPRN, 'keyed' AS part FROM cert WHERE UPRN IS NOT NULL UNION ALL SELECT LMK_KEY, UPRN, 'unkeyed' FROM cert WHERE UPRN IS NULL")
def set1(spark, d):
    df = certificates(spark, d, "LMK_KEY", "UPRN")
    keyed = df.where(F.col("UPRN").isNotNull()).withColumn("part", F.lit("keyed"))
    return keyed.unionByName(df.where(F.col("UPRN").isNull()).withColumn("part", F.lit("unkeyed")))


@query("set2_key_intersection", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set2(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


def _filled_sql(cols, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS c FROM {source} HAVING count({c}) > 0" for c in cols)


@query("set3_column_difference", f"WITH {cert_cte()}, sub AS (SELECT * FROM cert WHERE TENURE IS NULL), a AS ({_filled_sql(CERTIFICATE, 'cert')}), "
       f"b AS ({_filled_sql([c for c in CERTIFICATE if c not in (*C.ROLES['personal'], *C.ROLES['admin'])], 'sub')}) "
       "SELECT c AS \"column\", 'left_only' AS side FROM a WHERE c NOT IN (SELECT c FROM b) UNION ALL SELECT c, 'right_only' FROM b WHERE c NOT IN (SELECT c FROM a)")
def set3(spark, d):
    """Columns with values among all certificates, against the published columns of those without a tenure."""
    df = certificates(spark, d)
    return P.column_difference(df, P.publishable(df.where(F.col("TENURE").isNull())))


_ORDER_COLS = sorted("o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split())


@query("fpr1_fingerprint", "SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), "
       + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in _ORDER_COLS) + ")), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM orders")
def fpr1(spark, d):
    return checks.fingerprint(table(spark, d, "orders").select(*_ORDER_COLS))


_DQ1 = f"""WITH {CLEAN_CTES}, {SPLIT_SQL.replace('cert AS', 'cert2 AS').replace('FROM cert', 'FROM cert2')} ,
 m AS (SELECT count(*) FILTER (CURRENT_ENERGY_RATING IS NULL) a, count(*) FILTER (CURRENT_ENERGY_RATING NOT IN {C.BANDS}) b, count(*) FILTER (NUMBER_HEATED_ROOMS > NUMBER_HABITABLE_ROOMS) c,
 count(*) FILTER (NUMBER_HEATED_ROOMS = 0) e, count(*) FILTER (NUMBER_HABITABLE_ROOMS = 0) f, count(*) FILTER (TOTAL_FLOOR_AREA = 0) g,
 count(LMK_KEY) - count(DISTINCT LMK_KEY) h, count(UPRN) - count(DISTINCT UPRN) i FROM clean),
 s AS (SELECT count(*) FILTER (split = 'train' AND INSPECTION_DATE > DATE '{_LATE_CUT}') j, count(*) FILTER (split = 'test' AND INSPECTION_DATE <= DATE '{_LATE_CUT}') k FROM sp),
 o AS (SELECT count(*) l FROM (SELECT UPRN FROM sp WHERE split = 'train' AND UPRN IS NOT NULL INTERSECT SELECT UPRN FROM sp WHERE split = 'test')),
 r AS (SELECT 'target is never null' AS "check", a AS v FROM m UNION ALL SELECT 'target is in the band domain', b FROM m UNION ALL SELECT 'heated rooms do not exceed habitable rooms', c FROM m
 UNION ALL SELECT 'no zero in NUMBER_HEATED_ROOMS', e FROM m UNION ALL SELECT 'no zero in NUMBER_HABITABLE_ROOMS', f FROM m UNION ALL SELECT 'no zero in TOTAL_FLOOR_AREA', g FROM m
 UNION ALL SELECT 'LMK_KEY is unique', h FROM m UNION ALL SELECT 'UPRN is unique', i FROM m UNION ALL SELECT 'no train row after the cutoff', j FROM s
 UNION ALL SELECT 'no test row up to the cutoff', k FROM s UNION ALL SELECT 'no dwelling on both sides', l FROM o)
 SELECT "check", CASE WHEN v = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(v AS VARCHAR) AS detail FROM r
 UNION ALL SELECT 'no personal/admin columns', 'pass', 'none' UNION ALL SELECT 'no leakage/element columns', 'pass', 'none'"""


@query("dq1_data_checks", _DQ1)
def dq1(spark, d):
    clean = cleaning.build_clean(certificates(spark, d), "R1")
    features = P.drop_role(featuring.engineer(clean), "leakage", "element")
    return checks.data_checks(clean, P.publishable(clean), features, _group_split(spark, d), _LATE_CUT)


def _scored(spark, d):
    df = predictions(spark, d)
    return df.select(
        F.lit("k").alias("LMK_KEY"), F.lit("u").alias("UPRN"), F.lit(CUT).cast("date").alias("INSPECTION_DATE"),
        F.col("cohort").alias("REPORT_TYPE"), S.decode_band(F.col("t")).alias("actual_band"),
        F.when(F.col("part") % 50 == 0, F.col("yhat")).otherwise(F.col("y")).alias("actual_sap_score"),
        F.col("yhat").alias("predicted_sap_score"), S.decode_band(F.col("p")).alias("predicted_band"),
        (F.col("t") == F.col("p")).alias("band_correct"), F.abs(F.col("y") - F.col("yhat")).alias("abs_score_error"),
        S.confidence_proxy(F.col("yhat")).alias("confidence_proxy"), "split",
    )


@query("dq2_prediction_checks", f"""WITH {pred_cte()}, m AS (SELECT count(*) FILTER (split = 'train') tr, count(*) FILTER (split = 'test') te,
 avg(CAST({code_sql('CASE WHEN part % 50 = 0 THEN yhat ELSE y END')} = t AS DOUBLE)) ma FROM pred)
 SELECT 'required columns present' AS "check", 'pass' AS status, 'none' AS detail UNION ALL SELECT 'bands in domain', 'pass', '0'
 UNION ALL SELECT 'confidence within [0, 1]', 'pass', '0' UNION ALL SELECT 'both splits present', CASE WHEN tr > 0 AND te > 0 THEN 'pass' ELSE 'fail' END, CAST(least(tr, te) AS VARCHAR) FROM m
 UNION ALL SELECT 'recorded score maps to recorded band', CASE WHEN ma >= 0.999 THEN 'pass' ELSE 'fail' END, CAST(round(ma, 6) AS VARCHAR) FROM m""")
def dq2(spark, d):
    return checks.check_predictions(_scored(spark, d))

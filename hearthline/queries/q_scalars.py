"""Scalar functions and single-row repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.operators import repair as R
from hearthline.plans import featuring
from hearthline.queries.registry import query, rounded, rsql
from hearthline.queries.roles import (
    band_sql, cert_cte, certificates, code_sql, hash_sql, pred_cte, predictions, rec_cte, recommendations, table,
)

AGE_SQL = (
    "CASE "
    + " ".join(
        f"WHEN trim(CONSTRUCTION_AGE_BAND) = '{p}{k}' THEN {v}.0"
        for p in (C.AGE_BAND_PREFIX, "")
        for k, v in C.AGE_BAND_YEAR.items()
    )
    + " WHEN regexp_matches(trim(CONSTRUCTION_AGE_BAND), '^\\d{4}$') AND CAST(trim(CONSTRUCTION_AGE_BAND) AS INT)"
    " BETWEEN 1850 AND 2050 THEN CAST(trim(CONSTRUCTION_AGE_BAND) AS DOUBLE) END"
)
AGE_SQL = f"CAST({AGE_SQL} AS DOUBLE)".replace(
    "CAST(trim(CONSTRUCTION_AGE_BAND) AS INT)", "TRY_CAST(trim(CONSTRUCTION_AGE_BAND) AS INT)"
).replace("THEN CAST(trim(CONSTRUCTION_AGE_BAND) AS DOUBLE)", "THEN TRY_CAST(trim(CONSTRUCTION_AGE_BAND) AS DOUBLE)")

_T = "lower(trim(FLOOR_LEVEL))"
FLOOR_SQL = (
    f"CASE WHEN {_T} LIKE '%basement%' THEN -1.0 WHEN {_T} LIKE 'ground%' OR {_T} IN ('g', 'gf') THEN 0.0 "
    f"WHEN regexp_matches({_T}, '^\\d{{1,2}}\\s*(st|nd|rd|th)?(\\s*floor)?$') "
    f"THEN TRY_CAST(regexp_extract({_T}, '^(\\d{{1,2}})', 1) AS DOUBLE) "
    f"WHEN regexp_matches({_T}, '^[+-]?\\d+$') THEN TRY_CAST({_T} AS DOUBLE) END"
)
FLOOR_SQL = f"CAST({FLOOR_SQL} AS DOUBLE)"
DISTRICT_SQL = "coalesce(split_part(upper(POSTCODE), ' ', 1), 'UNK')"


def _has(col: str, pattern: str) -> str:
    return f"CAST(regexp_matches(coalesce({col}, ''), '(?i){pattern}') AS INT)"


FLAG_SQL = {name: _has(c, p) for name, (c, p) in C.TEXT_FLAGS.items() if name != "FLAG_SINGLE_GLAZED"}
FLAG_SQL["FLAG_SINGLE_GLAZED"] = (
    "CAST(coalesce(WINDOWS_DESCRIPTION, '') ILIKE '%single%' AND coalesce(WINDOWS_DESCRIPTION, '') NOT ILIKE '%double%' AS INT)"
)
NO_LOFT_SQL = _has("ROOF_DESCRIPTION", C.NO_LOFT_PATTERN)
LOFT_SQL = (
    f"CASE WHEN {NO_LOFT_SQL} = 1 THEN 0 ELSE coalesce(TRY_CAST(regexp_extract(coalesce(ROOF_DESCRIPTION, ''), "
    "'(\\d{2,3})\\s*mm', 1) AS INT), 0) END"
)
WALL_SQL = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(lower(coalesce(WALLS_DESCRIPTION, '')), '{p}') THEN '{k}'" for k, p in C.WALL_KINDS)
    + " ELSE 'other' END"
)
RATIO_SQL = {
    "LOW_ENERGY_LIGHTING_RATIO": "CASE WHEN LOW_ENERGY_FIXED_LIGHT_COUNT IS NULL OR FIXED_LIGHTING_OUTLETS_COUNT IS NULL THEN NULL "
    "ELSE least(greatest(LOW_ENERGY_FIXED_LIGHT_COUNT / nullif(FIXED_LIGHTING_OUTLETS_COUNT, 0), 0.0), 1.0) END",
    "HEATED_ROOM_RATIO": "CASE WHEN NUMBER_HEATED_ROOMS IS NULL OR NUMBER_HABITABLE_ROOMS IS NULL OR NUMBER_HABITABLE_ROOMS = 0 THEN NULL "
    "ELSE least(greatest(NUMBER_HEATED_ROOMS / NUMBER_HABITABLE_ROOMS, 0.0), 1.0) END",
    "AREA_PER_ROOM": "TOTAL_FLOOR_AREA / nullif(NUMBER_HABITABLE_ROOMS, 0)",
    "LOG_FLOOR_AREA": "ln(1.0::DOUBLE + TOTAL_FLOOR_AREA)",
}
RATIO_SQL["LOW_ENERGY_LIGHTING_RATIO"] = RATIO_SQL["LOW_ENERGY_LIGHTING_RATIO"].replace(
    "FIXED_LIGHTING_OUTLETS_COUNT IS NULL THEN", "FIXED_LIGHTING_OUTLETS_COUNT IS NULL OR FIXED_LIGHTING_OUTLETS_COUNT = 0 THEN"
)


def era_sql(col: str, scheme, right_closed: bool, null_label: str | None = None) -> str:
    lo_op, hi_op = (">", "<=") if right_closed else (">=", "<")
    arms = " ".join(f"WHEN {col} {lo_op} {lo} AND {col} {hi_op} {hi} THEN '{lab}'" for lo, hi, lab in scheme)
    return f"CASE {arms} ELSE {'NULL' if null_label is None else repr(null_label)} END"


def confidence_sql(e: str) -> str:
    arms = []
    for b in C.BANDS:
        lo, up = C.BAND_LOWER[b], C.BAND_UPPER[b]
        mid, half = (lo + up) / 2.0, max(1.0, (up - lo) / 2.0)
        arms.append(f"WHEN {e} BETWEEN {lo} AND {up + 0.999} THEN 1.0::DOUBLE - abs({e} - {mid}::DOUBLE) / {half}::DOUBLE")
    return f"least(greatest(CASE {' '.join(arms)} ELSE 0.0 END, 0.0), 1.0)"


@query("scl1_construction_age_num", f"WITH {cert_cte()} SELECT LMK_KEY, CONSTRUCTION_AGE_BAND, {AGE_SQL} AS age_year FROM cert")
def scl1(spark, d):
    df = certificates(spark, d, "LMK_KEY", "CONSTRUCTION_AGE_BAND")
    return df.withColumn("age_year", S.construction_age_num(F.col("CONSTRUCTION_AGE_BAND")))


@query("scl2_floor_level_num", f"WITH {cert_cte()} SELECT LMK_KEY, FLOOR_LEVEL, {FLOOR_SQL} AS storey FROM cert")
def scl2(spark, d):
    df = certificates(spark, d, "LMK_KEY", "FLOOR_LEVEL")
    return df.withColumn("storey", S.floor_level_num(F.col("FLOOR_LEVEL")))


@query("scl3_postcode_district", f"WITH {cert_cte()} SELECT LMK_KEY, {DISTRICT_SQL} AS district FROM cert")
def scl3(spark, d):
    return certificates(spark, d, "LMK_KEY", "POSTCODE").select("LMK_KEY", S.postcode_district(F.col("POSTCODE")).alias("district"))


@query(
    "scl4_text_flags",
    f"WITH {cert_cte()} SELECT LMK_KEY, {', '.join(f'{e} AS {n}' for n, e in FLAG_SQL.items())} FROM cert",
)
def scl4(spark, d):
    df = certificates(spark, d, "LMK_KEY", *{c for c, _ in C.TEXT_FLAGS.values()})
    return df.select("LMK_KEY", *[S.text_flag(F.col(c), p).alias(n) for n, (c, p) in C.TEXT_FLAGS.items()])


@query(
    "scl4_document_flags",
    "SELECT lang, count(*) AS n, CAST(sum(CAST(regexp_matches(text, '(?i)copyright|license') AS INT)) AS BIGINT) AS n_license, "
    "CAST(sum(CAST(regexp_matches(text, '(?i)[a-z0-9._]@[a-z0-9.]') AS INT)) AS BIGINT) AS n_mail FROM documents GROUP BY lang",
)
def scl4_documents(spark, d):
    docs = table(spark, d, "documents").select("lang", "text")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(S.text_flag(F.col("text"), "copyright|license")).alias("n_license"),
        F.sum(S.text_flag(F.col("text"), "[a-z0-9._]@[a-z0-9.]")).alias("n_mail"),
    )


@query(
    "scl5_loft_depth",
    f"WITH {cert_cte()} SELECT LMK_KEY, {LOFT_SQL} AS loft_mm, CAST({LOFT_SQL} >= 270 AS INT) AS loft_270, "
    f"{NO_LOFT_SQL} AS no_loft FROM cert",
)
def scl5(spark, d):
    roof = F.col("ROOF_DESCRIPTION")
    return certificates(spark, d, "LMK_KEY", "ROOF_DESCRIPTION").select(
        "LMK_KEY",
        S.loft_depth_mm(roof).alias("loft_mm"),
        (S.loft_depth_mm(roof) >= C.LOFT_TARGET_MM).cast("int").alias("loft_270"),
        S.text_flag(roof, C.NO_LOFT_PATTERN).alias("no_loft"),
    )


@query(
    "scl6_ratios",
    rsql(f"WITH {cert_cte()} SELECT LMK_KEY, {', '.join(f'{e} AS {n}' for n, e in RATIO_SQL.items())} FROM cert", " ".join(RATIO_SQL)),
)
def scl6(spark, d):
    df = certificates(
        spark, d, "LMK_KEY", "LOW_ENERGY_FIXED_LIGHT_COUNT", "FIXED_LIGHTING_OUTLETS_COUNT", "NUMBER_HEATED_ROOMS",
        "NUMBER_HABITABLE_ROOMS", "TOTAL_FLOOR_AREA",
    )
    return rounded(featuring.add_ratios(df).select("LMK_KEY", *RATIO_SQL))


@query("scl7_date_parts", "SELECT o_orderkey, year(o_orderdate) AS yr, quarter(o_orderdate) AS qtr FROM orders")
def scl7(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("yr"), F.quarter("o_orderdate").alias("qtr")
    )


@query(
    "scl8_parse_cost",
    f"WITH {rec_cte()} SELECT LMK_KEY, IMPROVEMENT_ITEM, INDICATIVE_COST, cost_low AS low, cost_high AS high, "
    "(cost_low + cost_high) / 2.0 AS mid FROM rec",
)
def scl8(spark, d):
    df = recommendations(spark, d, "LMK_KEY", "IMPROVEMENT_ITEM", "INDICATIVE_COST")
    return df.withColumn("c", S.parse_cost(F.col("INDICATIVE_COST"))).select(
        "LMK_KEY", "IMPROVEMENT_ITEM", "INDICATIVE_COST", "c.low", "c.high", "c.mid"
    )


@query("scl9_wall_type", f"WITH {cert_cte()} SELECT {WALL_SQL} AS wall, count(*) AS n FROM cert GROUP BY 1")
def scl9(spark, d):
    df = certificates(spark, d, "WALLS_DESCRIPTION")
    return df.groupBy(S.wall_type(F.col("WALLS_DESCRIPTION")).alias("wall")).agg(F.count(F.lit(1)).alias("n"))


_WEIRD = "CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE y + yhat / 7.0 - 25 END"


@query(
    "scl10_score_to_band",
    f"WITH {pred_cte()}, s AS (SELECT {_WEIRD.replace('l_partkey', 'part')} AS score FROM pred) "
    f"SELECT {band_sql('score')} AS band, count(*) AS n, round(min(score), 6) AS lo, round(max(score), 6) AS hi FROM s GROUP BY 1",
)
def scl10(spark, d):
    df = predictions(spark, d).selectExpr(f"{_WEIRD.replace('l_partkey', 'part')} AS score")
    return rounded(
        df.groupBy(S.score_to_band(F.col("score")).alias("band")).agg(
            F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")
        )
    )


@query(
    "scl11_confidence_proxy",
    f"WITH {pred_cte()}, s AS (SELECT yhat / 4 + 30 AS score FROM pred) SELECT score, "
    f"round_even({confidence_sql('score')}, 3) AS confidence, count(*) AS n FROM s GROUP BY 1, 2",
)
def scl11(spark, d):
    df = predictions(spark, d, "yhat").select((F.col("yhat") / 4 + 30).alias("score"))
    return df.groupBy("score").agg(F.count(F.lit(1)).alias("n")).select(
        "score", F.bround(S.confidence_proxy(F.col("score")), 3).alias("confidence"), "n"
    )


@query(
    "scl12_band_codes",
    f"WITH {pred_cte()} SELECT t AS code, {band_sql('y')} AS band, count(*) AS n FROM pred GROUP BY 1, 2",
)
def scl12(spark, d):
    df = predictions(spark, d, "t").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return df.select(S.encode_band(S.decode_band(F.col("t"))).alias("code"), S.decode_band(F.col("t")).alias("band"), "n")


@query(
    "scl13_era_left_closed",
    f"WITH {cert_cte()}, a AS (SELECT {AGE_SQL} AS age FROM cert) SELECT {era_sql('age', C.ERA_LEFT_CLOSED, False)} AS era, "
    "count(*) AS n FROM a GROUP BY 1",
)
def scl13(spark, d):
    age = S.construction_age_num(F.col("CONSTRUCTION_AGE_BAND"))
    aged = certificates(spark, d, "CONSTRUCTION_AGE_BAND").select(age.alias("age"))
    return aged.groupBy(S.era(F.col("age")).alias("era")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scl14_era_right_closed",
    f"WITH {cert_cte()}, a AS (SELECT {AGE_SQL} AS age FROM cert) SELECT {era_sql('age', C.ERA_RIGHT_CLOSED, True, 'nan')} AS era, "
    "count(*) AS n FROM a GROUP BY 1",
)
def scl14(spark, d):
    age = S.construction_age_num(F.col("CONSTRUCTION_AGE_BAND"))
    era = S.era(F.col("age"), C.ERA_RIGHT_CLOSED, True, "nan")
    return certificates(spark, d, "CONSTRUCTION_AGE_BAND").select(age.alias("age")).groupBy(era.alias("era")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scl15_measure_name",
    f"WITH {rec_cte()} SELECT trim(split_part(IMPROVEMENT_SUMMARY_TEXT, ',', 1)) AS measure, count(*) AS n FROM rec GROUP BY 1",
)
def scl15(spark, d):
    df = recommendations(spark, d, "IMPROVEMENT_SUMMARY_TEXT")
    return df.groupBy(S.measure_name(F.col("IMPROVEMENT_SUMMARY_TEXT")).alias("measure")).agg(F.count(F.lit(1)).alias("n"))


# Class probabilities built from the rows: dyadic parts, so every sum is exact.
PROB_EXPR = "array(%s)" % ", ".join(f"CAST((o_orderkey * {3 + k} + o_custkey * {k + 1}) % 32 + 1 AS DOUBLE)" for k in range(7))
PROB_SQL = PROB_EXPR.replace("array(", "list_value(", 1)
PROBS_CTE = f"w AS (SELECT o_orderkey, {PROB_SQL} AS v FROM orders), p AS (SELECT o_orderkey, v, list_sum(v) AS s FROM w)"


def probs(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", f"{PROB_EXPR} AS v")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("s", total).withColumn("probs", F.transform("v", lambda x: x / F.col("s")))


@query(
    "scl16_expected_class",
    f"WITH {PROBS_CTE}, e AS (SELECT o_orderkey, ({' + '.join(f'v[{k + 1}] / s * {k}' for k in range(7))}) AS m FROM p) "
    "SELECT o_orderkey, CAST(least(greatest(round_even(m, 0), 0), 6) AS INT) AS cls FROM e",
)
def scl16(spark, d):
    return probs(spark, d).select("o_orderkey", S.expected_class(F.col("probs")).alias("cls"))


_CUM = [f"({' + '.join(f'v[{j + 1}] / s' for j in range(k + 1))})" for k in range(7)]
_THRESH = [0.1, 0.3, 0.35, 0.5, 0.6, 0.7, 0.9]


@query(
    "scl17_threshold_class",
    f"WITH {PROBS_CTE} SELECT o_orderkey, CAST(CASE {' '.join(f'WHEN {c} >= {t}::DOUBLE THEN {k}' for k, (c, t) in enumerate(zip(_CUM, _THRESH)))} "
    "ELSE 6 END AS INT) AS cls FROM p",
)
def scl17(spark, d):
    cut = F.array(*[F.lit(t) for t in _THRESH])
    return probs(spark, d).select("o_orderkey", S.threshold_class(S.cumulative(F.col("probs")), cut).alias("cls"))


@query(
    "scl18_rank_class",
    f"WITH {PROBS_CTE} SELECT o_orderkey, CAST({' + '.join(f'CASE WHEN v[{k + 1}] / 32.0::DOUBLE >= 0.5::DOUBLE THEN 1 ELSE 0 END' for k in range(6))} "
    "AS INT) AS cls FROM p",
)
def scl18(spark, d):
    exceed = F.transform(F.slice("v", 1, 6), lambda x: x / F.lit(32.0))
    return probs(spark, d).select("o_orderkey", S.rank_class(exceed).alias("cls"))


@query(
    "scl18_exceed_targets",
    f"WITH {pred_cte()}, c AS (SELECT t, count(*) AS n FROM pred GROUP BY t) SELECT t, n, "
    f"concat_ws(',', {', '.join(f'CAST(CAST(t > {k} AS INT) AS VARCHAR)' for k in range(6))}) AS targets FROM c",
)
def scl18_targets(spark, d):
    df = predictions(spark, d, "t").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.transform(S.exceed_targets(F.col("t")), lambda x: x.cast("string")), ",")
    return df.withColumn("targets", text)


@query(
    "scl19_prediction_fields",
    f"WITH {pred_cte()}, s AS (SELECT y, yhat / 8 AS z FROM pred) SELECT y, z, {band_sql('y')} = {band_sql('z')} AS band_correct, "
    "round_even(abs(y - z), 2) AS abs_score_error, count(*) AS n FROM s GROUP BY ALL",
)
def scl19(spark, d):
    df = predictions(spark, d, "y", "yhat").select("y", (F.col("yhat") / 8).alias("z"))
    counted = df.groupBy("y", "z").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "y", "z", (S.score_to_band(F.col("y")) == S.score_to_band(F.col("z"))).alias("band_correct"),
        F.bround(F.abs(F.col("y") - F.col("z")), 2).alias("abs_score_error"), "n",
    )


ENGINEERED_SQL = {
    "INSPECTION_YEAR": "year(INSPECTION_DATE)", "INSPECTION_QUARTER": "quarter(INSPECTION_DATE)",
    "CONSTRUCTION_AGE_NUM": AGE_SQL, "FLOOR_LEVEL_NUM": FLOOR_SQL, "POSTCODE_DISTRICT": DISTRICT_SQL, **FLAG_SQL,
    "LOFT_INSULATION_MM": LOFT_SQL, "FLAG_LOFT_270MM": f"CAST({LOFT_SQL} >= 270 AS INT)", "FLAG_NO_LOFT_INSULATION": NO_LOFT_SQL,
    **RATIO_SQL,
}


def engineered_cte(source: str = "cert", name: str = "eng") -> str:
    return f"{name} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in ENGINEERED_SQL.items())} FROM {source})"


@query(
    "eng1_engineer",
    rsql(f"WITH {cert_cte()}, {engineered_cte()} SELECT LMK_KEY, {', '.join(ENGINEERED_SQL)} FROM eng",
         "CONSTRUCTION_AGE_NUM FLOOR_LEVEL_NUM " + " ".join(RATIO_SQL)),
)
def eng1(spark, d):
    return rounded(featuring.engineer(certificates(spark, d)).select("LMK_KEY", *ENGINEERED_SQL))


# --- single-row repairs ---------------------------------------------------------------------------


@query(
    "rep1_coerce_numeric",
    "SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no, "
    "CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size_no FROM part",
)
def rep1(spark, d):
    df = table(spark, d, "part").selectExpr(
        "p_partkey", "replace(p_brand, 'Brand#', ' ') AS brand_no",
        "CASE WHEN p_size % 10 = 0 THEN 'NaN' WHEN p_size % 5 = 0 THEN '1,000' ELSE concat(' ', p_size, ' ') END AS size_no",
    )
    return R.coerce_numeric(df, ["brand_no", "size_no"])


@query(
    "rep2_normalise_sentinels",
    f"WITH {cert_cte()} SELECT LMK_KEY, CASE WHEN upper(trim(MAIN_FUEL)) IN {C.SENTINELS} THEN NULL ELSE MAIN_FUEL END AS MAIN_FUEL, "
    f"CASE WHEN CURRENT_ENERGY_RATING IN {C.SENTINELS} THEN NULL ELSE CURRENT_ENERGY_RATING END AS CURRENT_ENERGY_RATING FROM cert",
)
def rep2(spark, d):
    return R.normalise_sentinels(certificates(spark, d, "LMK_KEY", "MAIN_FUEL", "CURRENT_ENERGY_RATING"))


_ROOMS = ("LMK_KEY", "NUMBER_HEATED_ROOMS", "NUMBER_HABITABLE_ROOMS", "TOTAL_FLOOR_AREA", "CO2_EMISSIONS_CURRENT", "ENERGY_CONSUMPTION_CURRENT")
HEATED_CAPPED = (
    "CASE WHEN NUMBER_HEATED_ROOMS > NUMBER_HABITABLE_ROOMS THEN NUMBER_HABITABLE_ROOMS ELSE NUMBER_HEATED_ROOMS END"
)


@query("rep3_cap_by_column", f"WITH {cert_cte()} SELECT LMK_KEY, {HEATED_CAPPED} AS NUMBER_HEATED_ROOMS, NUMBER_HABITABLE_ROOMS FROM cert")
def rep3(spark, d):
    return R.cap_by_column(certificates(spark, d, *_ROOMS[:3]), R.HEATED, R.HABITABLE)


@query(
    "rep4_zero_to_null",
    f"WITH {cert_cte()} SELECT LMK_KEY, nullif(NUMBER_HEATED_ROOMS, 0) AS NUMBER_HEATED_ROOMS, "
    "nullif(NUMBER_HABITABLE_ROOMS, 0) AS NUMBER_HABITABLE_ROOMS, nullif(TOTAL_FLOOR_AREA, 0) AS TOTAL_FLOOR_AREA FROM cert",
)
def rep4(spark, d):
    return R.zero_to_null(certificates(spark, d, *_ROOMS[:4]), R.ZERO_RULE_COLUMNS)


@query(
    "rep5_any_negative",
    f"WITH {cert_cte()} SELECT LMK_KEY, CAST(coalesce(CO2_EMISSIONS_CURRENT < 0, false) OR coalesce(ENERGY_CONSUMPTION_CURRENT < 0, false) AS INT) "
    "AS HAS_ONSITE_GENERATION FROM cert",
)
def rep5(spark, d):
    df = certificates(spark, d, "LMK_KEY", "CO2_EMISSIONS_CURRENT", "ENERGY_CONSUMPTION_CURRENT")
    return R.flag_negative(df, R.NEGATIVE_RULE_COLUMNS).select("LMK_KEY", "HAS_ONSITE_GENERATION")


@query("rep5_negative_balance", "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal < 0 AS INT)) AS BIGINT) AS n_negative FROM customer GROUP BY 1")
def rep5_customer(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(R.any_negative(["c_acctbal"])).alias("n_negative")
    )


@query("rep8_clip_score", f"WITH {pred_cte()} SELECT yhat, least(greatest(yhat, 1.0), 100.0) AS score, count(*) AS n FROM pred GROUP BY 1, 2")
def rep8(spark, d):
    df = predictions(spark, d, "yhat").groupBy("yhat").agg(F.count(F.lit(1)).alias("n"))
    return df.select("yhat", S.clip_score(F.col("yhat")).alias("score"), "n")


@query(
    "nul1_fill_missing_level",
    f"WITH {cert_cte()} SELECT LMK_KEY, coalesce(BUILT_FORM, '{C.MISSING_LEVEL}') AS BUILT_FORM, "
    f"coalesce(WALLS_DESCRIPTION, '{C.MISSING_LEVEL}') AS WALLS_DESCRIPTION FROM cert",
)
def nul1(spark, d):
    return R.fill_missing_level(certificates(spark, d, "LMK_KEY", "BUILT_FORM", "WALLS_DESCRIPTION"))


@query(
    "nul3_harmonise_nulls",
    "SELECT p_partkey * 1.0::DOUBLE AS p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS price, p_brand FROM part",
)
def nul3(spark, d):
    df = table(spark, d, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size % 3 = 0 THEN double('NaN') ELSE p_retailprice END AS price", "p_brand"
    )
    return R.harmonise_nulls(df)

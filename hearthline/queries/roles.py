"""The given tables projected into register roles.

Each projection is plain SQL that Spark and the checking engine both read, so
a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthline import config as C


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cases(key: str, values: list[str | None]) -> str:
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {key} {arms} END"


def band_sql(e: str) -> str:
    arms = " ".join(f"WHEN least(greatest({e}, 1.0), 100.0) >= {lo} THEN '{b}'" for b, lo in C.BAND_LOWER.items() if lo)
    return f"(CASE WHEN {e} IS NULL THEN '{C.FALLBACK_BAND}' {arms} ELSE 'G' END)"


def code_sql(e: str) -> str:
    arms = " ".join(
        f"WHEN least(greatest({e}, 1.0), 100.0) >= {lo} THEN {i}" for i, (b, lo) in enumerate(C.BAND_LOWER.items()) if lo
    )
    return f"CAST(CASE WHEN {e} IS NULL THEN 2 {arms} ELSE 6 END AS INT)"


CERTIFICATE = {
    "LMK_KEY": "o_orderkey",
    "UPRN": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END",
    "BUILDING_REFERENCE_NUMBER": "concat('B', CAST(o_custkey AS STRING))",
    "ADDRESS1": "concat(CAST(o_custkey % 90 AS STRING), ' High Street')",
    "POSTCODE": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat('ab', CAST(o_custkey % 20 AS STRING), ' 1cd') END",
    "LOCAL_AUTHORITY": "CASE WHEN o_orderstatus = 'P' THEN 'R2' ELSE 'R1' END",
    "INSPECTION_DATE": "CAST(o_orderdate AS DATE)",
    "REPORT_TYPE": "CASE WHEN o_orderstatus = 'F' THEN 101 ELSE 100 END",
    "CURRENT_ENERGY_EFFICIENCY": "CAST(floor(o_totalprice / 5000.0) AS INT)",
    "CURRENT_ENERGY_RATING": "CASE WHEN o_orderkey % 101 = 0 THEN 'INVALID!' WHEN o_orderkey % 103 = 0 THEN NULL ELSE "
    + band_sql("floor(o_totalprice / 5000.0)") + " END",
    "POTENTIAL_ENERGY_RATING": "o_orderstatus",
    "WALLS_ENERGY_EFF": "CASE WHEN o_custkey % 2 = 0 THEN 'Good' ELSE 'Poor' END",
    "TOTAL_FLOOR_AREA": "CASE WHEN o_orderkey % 97 = 0 THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 89 = 0 THEN NULL "
    "ELSE o_totalprice / CAST(2048 AS DOUBLE) END",
    "NUMBER_HABITABLE_ROOMS": "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 499 = 1 THEN CAST(40 AS DOUBLE) "
    "ELSE CAST(o_custkey % 8 AS DOUBLE) END",
    "NUMBER_HEATED_ROOMS": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS DOUBLE) END",
    "CO2_EMISSIONS_CURRENT": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_custkey % 50 - 2 AS DOUBLE) / CAST(4 AS DOUBLE) END",
    "ENERGY_CONSUMPTION_CURRENT": "CAST(o_orderkey % 300 - 5 AS DOUBLE)",
    "FIXED_LIGHTING_OUTLETS_COUNT": "CAST(o_orderkey % 12 AS DOUBLE)",
    "LOW_ENERGY_FIXED_LIGHT_COUNT": "CAST(o_custkey % 14 AS DOUBLE)",
    "MULTI_GLAZE_PROPORTION": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) END",
    "PROPERTY_TYPE": _cases("o_custkey % 5", ["House", "Flat", "Bungalow", "Maisonette", "Park home"]),
    "BUILT_FORM": _cases("o_orderkey % 7", ["Detached", "Semi-Detached", "Mid-Terrace", "End-Terrace", "Detached", None, "Mid-Terrace"]),
    "CONSTRUCTION_AGE_BAND": _cases(
        "o_custkey % 12",
        ["England and Wales: before 1900", "England and Wales: 1900-1929", "1930-1949", " 1950-1966 ", "2007 onwards",
         "England and Wales: 1996-2002", "2019", " 1849 ", "unknown", None, "1900", "England and Wales: 1976-1982"],
    ),
    "FLOOR_LEVEL": _cases(
        "o_orderkey % 14",
        ["Basement", "Ground", "ground floor", "00", "01", "1st", "2nd Floor", " 3 ", "top floor", "-1", None, "mid floor", "gf", "21st"],
    ),
    "WALLS_DESCRIPTION": _cases(
        "o_custkey % 8",
        ["Cavity wall, filled cavity", "Solid brick, as built, no insulation (assumed)", "Timber frame with cavity wall",
         "Sandstone, as built", "Cob", None, "System built, insulated", "Cavity wall, as built"],
    ),
    "ROOF_DESCRIPTION": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN 'Pitched, no insulation' "
    "WHEN o_orderkey % 11 = 2 THEN 'Flat, limited' ELSE concat('Pitched, ', CAST(o_custkey % 400 AS STRING), ' mm loft insulation') END",
    "WINDOWS_DESCRIPTION": _cases(
        "o_orderkey % 5",
        ["Single glazed", "Fully double glazed", "Some double glazing, single elsewhere", "Fully triple glazed", None],
    ),
    "MAINHEAT_DESCRIPTION": _cases(
        "o_custkey % 6",
        ["Boiler and radiators, mains gas", "Electric storage heaters", "Air source heat pump, radiators, electric",
         "Room heaters, dual fuel", None, "Community scheme"],
    ),
    "MAIN_FUEL": "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ' No Data! ' ELSE o_orderpriority END",
    "TENURE": "CASE WHEN o_orderkey % 5003 = 0 THEN 'owner' ELSE NULL END",
}
_LOW = "CAST(floor(l_extendedprice / 100.0) AS BIGINT)"
_HIGH = f"({_LOW} * 2 + l_linenumber)"


def _grouped_sql(n: str) -> str:
    """A whole number below a million with a thousands comma."""
    return (
        f"CASE WHEN {n} >= 1000 THEN concat(CAST(CAST(floor({n} / 1000.0) AS BIGINT) AS STRING), ',', "
        f"lpad(CAST({n} % 1000 AS STRING), 3, '0')) ELSE CAST({n} AS STRING) END"
    )


RECOMMENDATION = {
    "LMK_KEY": "l_orderkey",
    "IMPROVEMENT_ITEM": "l_linenumber",
    "IMPROVEMENT_SUMMARY_TEXT": "CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE concat(' Measure ', "
    "CAST((l_orderkey % 5 + l_linenumber) % 10 AS STRING), ', ', CAST(l_suppkey % 4 AS STRING), ' kWp') END",
    "INDICATIVE_COST": f"CASE WHEN l_partkey % 7 = 0 THEN 'n/a' WHEN l_partkey % 5 = 0 THEN concat('£', {_grouped_sql(_LOW)}) "
    f"ELSE concat('£', {_grouped_sql(_LOW)}, ' - £', {_grouped_sql(_HIGH)}) END",
    "cost_low": f"CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST({_LOW} AS DOUBLE) END",
    "cost_high": f"CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN CAST({_LOW} AS DOUBLE) ELSE CAST({_HIGH} AS DOUBLE) END",
}
PREDICTION = {
    "seg": "l_returnflag",
    "cohort": "CASE WHEN l_linestatus = 'F' THEN 101 ELSE 100 END",
    "part": "l_partkey",
    "y": "l_quantity * 2",
    "yhat": "l_quantity * 2 + (l_partkey % 21) - 10",
    "split": "CASE WHEN l_shipdate < TIMESTAMP '2000-01-01 00:00:00' THEN 'train' ELSE 'test' END",
}


def _select(role: dict[str, str], cols: list[str] | None) -> list[str]:
    return [f"{role[c]} AS {c}" for c in (cols or role)]


def certificates(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*_select(CERTIFICATE, list(cols) or None))


def recommendations(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*_select(RECOMMENDATION, list(cols) or None))


def predictions(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Predictions with class codes ``t`` and ``p``."""
    from pyspark.sql import functions as F

    from hearthline.functions import scalars as S

    df = table(spark, d, "lineitem").selectExpr(*_select(PREDICTION, None))
    df = df.withColumns(
        {"t": S.score_to_code(F.col("y")), "p": S.score_to_code(F.col("yhat"))}
    )
    return df.select(*cols) if cols else df


def cert_cte(*cols: str) -> str:
    return f"cert AS (SELECT {', '.join(_select(CERTIFICATE, list(cols) or None))} FROM orders)"


def rec_cte(*cols: str) -> str:
    return f"rec AS (SELECT {', '.join(_select(RECOMMENDATION, list(cols) or None))} FROM lineitem)"


def pred_cte() -> str:
    base = f"SELECT {', '.join(_select(PREDICTION, None))} FROM lineitem"
    return f"pred AS (SELECT *, {code_sql('y')} AS t, {code_sql('yhat')} AS p FROM ({base}))"


def hash_sql(seed: int | str, *keys: str) -> str:
    """The seeded 32-bit hash of ``functions.hashing.hash32``."""
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST(('0x' || substr(md5({text} || '|{seed}'), 1, 8)) AS BIGINT)"


def uniform_sql(seed: int | str, *keys: str) -> str:
    return f"(({hash_sql(seed, *keys)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"

"""Repairs of raw values, null handling and the log of what was repaired."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.operators.orderstats import exact_percentiles


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: S.to_number(F.col(c)) for c in present(df, cols)})


def normalise_sentinels(df: DataFrame, tokens: Iterable[str] = C.SENTINELS) -> DataFrame:
    """Null out "not recorded" tokens in text columns."""
    tokens = list(tokens)
    return df.withColumns(
        {c: F.when(~F.upper(S.strip(F.col(c))).isin(tokens), F.col(c)) for c in text_columns(df)}
    )


def cap_by_column(df: DataFrame, value: str, ceiling: str) -> DataFrame:
    """Cap one column at another where both are present."""
    return df.withColumn(value, F.when(F.col(value) > F.col(ceiling), F.col(ceiling)).otherwise(F.col(value)))


def zero_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in present(df, cols)})


def any_negative(cols: Iterable[str]) -> Column:
    """1 when some column is below zero; null counts as no."""
    flag = F.lit(False)
    for c in cols:
        flag = flag | F.coalesce(F.col(c) < 0, F.lit(False))
    return flag.cast("int")


def flag_negative(df: DataFrame, cols: Iterable[str], name: str = "HAS_ONSITE_GENERATION") -> DataFrame:
    return df.withColumn(name, any_negative(present(df, cols)))


def winsorise(df: DataFrame, value: str, q: float = 0.995, *, bounded: bool = False) -> DataFrame:
    """Cap a column at its own exact percentile; null stays null."""
    cap = exact_percentiles(df, value, {"cap": q}, bounded=bounded).scalar()
    return df.withColumn(value, F.when(F.col(value) > cap, cap).otherwise(F.col(value)))


def at_least(df: DataFrame, value: str, floor: float, null_as: float = 99.0) -> DataFrame:
    """Keep rows at or above a floor; an unknown value passes."""
    return df.where(F.coalesce(F.col(value), F.lit(null_as)) >= floor)


def null_rates(df: DataFrame, cols: list[str] | None = None, among: Column | None = None) -> DataFrame:
    """One row with the share of nulls of every column, optionally among some rows only."""
    cols = cols or df.columns

    def rate(c: str) -> Column:
        hit = F.col(c).isNull().cast("double")
        return F.avg(hit if among is None else F.when(among, hit)).alias(c)

    return df.agg(*[rate(c) for c in cols])


def drop_fully_missing(df: DataFrame, threshold: float = 0.999) -> DataFrame:
    """Keep the columns whose null rate is below the threshold (decided by one aggregate row)."""
    rates = null_rates(df).first().asDict()
    return df.select(*[c for c in df.columns if (rates[c] if rates[c] is not None else 1.0) < threshold])


def add_missing_flags(
    df: DataFrame,
    threshold: float = 0.05,
    among: Column | None = None,
    cols: list[str] | None = None,
    exempt: Iterable[str] = (C.TARGET,),
) -> DataFrame:
    """Add ``<col>_IS_MISSING`` for columns with enough nulls among the deciding rows."""
    cols = [c for c in (cols or df.columns) if c not in set(exempt)]
    rates = null_rates(df, cols, among).first().asDict()
    chosen = [c for c in cols if (rates[c] or 0.0) >= threshold]
    return df.withColumns({f"{c}_IS_MISSING": F.col(c).isNull().cast("int") for c in chosen})


def fill_missing_level(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return df.fillna({c: C.MISSING_LEVEL for c in (cols or text_columns(df))})


def harmonise_nulls(df: DataFrame) -> DataFrame:
    """Numbers as double, NaN as null."""
    return df.withColumns({c: S.nan_to_null(F.col(c).cast("double")) for c in numeric_columns(df)})


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def valid_domain(df: DataFrame, col: str = C.TARGET, domain: Iterable[str] = C.BANDS) -> DataFrame:
    return df.where(F.col(col).isin(*domain))


HEATED, HABITABLE = "NUMBER_HEATED_ROOMS", "NUMBER_HABITABLE_ROOMS"
ZERO_RULE_COLUMNS = (HEATED, HABITABLE, C.AREA)
NEGATIVE_RULE_COLUMNS = ("CO2_EMISSIONS_CURRENT", "ENERGY_CONSUMPTION_CURRENT")


def repair_consistency(df: DataFrame) -> DataFrame:
    """Cap heated rooms, null impossible zeros, flag negative emissions; in this order."""
    if {HEATED, HABITABLE} <= set(df.columns):
        df = cap_by_column(df, HEATED, HABITABLE)
    return flag_negative(zero_to_null(df, ZERO_RULE_COLUMNS), NEGATIVE_RULE_COLUMNS)


def cleaning_log(df: DataFrame, crowded_above: int = 30) -> DataFrame:
    """Rows (rule, n_rows_affected, action) of what ``repair_consistency`` will do; one pass."""
    have = set(df.columns)
    rules: list[tuple[str, Column, str, bool]] = []
    capped = df
    if {HEATED, HABITABLE} <= have:
        rules.append(
            ("heated > habitable", F.col("_heated_before") > F.col(HABITABLE), "clip heated to habitable", True)
        )
        capped = cap_by_column(df.withColumn("_heated_before", F.col(HEATED)), HEATED, HABITABLE)
    for c in present(df, ZERO_RULE_COLUMNS):
        rules.append((f"{c} == 0", F.col(c) == 0, "set NaN (impossible value)", False))
    rules.append(
        (
            "negative emissions/consumption",
            any_negative(present(df, NEGATIVE_RULE_COLUMNS)) == 1,
            "added HAS_ONSITE_GENERATION=1",
            True,
        )
    )
    if HABITABLE in have:
        rules.append(
            (f"habitable_rooms > {crowded_above} (HMO)", F.col(HABITABLE) > crowded_above, "kept; tracked only", False)
        )
    counted = capped.agg(*[F.count_if(test).alias(f"r{i}") for i, (_, test, _, _) in enumerate(rules)])
    entries = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.col(f"r{i}").alias("n_rows_affected"),
                F.lit(action).alias("action"),
                F.lit(always).alias("always"),
            )
            for i, (rule, _, action, always) in enumerate(rules)
        ]
    )
    rows = counted.select(F.inline(entries))
    return rows.where(F.col("always") | (F.col("n_rows_affected") > 0)).drop("always")

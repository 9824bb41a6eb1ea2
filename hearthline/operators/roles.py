"""Projections driven by column roles, and checks of the columns themselves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.operators.repair import add_missing_flags, numeric_columns, present


def drop_role(df: DataFrame, *roles: str) -> DataFrame:
    return df.drop(*present(df, [c for r in roles for c in C.ROLES[r]]))


def publishable(df: DataFrame) -> DataFrame:
    return drop_role(df, "personal", "admin")


def reconcile_aliases(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    aliases = C.ALIASES if aliases is None else aliases
    return df.withColumnsRenamed({old: new for old, new in aliases.items() if old in df.columns})


def model_matrix(
    df: DataFrame,
    *,
    drop_raw_descriptions: bool = False,
    drop_methodology: bool = False,
    add_missingness: bool = True,
    threshold: float = 0.05,
    among: Column | None = None,
    keep: Iterable[str] = (),
    label: str = "label_band",
    score: str = "label_score",
) -> DataFrame:
    """Features without leaked columns, plus the two labels and the ``keep`` columns."""
    keep = list(keep)
    unwanted = {c for r in ("leakage", "element", "personal", "admin", "superseded") for c in C.ROLES[r]}
    if drop_raw_descriptions:
        unwanted |= set(C.ROLES["description"])
    if drop_methodology:
        unwanted |= set(C.ROLES["methodology"])
    unwanted |= {C.TARGET, C.ID}
    features = [c for c in df.columns if c not in unwanted and c not in keep]
    base = df.withColumns(
        {label: F.col(C.TARGET), score: F.col(C.SCORE) if C.SCORE in df.columns else F.lit(None).cast("double")}
    )
    if add_missingness:
        base = add_missing_flags(base, threshold, among, cols=features)
        features += [c for c in base.columns if c.endswith("_IS_MISSING") and c not in features]
    numeric = numeric_columns(base.select(*features))
    return base.withColumns({c: S.nan_to_null(F.col(c).cast("double")) for c in numeric}).select(
        *keep, label, score, *features
    )


def conform(df: DataFrame, contract: list[str], extra_keep: Iterable[str] = ()) -> DataFrame:
    """Columns of the contract in its order; a missing one is an error, others are dropped."""
    missing = [c for c in contract if c not in df.columns]
    if missing:
        raise ValueError(f"columns required by the model are absent: {missing}")
    return df.select(*extra_keep, *contract)


def column_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(column, side): columns that hold a value in one of the two tables only. Each table is read once."""

    def filled(df: DataFrame, side: str) -> DataFrame:
        held = df.agg(*[F.count(c).alias(c) for c in df.columns])
        return held.unpivot([], df.columns, "column", "n").where("n > 0").select("column", F.lit(side).alias("side"))

    sides = filled(left, "left_only").unionByName(filled(right, "right_only"))
    return sides.groupBy("column").agg(F.min("side").alias("side"), F.count(F.lit(1)).alias("n")).where("n = 1").select("column", "side")

"""The cleaning chains, from raw certificates to an analysis-ready table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from hearthline import config as C
from hearthline.operators import dedup, repair as R
from hearthline.session import staged


def region_guard(df: DataFrame, region: str | None, col: str = "LOCAL_AUTHORITY") -> DataFrame:
    return df.where(F.col(col) == region) if region is not None and col in df.columns else df


def build_clean(
    raw: DataFrame,
    region: str | None = None,
    *,
    numeric: Iterable[str] = C.CLEAN_NUMERIC,
    one_per_dwelling: bool = True,
    prune_columns: bool = True,
    cap_quantile: float = 0.995,
    min_area: float = 10.0,
    null_threshold: float = 0.999,
    materialise: bool = True,
) -> DataFrame:
    """Guard, cast, repair, one per dwelling, cap, prune columns, valid target; order matters.

    The cap is taken after de-duplication, the column prune after the cap. Both
    read the de-duplicated table again, so ``materialise`` writes it once to the
    shared folder.
    """
    df = region_guard(raw, region).transform(R.coerce_numeric, numeric).transform(R.repair_consistency)
    if one_per_dwelling:
        df = dedup.best_quality_per_key(df)
    if materialise:
        df = staged(df, "repaired")
    if C.AREA in df.columns:
        df = df.transform(R.winsorise, C.AREA, cap_quantile).transform(R.at_least, C.AREA, min_area)
    if prune_columns:
        df = R.drop_fully_missing(df, null_threshold)
    return R.valid_domain(df)


def build_longitudinal(raw: DataFrame, region: str | None = None, **options) -> DataFrame:
    """The same chain keeping every certificate of a dwelling, with fewer casts."""
    return build_clean(
        raw, region, **{"numeric": C.LONGITUDINAL_NUMERIC, "one_per_dwelling": False, **options}
    )

"""Feature engineering over certificate columns; absent inputs skip their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthline import config as C
from hearthline.functions import scalars as S


def add_date_parts(df: DataFrame) -> DataFrame:
    have, new = set(df.columns), {}
    if C.DATE in have:
        new |= {"INSPECTION_YEAR": F.year(C.DATE), "INSPECTION_QUARTER": F.quarter(C.DATE)}
    if "CONSTRUCTION_AGE_BAND" in have:
        new["CONSTRUCTION_AGE_NUM"] = S.construction_age_num(F.col("CONSTRUCTION_AGE_BAND"))
    if "FLOOR_LEVEL" in have:
        new["FLOOR_LEVEL_NUM"] = S.floor_level_num(F.col("FLOOR_LEVEL"))
    if "POSTCODE" in have:
        new["POSTCODE_DISTRICT"] = S.postcode_district(F.col("POSTCODE"))
    return df.withColumns(new)


def add_text_flags(df: DataFrame) -> DataFrame:
    have = set(df.columns)

    def text(c: str):
        return F.col(c) if c in have else F.lit("")

    new = {name: S.text_flag(text(c), pattern) for name, (c, pattern) in C.TEXT_FLAGS.items()}
    roof = text("ROOF_DESCRIPTION")
    new["LOFT_INSULATION_MM"] = S.loft_depth_mm(roof)
    new["FLAG_NO_LOFT_INSULATION"] = S.text_flag(roof, C.NO_LOFT_PATTERN)
    # a second step, so that the depth is read out of the text once
    return df.withColumns(new).withColumn(
        "FLAG_LOFT_270MM", (F.col("LOFT_INSULATION_MM") >= C.LOFT_TARGET_MM).cast("int")
    )


def add_ratios(df: DataFrame) -> DataFrame:
    have, new = set(df.columns), {}
    low, outlets = "LOW_ENERGY_FIXED_LIGHT_COUNT", "FIXED_LIGHTING_OUTLETS_COUNT"
    heated, habitable = "NUMBER_HEATED_ROOMS", "NUMBER_HABITABLE_ROOMS"
    if {low, outlets} <= have:
        new["LOW_ENERGY_LIGHTING_RATIO"] = S.clipped_ratio(F.col(low), F.col(outlets))
    if {heated, habitable} <= have:
        new["HEATED_ROOM_RATIO"] = S.clipped_ratio(F.col(heated), F.col(habitable))
    if {C.AREA, habitable} <= have:
        new["AREA_PER_ROOM"] = S.ratio(F.col(C.AREA), F.col(habitable))
    if C.AREA in have:
        new["LOG_FLOOR_AREA"] = F.log1p(C.AREA)
    return df.withColumns(new)


def engineer(df: DataFrame) -> DataFrame:
    return df.transform(add_date_parts).transform(add_text_flags).transform(add_ratios)

"""Data checks, table comparison and fingerprints."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.operators.repair import HABITABLE, HEATED


def fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Row count and an order-free hash of the whole table: the sum of 60 bits of each row's MD5.

    A row's text is its values in order of column names; equal rows count as often as they occur.
    """
    cols = sorted(cols or df.columns)
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in cols])
    part = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fingerprint"))


def table_differences(left: DataFrame, right: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows on one side only, counting copies; both sides share one shuffle of signed counts."""
    cols = cols or left.columns
    signed = left.select(*cols, F.lit(1).alias("_sign")).unionByName(right.select(*cols, F.lit(-1).alias("_sign")))
    net = signed.groupBy(*cols).agg(F.sum("_sign").alias("_net"))
    return net.agg(
        F.coalesce(F.sum(F.greatest("_net", F.lit(0))), F.lit(0)).alias("left_only"),
        F.coalesce(F.sum(F.greatest(-F.col("_net"), F.lit(0))), F.lit(0)).alias("right_only"),
    )


def group_overlap(df: DataFrame, key: str, split: str = "split", sides: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Number of groups found on both sides of a split."""
    a, b = (df.where((F.col(split) == s) & F.col(key).isNotNull()).select(key) for s in sides)
    return a.intersect(b).agg(F.count(F.lit(1)).alias("shared_groups"))


def _report(measured: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(name).alias("check"),
            F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("status"),
            F.coalesce(detail.cast("string"), F.lit("none")).alias("detail"),
        )
        for name, ok, detail in checks
    ]
    return measured.select(F.inline(F.array(*entries)))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per non-null key."""
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


def check_clean(df: DataFrame) -> DataFrame:
    """Checks of a cleaned table: one aggregate over its rows, one per key."""
    have = set(df.columns)
    counts: dict[str, Column] = {
        "target is never null": F.count_if(F.col(C.TARGET).isNull()),
        "target is in the band domain": F.count_if(~F.col(C.TARGET).isin(*C.BANDS)),
    }
    if {HEATED, HABITABLE} <= have:
        counts["heated rooms do not exceed habitable rooms"] = F.count_if(F.col(HEATED) > F.col(HABITABLE))
    for c in (HEATED, HABITABLE, C.AREA):
        if c in have:
            counts[f"no zero in {c}"] = F.count_if(F.col(c) == 0)
    measured = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
    checks = [(name, F.col(f"c{i}") == 0, F.col(f"c{i}")) for i, name in enumerate(counts)]
    for key in (C.ID, C.DWELLING):
        if key in have:
            measured = measured.withColumn(f"dup_{key}", duplicate_count(df, key).scalar())
            checks.append((f"{key} is unique", F.col(f"dup_{key}") == 0, F.col(f"dup_{key}")))
    return _report(measured, checks)


def check_absent_columns(df: DataFrame, *roles: str) -> DataFrame:
    """None of the roles' columns may be present; reads the schema only."""
    found = [c for r in roles for c in C.ROLES[r] if c in df.columns]
    one = df.sparkSession.range(1)
    return _report(one, [(f"no {'/'.join(roles)} columns", F.lit(not found), F.lit(", ".join(found) or "none"))])


def check_split(df: DataFrame, cutoff: str, split: str = "split", date: str = C.DATE, key: str = C.DWELLING) -> DataFrame:
    """Train lies up to the cutoff, test after it, and no dwelling is on both sides."""
    limit = F.lit(cutoff).cast("date")
    measured = df.agg(
        F.count_if((F.col(split) == "train") & (F.col(date) > limit)).alias("late"),
        F.count_if((F.col(split) == "test") & (F.col(date) <= limit)).alias("early"),
    ).withColumn("shared", group_overlap(df, key, split).scalar())
    return _report(
        measured,
        [
            ("no train row after the cutoff", F.col("late") == 0, F.col("late")),
            ("no test row up to the cutoff", F.col("early") == 0, F.col("early")),
            ("no dwelling on both sides", F.col("shared") == 0, F.col("shared")),
        ],
    )


def check_rerun(first: DataFrame, second: DataFrame) -> DataFrame:
    a = fingerprint(first).select(F.struct("*").alias("a")).scalar()
    b = fingerprint(second).select(F.struct("*").alias("b")).scalar()
    measured = first.sparkSession.range(1).select(a.alias("a"), b.alias("b"))
    return _report(measured, [("rerun gives the same table", F.col("a") == F.col("b"), F.col("b.n"))])


def data_checks(clean: DataFrame, published: DataFrame, features: DataFrame, split: DataFrame, cutoff: str) -> DataFrame:
    """The whole suite as (check, status, detail)."""
    parts = [
        check_clean(clean),
        check_absent_columns(published, "personal", "admin"),
        check_absent_columns(features, "leakage", "element"),
        check_split(split, cutoff),
    ]
    return reduce(DataFrame.unionByName, parts)


PREDICTION_COLUMNS = (
    "LMK_KEY", "UPRN", "INSPECTION_DATE", "REPORT_TYPE", "actual_band", "actual_sap_score", "predicted_sap_score",
    "predicted_band", "band_correct", "abs_score_error", "confidence_proxy", "split",
)


def check_predictions(df: DataFrame, required: Iterable[str] = PREDICTION_COLUMNS, match_floor: float = 0.999) -> DataFrame:
    """Checks of a scored table over all of its rows."""
    missing = [c for c in required if c not in df.columns]
    in_domain = F.col("predicted_band").isin(*C.BANDS) & F.col("actual_band").isin(*C.BANDS)
    maps = (S.score_to_band(F.col("actual_sap_score")) == F.col("actual_band")).cast("double")
    measured = df.agg(
        F.count_if(~F.coalesce(in_domain, F.lit(False))).alias("outside"),
        F.count_if(~F.coalesce(F.col("confidence_proxy").between(0, 1), F.lit(False))).alias("conf"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
        F.avg(maps).alias("match"),
    )
    return _report(
        measured,
        [
            ("required columns present", F.lit(not missing), F.lit(", ".join(missing) or "none")),
            ("bands in domain", F.col("outside") == 0, F.col("outside")),
            ("confidence within [0, 1]", F.col("conf") == 0, F.col("conf")),
            ("both splits present", (F.col("train") > 0) & (F.col("test") > 0), F.least("train", "test")),
            ("recorded score maps to recorded band", F.col("match") >= match_floor, F.round("match", 6)),
        ],
    )

"""Typed readers of register tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.operators.repair import normalise_sentinels
from hearthline.operators.roles import reconcile_aliases


def declared_schema(types: dict[str, str] | None = None, required: Iterable[str] = (C.ID,)) -> StructType:
    """The declared columns as a reader schema; required keys are not nullable."""
    types = C.CERTIFICATE_TYPES if types is None else types
    needed = set(required)
    return StructType.fromDDL(", ".join(f"`{c}` {t}{' NOT NULL' if c in needed else ''}" for c, t in types.items()))


def _csv(spark: SparkSession, path: str, cols: list[str] | None) -> DataFrame:
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"')
    if cols is not None:
        reader = reader.schema(StructType.fromDDL(", ".join(f"`{c}` string" for c in cols)))
    return reader.csv(path)


def read_certificates(
    spark: SparkSession, path: str, types: dict[str, str] | None = None, header: list[str] | None = None
) -> DataFrame:
    """Certificates with declared types; a value that does not fit its type is null.

    Text is read first and cast by ``try_cast``, so one bad cell never drops a row.
    ``header`` gives the file's column order when it differs from the declaration.
    """
    types = C.CERTIFICATE_TYPES if types is None else types
    raw = reconcile_aliases(_csv(spark, path, header))
    typed = {}
    for c in raw.columns:
        kind = types.get(c, "string")
        if kind in ("double", "int", "bigint"):
            number = S.to_number(F.col(c))
            typed[c] = number if kind == "double" else number.try_cast(kind)
        elif kind != "string":
            typed[c] = F.col(c).try_cast(kind)
    return normalise_sentinels(raw.withColumns(typed))


def read_recommendations(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """Recommendation rows, every column as text."""
    return _csv(spark, path, list(C.RECOMMENDATION_TYPES) if header is None else header)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """A published table with numeric score and emissions and the inspection year."""
    df = spark.read.parquet(path)
    return df.withColumns(
        {
            C.SCORE: F.col(C.SCORE).try_cast("double"),
            "INSPECTION_YEAR": F.year(F.col(C.DATE).cast("date")),
            "CO2_EMISSIONS_CURRENT": F.col("CO2_EMISSIONS_CURRENT").try_cast("double"),
        }
    )


def read_scored(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """One split of a scored table; written by split, so only its folder is listed."""
    return spark.read.parquet(path).where(F.col("split") == split)

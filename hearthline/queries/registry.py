"""Registry of queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; halves go up in a way both engines compute alike."""
    scale = 10.0**digits
    return df.withColumns(
        {
            f.name: F.floor(F.col(f.name) * scale + 0.50001) / scale
            for f in df.schema
            if isinstance(f.dataType, DoubleType)
        }
    )


def rsql(sql: str, cols: str, digits: int = 6) -> str:
    """The same rounding around an SQL statement, for the named columns."""
    scale = f"1e{digits}::DOUBLE"
    parts = ", ".join(f"floor(CAST({c} AS DOUBLE) * {scale} + 0.50001::DOUBLE) / {scale} AS {c}" for c in cols.split())
    return f"SELECT * REPLACE ({parts}) FROM ({sql})"

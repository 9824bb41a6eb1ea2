"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthline import config as C


def write_published(df: DataFrame, path: str, fmt: str = "parquet", date: str = C.DATE) -> None:
    """The published table, partitioned by inspection year so that time filters prune files.

    Rows are rebalanced by year first: a small year is one file, a large one is split by size among tasks.
    """
    out = df.withColumn("_year", F.year(date)).hint("rebalance", F.col("_year"))
    writer = out.write.mode("errorifexists").partitionBy("_year")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_log(log: DataFrame, path: str) -> None:
    """The cleaning log: a handful of rows, one file."""
    log.coalesce(1).write.option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.partitionBy("split").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.json(path)

"""Reading of the given tables and small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hearthline.session import staged

__all__ = ["map_arrow", "read", "staged", "texts_of"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that no other column of a table can clash or be read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """Apply a function to each Arrow batch. A worker outlives its task, so the task gives its unused Arrow memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = step(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def thinned(rows: DataFrame, wanted: DataFrame, key: str, words: int = 1 << 18) -> DataFrame:
    """Rows that may have a wanted key (a long), before they are shuffled for the exact join.

    The wanted keys set bits in a map of ``words`` 64-bit words, which is broadcast: at most that many rows whatever the input. No
    wanted row is lost; when the map is full, which takes tens of millions of keys, it merely stops saving anything.
    """
    bits, place = bit_map(wanted, key, words)
    met = rows.withColumn("__at", place).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(bits), "__word")
    return met.where(F.getbit("__bits", F.col("__at").bitwiseAND(F.lit(63)).cast("int")) == 1).select(*rows.columns)


def bit_map(wanted: DataFrame, key: str, words: int) -> tuple[DataFrame, Column]:
    """The words with a bit set, and the place of a row's key among all bits."""
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(words * 64))
    word, bit = F.shiftright(place, 6).alias("__word"), place.bitwiseAND(F.lit(63)).cast("int")
    bits = wanted.select(word, bit.alias("__bit")).select("__word", F.expr("shiftleft(1L, __bit)").alias("__set"))
    return bits.groupBy("__word").agg(F.bit_or("__set").alias("__bits")), place


def marked(rows: DataFrame, wanted: DataFrame, key: str, name: str, words: int = 1 << 18) -> DataFrame:
    """All rows with a boolean column: false where the row certainly has no wanted key. See ``thinned``."""
    bits, place = bit_map(wanted, key, words)
    met = rows.withColumn("__at", place).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(bits), "__word", "left")
    maybe = F.getbit("__bits", F.col("__at").bitwiseAND(F.lit(63)).cast("int")) == 1
    return met.withColumn(name, F.coalesce(maybe, F.lit(False))).select(*rows.columns, name)

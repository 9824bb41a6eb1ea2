"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns it was given. Null texts fail the quality rules and so never reach the later stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm.common import read, staged
from hearthline.llm.decontaminate import decontaminate
from hearthline.llm.near_dedup import keep_first
from hearthline.llm.packing import pack
from hearthline.llm.pii import fit_tagger, redact
from hearthline.llm.quality_lines import fit_lines, keep_good

#: SQL cannot express the stages
ORACLE_SQL: str | None = None


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, fit_lines(docs, read(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go."""
    bad = decontaminate(docs, read(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (key == bad["__key"]), "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind, and n_chars follows."""
    return redact(docs, fit_tagger(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1,024 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

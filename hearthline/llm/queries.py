"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm import collocations, decontaminate as contamination, divergence, jaccard_join, warc
from hearthline.llm.common import read
from hearthline.llm.importance import fit_ratio, resample
from hearthline.llm.near_dedup import near_duplicates
from hearthline.llm.packing import pack
from hearthline.llm.pii import find_personal, fit_tagger
from hearthline.llm.quality_lines import fit_lines, quality_rules
from hearthline.llm.separator_scan import token_counts
from hearthline.llm.substring_dedup import substring_dedup
from hearthline.llm.toxicity import HELD_OUT, fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@registered
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules(docs, fit_lines(docs, read(spark, sf_dir, "labels")))


@registered
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


@registered
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


@registered
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), where=f"NOT ({HELD_OUT})")
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@registered
def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return resample(docs, fit_ratio(docs, read(spark, sf_dir, "labels")))


@registered
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("rid")


@registered
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


@registered
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, read(spark, sf_dir, "pages"))


@registered
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return find_personal(docs, fit_tagger(docs))


@registered
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).drop("kept")


@registered
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


@registered
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


ORACLE["op12_collocations"] = collocations.SQL
@registered
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


ORACLE["op13_source_divergence"] = divergence.SQL
ORACLE["op11_jaccard_join"] = jaccard_join.SQL
ORACLE["op2_decontamination"] = contamination.SQL
ORACLE["op8_warc"] = warc.SQL
ORACLE["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n
         FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of digits, a-z and non-ASCII characters after A-Z is lower-cased. A window is ten consecutive words of an item. Both
sides keep, of every six consecutive five-word hashes, the smallest (winnowing): any ten equal words share a kept hash, so no shared
window is missed. Kept hashes of texts meet those of items in a join, and each hit is extended to the up to six ten-word windows
around it, compared word by word, so hash collisions cannot add anything. An item of fewer than ten words is one window; texts are
searched for every length that such items have (at most nine).

Fingerprints of items are broadcast only if they number at most ``broadcast_rows`` (each row holds at most fifteen words); beyond that
the texts' fingerprints are shuffled without their words, and the words join the matches by document.

A null or empty text has no words. Rows that repeat a doc_id and text give equal rows, and rows with a null doc_id are judged by their
text. Items without words match nothing; a null item_id still marks words but is not listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.llm.common import staged, texts_of

WINDOW, GRAM = 10, 5
SPREAD = WINDOW - GRAM + 1
LOW = (1 << 31) - 1
UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text; only A-Z is lower-cased, which for pure ASCII is what lower() does."""
    full = F.coalesce(text, F.lit(""))
    small = F.when(F.octet_length(full) == F.length(full), F.lower(full)).otherwise(F.translate(full, UPPER_LETTERS, UPPER_LETTERS.lower()))
    return F.array_remove(F.split(small, NOT_WORD), "")


def fingerprints(w: Column) -> Column:
    """Kept five-word hashes: the high 33 bits of the hash, and the position in the low 31, so a minimum carries its place."""
    n = F.size(w)
    grams = F.transform(
        F.slice(w, 1, F.greatest(n - (GRAM - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, GRAM))).bitwiseAND(F.lit(~LOW)).bitwiseOR(i.cast("long")),
    )
    return grams


def winnowed(grams: Column) -> Column:
    return F.array_distinct(
        F.transform(
            F.slice(grams, 1, F.greatest(F.size(grams) - (SPREAD - 1), F.lit(0))),
            lambda x, i: F.least(x, *(F.get(grams, i + k) for k in range(1, SPREAD))),
        )
    )


def runs(w: Column, n: int) -> Column:
    """Every n consecutive words."""
    return F.transform(F.slice(w, 1, F.size(w) - (n - 1)), lambda x, i: F.array(x, *(F.get(w, i + k) for k in range(1, n))))


def item_fingerprints(items: DataFrame) -> DataFrame:
    """mark, item_id, lead (words of the context before the gram), around (the gram with up to five words on either side)."""
    w = F.col("w")
    at = F.col("fp").bitwiseAND(F.lit(LOW)).cast("int")
    lead = F.least(at, F.lit(SPREAD - 1))
    return (
        items.withColumn("grams", fingerprints(w))
        .select("item_id", "w", F.explode(winnowed(F.col("grams"))).alias("fp"))
        .select(
            F.col("fp").bitwiseAND(F.lit(~LOW)).alias("mark"),
            "item_id",
            lead.alias("lead"),
            F.slice(w, at - lead + 1, lead + GRAM + SPREAD - 1).alias("around"),
        )
        .distinct()
    )


def window_starts(w: Column, at: Column, lead: Column, around: Column) -> Column:
    """Starts, in the text, of the shared ten-word windows that hold the gram at ``at``."""
    return F.filter(
        F.array(*(F.when((lead >= s) & (at >= s), at - s) for s in range(SPREAD))),
        lambda p: p.isNotNull()
        & (F.slice(w, p + 1, WINDOW) == F.slice(around, lead - (at - p) + 1, WINDOW))
        & (F.size(F.slice(w, p + 1, WINDOW)) == WINDOW),
    )


def hits(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame:
    """Staged rows of doc_id, text_key, n_words (one such row per input row, without a hit) and hits: item_id, size, starts."""
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words(F.col("text")).alias("w"))
    item_words = staged(items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0), "items")
    marks = staged(item_fingerprints(item_words.where(F.size("w") >= WINDOW)), "item_marks")
    few = marks.count() <= broadcast_rows
    marks = F.broadcast(marks) if few else marks

    at = F.col("fp").bitwiseAND(F.lit(LOW)).cast("int")
    own = F.col("fp") == -1
    kept = texts.withColumn("grams", fingerprints(F.col("w"))).select(
        "doc_id", "text_key", *(["w"] if few else []), F.size("w").alias("n_words"), F.explode(F.concat(winnowed(F.col("grams")), F.array(F.lit(-1).cast("long")))).alias("fp")
    )
    met = kept.withColumn("mark", F.when(~own, F.col("fp").bitwiseAND(F.lit(~LOW)))).join(marks, "mark", "left").where(own | F.col("lead").isNotNull())
    if not few:
        met = met.select("doc_id", "text_key", "n_words", "fp", "item_id", "lead", "around")
        whole = texts.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "w").dropDuplicates(["d", "k"])
        met = met.where(own).withColumn("w", F.array().cast("array<string>")).unionByName(
            met.where(~own).join(whole, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).drop("d", "k")
        )
    found = met.select(
        "doc_id",
        "text_key",
        F.when(own, F.col("n_words")).alias("n_words"),
        F.when(~own, F.col("item_id")).alias("item_id"),
        F.lit(WINDOW).alias("size"),
        F.when(~own, window_starts(F.col("w"), at, F.col("lead"), F.col("around"))).alias("starts"),
    ).where("n_words IS NOT NULL OR size(starts) > 0")

    short = item_words.where(F.size("w") < WINDOW)
    lengths = [r["n"] for r in short.select(F.size("w").alias("n")).distinct().collect()]
    if lengths:
        branches = [
            texts.where(F.size("w") >= n)
            .select("doc_id", "text_key", F.posexplode(runs(F.col("w"), n)).alias("p", "w"))
            .join(short.where(F.size("w") == n), "w")
            .select("doc_id", "text_key", F.lit(None).cast("int").alias("n_words"), "item_id", F.lit(n).alias("size"), F.array("p").alias("starts"))
            for n in lengths
        ]
        found = reduce(DataFrame.unionByName, branches, found)
    return staged(found, "hits")


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated. Stages matches in jobs of its own."""
    found = hits(texts_of(docs), items, broadcast_rows)
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans"))))
    covered = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct(
            (acc["words"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["upto"]))).alias("words"), F.greatest(acc["upto"], s["b"]).alias("upto")
        ),
        lambda acc: acc["words"],
    )
    return (
        found.withColumn("spans", F.transform("starts", lambda p: F.struct(p.alias("a"), (p + F.col("size")).alias("b"))))
        .groupBy("doc_id", "text_key")
        .agg(
            F.max("n_words").alias("n_words"),
            F.count("n_words").cast("int").alias("rows"),
            spans.alias("spans"),
            F.array_sort(F.collect_set("item_id")).alias("items"),
        )
        .select(
            "doc_id",
            "text_key",
            F.col("n_words").cast("long").alias("n_words"),
            covered.cast("long").alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
            F.explode(F.array_repeat(covered > 0, F.col("rows"))).alias("contaminated"),
        )
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

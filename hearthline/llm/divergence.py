"""Divergence of sources by their terms, from a quadtree over the matrix of groups by terms.

Null text, lang and source are ''. Terms are runs of letters and of characters beyond ASCII, A-Z as a-z. A language keeps the terms in at
least ``min_docs`` of its documents. With N the count of all kept terms of a group, V their number, and count those of one term,
p = 1 + floor(10**9 * (count + 1) / (N + V)); f = floor((p - q)**2 / q) in whole numbers. Part ``pair``: for each group (lang, source) and other
source of the language, f summed over all kept terms, q of the other source. Part ``term``: the ``top`` terms with a count in the group and
p > q, q of the whole language.

Counts are added up per group and term inside each task and shuffled once, by language and term. Terms are dealt into tiles of about
``tile_cells`` cells by hash, so a frequent term or a large source is a cell like any other; more than ``rows`` sources of a language are cut
into blocks, and a task holds two of them. In a task, each slab of columns is a quadtree (k**2 tree with k = 2): per level the sorted codes of
the quadrants that hold a count. All pairs of groups go down two trees together: where both quadrants are empty, every column of them costs the
pair the same, so they are counted and priced once per pair; where one is not, it is split further, and at the leaves the counts are compared.
Columns of equal sources stand together, which makes empty quadrants large.

Whole numbers are exact while N + V is below 9.2e15 and V below 1e9. A language without kept terms has value 0 for each pair; every group
that occurs is a row of the matrix, with terms or without. Repeated rows and null ids count like any other row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearthline.llm.common import staged
from hearthline.llm.ngrams import LOWER
from hearthline.llm.textblocks import U, blocks, byte_table, mix
from hearthline.operators.skew import attach_by_key

TERM = byte_table(r"[A-Za-z\x80-\xFF]")
SCALE, SCALE_STEPS = 1000, 3


def counts_by_task(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and df (documents with the term), added up over stretches of documents of a group in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (batch[c].dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            order = np.argsort(group, kind="stable")
            group = group[order]
            for block in blocks(batch["text"].take(pa.array(order)), TERM, 1 << 22):
                owner, word = block.owner(), block.word_hash(0, LOWER)
                of = group[block.rows][owner]
                _, first, cell, n = np.unique(mix(word + mix(of.astype(U) + U(1))), return_index=True, return_inverse=True, return_counts=True)
                if not len(n):
                    continue
                df = np.bincount(np.unique(cell * block.n + owner) // block.n, minlength=len(n))
                low = LOWER[block.buf].tobytes()
                names = pa.array([low[block.start[i] : block.end[i]] for i in first], pa.binary()).cast(pa.string())
                g = of[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(g // len(source.dictionary))),
                        source.dictionary.take(pa.array(g % len(source.dictionary))),
                        names,
                        pa.array(n),
                        pa.array(df),
                    ],
                    names=["lang", "source", "term", "n", "df"],
                )
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, df long")


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / whole), three decimal digits at a time."""
    out, rest = np.divmod(np.asarray(count, dtype=np.int64) + 1, whole)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * SCALE, whole)
        out = out * SCALE + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Quadtree:
    """Shares of rows by columns: per level the codes of the quadrants that hold a count, and at the last level their p.

    ``whole`` are the denominators of the rows; ``none`` is a row's p without a count.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, n: np.ndarray, whole: np.ndarray, depth: int):
        self.depth, self.rows = depth, len(whole)
        leaf = (row << depth) | col
        order = np.argsort(leaf)
        self.p = shares(n[order], whole[row[order]])
        self.none = shares(np.zeros(len(whole), dtype=np.int64), whole)
        self.levels = [leaf[order]]
        for up in range(1, depth + 1):
            self.levels.append(np.unique(((row >> up) << (depth - up)) | (col >> up)))
        self.levels.reverse()

    def find(self, level: int, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the quadrants hold a count, and their place among those that do."""
        have, code = self.levels[level], (row << level) | col
        at = np.minimum(np.searchsorted(have, code), max(0, len(have) - 1))
        return (have[at] == code) if len(have) else np.zeros(len(code), dtype=bool), at


def divergence(left: Quadtree, right: Quadtree, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """f summed over the columns of each left row against each right row, and of each right row against each left one.

    Of a tree with itself only pairs of a row with a later one are filled in.
    """
    rows, cols, depth, same = left.rows, right.rows, left.depth, left is right
    empty = np.zeros((rows, cols), dtype=np.int64)
    sums = [np.zeros((rows, cols), dtype=np.int64) for _ in range(2)]
    i, j, c = (np.zeros(1, dtype=np.int64) for _ in range(3))
    for level in range(depth + 1):
        width = 1 << (depth - level)
        inside = (i * width < rows) & (j * width < cols) & (c * width < columns)
        if same:
            inside &= (i <= j) if level < depth else (i < j)
        i, j, c = i[inside], j[inside], c[inside]
        (in_left, at_left), (in_right, at_right) = left.find(level, i, c), right.find(level, j, c)
        some = in_left | in_right
        none = ~some
        held = np.zeros((-(-rows // width), -(-cols // width)), dtype=np.int64)
        np.add.at(held, (i[none], j[none]), np.minimum(width, columns - c[none] * width))
        empty += np.repeat(np.repeat(held, width, axis=0)[:rows], width, axis=1)[:, :cols]
        i, j, c = i[some], j[some], c[some]
        if level == depth:
            p, q = left.none[i], right.none[j]
            for share, tree, hit, at in ((p, left, in_left[some], at_left[some]), (q, right, in_right[some], at_right[some])):
                share[hit] = tree.p[at[hit]]
            np.add.at(sums[0], (i, j), apart(p, q))
            np.add.at(sums[1], (i, j), apart(q, p))
            break
        i, j, c = ((x[:, None] * 2 + np.array(step)).reshape(-1) for x, step in ((i, (0, 0, 0, 0, 1, 1, 1, 1)), (j, (0, 0, 1, 1, 0, 0, 1, 1)), (c, (0, 1, 0, 1, 0, 1, 0, 1))))
    p, q = left.none[:, None], right.none[None, :]
    return sums[0] + empty * apart(p, q), sums[1] + empty * apart(q, p)


def compare(tiles: DataFrame, rows: int, top: int, leaves: int = 1 << 21) -> DataFrame:
    """Of tiles (lang, tile, i, j, r, part_of, whole, of_lang, term, n, total): value of pairs (r, other) over so many columns, or of the first terms of r.

    Rows without a term name the groups of the two blocks and the denominators of their shares and of their language's.
    """

    def step(tile: pa.Table) -> pa.Table:
        lang, i, j = (tile[c][0].as_py() for c in ("lang", "i", "j"))
        is_group = tile["term"].is_null().to_numpy()
        r, n, total, whole, of_lang = (tile[c].to_numpy() for c in ("r", "n", "total", "whole", "of_lang"))
        block = r // rows
        spelled = tile["term"].filter(pa.array(~is_group)).combine_chunks().dictionary_encode()
        col, terms = spelled.indices.to_numpy(), spelled.dictionary
        cell_row, cell_n, cell_total, cell_block = (x[~is_group] for x in (r, n, total, block))
        # columns held by the same sources stand together
        held = np.zeros(len(terms), dtype=U)
        np.add.at(held, col, mix(cell_row.astype(U) + U(1)))
        place = np.empty(len(terms), dtype=np.int64)
        place[np.argsort(held, kind="stable")] = np.arange(len(terms))
        place = place[col]
        base, wholes = [], []
        for b in (i, j):
            own = np.flatnonzero(is_group & (block == b))
            own = own[np.argsort(r[own])]
            base.append(r[own])
            wholes.append(whole[own])
        found: list[tuple] = []
        pair = [np.zeros((len(base[0]), len(base[1])), dtype=np.int64) for _ in range(2)]
        slab = 1 << max(0, (leaves // max(1, len(base[0]) * len(base[1]))).bit_length() - 1)
        for begin in range(0, len(terms), slab):
            width = min(slab, len(terms) - begin)
            depth = (max(width, len(base[0]), len(base[1])) - 1).bit_length()
            inside = (place >= begin) & (place < begin + width)
            trees = []
            for b, names, w in ((i, base[0], wholes[0]), (j, base[1], wholes[1]))[: 1 if i == j else 2]:
                own = inside & (cell_block == b)
                trees.append(Quadtree(np.searchsorted(names, cell_row[own]), place[own] - begin, cell_n[own], w, depth))
            for done, more in zip(pair, divergence(trees[0], trees[-1], width), strict=True):
                done += more
        first, second = np.nonzero(np.triu(np.ones(pair[0].shape, dtype=bool), 1) if i == j else np.ones(pair[0].shape, dtype=bool))
        for a, b, value in ((base[0][first], base[1][second], pair[0]), (base[1][second], base[0][first], pair[1])):
            found.append((a, b, np.full(len(a), None, dtype=object), value[first, second], np.full(len(a), len(terms))))
        if i == j and len(terms):
            p, q = shares(cell_n, wholes[0][np.searchsorted(base[0], cell_row)]), shares(cell_total, of_lang[is_group][0])
            value = apart(p, q)
            nth_term = np.empty(len(terms), dtype=np.int64)
            nth_term[pa.compute.sort_indices(terms).to_numpy()] = np.arange(len(terms))
            keep = np.flatnonzero(p > q)
            keep = keep[np.lexsort((nth_term[col][keep], -value[keep], cell_row[keep]))]
            keep = keep[np.arange(len(keep)) - np.searchsorted(cell_row[keep], cell_row[keep], side="left") < top]
            names = np.array(terms.take(pa.array(col[keep])).to_pylist(), dtype=object)
            found.append((cell_row[keep], np.full(len(keep), -1), names, value[keep], np.zeros(len(keep), dtype=np.int64)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table(
            {
                "lang": pa.array([lang] * len(columns[0]), pa.string()),
                "r": pa.array(columns[0], pa.int64()),
                "other": pa.array(columns[1], pa.int64()),
                "term": pa.array(columns[2].tolist(), pa.string()),
                "value": pa.array(columns[3], pa.int64()),
                "columns": pa.array(columns[4], pa.int64()),
            }
        )

    return tiles.groupBy("lang", "tile", "i", "j").applyInArrow(step, "lang string, r long, other long, term string, value long, columns long")


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, tile_cells: int = 1 << 17, rows: int = 256) -> DataFrame:
    """lang, source, part, item, value, rank. Stages the kept counts, the groups and the compared tiles in jobs of its own."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    dealt = counts_by_task(plain).repartition("lang", "term")
    cells = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")
    kept = cells.withColumns(
        {"total": F.sum("n").over(of_term), "docs": F.sum("df").over(of_term), "head": F.min("source").over(of_term) == F.col("source")}
    )
    kept = staged(kept.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total", "head"), "cells")
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum(F.col("head").cast("long")).alias("v"), F.count("*").alias("all_m"))
    groups = plain.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    groups = groups.select(
        "lang",
        "source",
        "m",
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("r"),
        "v",
        (F.col("n") + F.col("v")).alias("whole"),
        (F.col("all_n") + F.col("v")).alias("of_lang"),
        F.greatest(F.ceil(F.col("all_m") / tile_cells), F.lit(1)).alias("tiles"),
        F.ceil(F.count("*").over(Window.partitionBy("lang")) / rows).alias("row_blocks"),
    )
    groups = staged(groups, "groups")
    kept = attach_by_key(kept.drop("head"), groups.select("lang", "source", "r", "tiles", "row_blocks", "m"), ["lang", "source"], "m")
    shape = ["lang", "r", "row_blocks", "tile", "whole", "of_lang", "term", "n", "total"]
    none = {c: F.lit(0).cast("long") for c in ("whole", "of_lang")}
    of_cells = kept.withColumns({"tile": F.pmod(F.xxhash64("term"), F.col("tiles")), **none}).select(shape)
    of_groups = groups.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    of_groups = of_groups.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "total": F.lit(0).cast("long")}).select(shape)
    part, other = F.floor(F.col("r") / rows), F.col("other")
    met = of_groups.union(of_cells).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_blocks") - 1)))
    block = (F.least(part, other).alias("i"), F.greatest(part, other).alias("j"))
    met = met.select("lang", "tile", *block, "r", "term", "n", "total", "whole", "of_lang")
    found = staged(compare(met, rows, top), "compared")
    # columns that neither block of a task holds cost a pair what any empty column does
    name = groups.select("lang", "r", "source", "v", F.expr("if(v = 0, 1, 1 + 1000000000 div whole)").alias("p"))
    pairs = found.where("term IS NULL").groupBy("lang", "r", "other").agg(F.sum("value").alias("value"), F.sum("columns").alias("columns"))
    pairs = pairs.join(name, ["lang", "r"]).join(name.select("lang", F.col("r").alias("other"), F.col("source").alias("item"), F.col("p").alias("q")), ["lang", "other"])
    pairs = pairs.withColumn("value", F.expr("value + (v - columns) * ((p - q) * (p - q) div q)"))
    terms = found.where("term IS NOT NULL").join(name.select("lang", "r", "source"), ["lang", "r"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.union(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT row_number() OVER () AS k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM kept GROUP BY lang),
g AS (SELECT grp.lang, grp.source, coalesce(sum(c.n), 0) AS n FROM grp LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source GROUP BY ALL),
full_p AS (SELECT g.lang, g.source, kept.term, kept.total, coalesce(c.n, 0) AS cnt, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n::HUGEINT + l.v) AS p,
             1 + (1000000000::HUGEINT * (kept.total + 1)) // (l.nl::HUGEINT + l.v) AS q
           FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM full_p WHERE cnt > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= 200
"""

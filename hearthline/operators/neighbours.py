"""Exact cosine nearest neighbours.

Both sides are cut by a hash of their key into blocks of bounded bytes that travel together, and each task multiplies one query block with one
corpus block in small pieces, so a task's memory does not depend on either side. A task emits k rows per query, never all pairs; the best
k of all tasks follow by a window per query, over k rows per corpus block. Shuffled are the queries once per corpus block and the
corpus once per query block: blocks are as large as memory allows, whatever the pieces, and vectors travel in their own number type. Rows without a vector or key are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

BLOCK_BYTES = 32 << 20
SIM_DIGITS = 9
_QUERIES, _ROWS = 1024, 1024  # of one multiplication


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.asarray(vectors.tolist(), dtype="float64")
    norms = np.sqrt((m * m).sum(axis=1))
    norms[norms == 0.0] = 1.0
    return m / norms[:, None]


def _best(unit: np.ndarray, corpus: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarities and places of the k best corpus rows per query; ties go to the earlier place."""
    best, found = np.empty((len(unit), 0)), np.empty((len(unit), 0), dtype="int64")
    for at in range(0, len(corpus), _ROWS):
        part = corpus[at : at + _ROWS]
        sims = np.concatenate([best, np.round(unit @ part.T, SIM_DIGITS)], axis=1)
        places = np.concatenate([found, np.broadcast_to(np.arange(at, at + len(part)), (len(unit), len(part)))], axis=1)
        pick = np.lexsort((places, -sims), axis=1)[:, :k]
        best, found = np.take_along_axis(sims, pick, 1), np.take_along_axis(places, pick, 1)
    return best, found


def block_products(left: DataFrame, right: DataFrame, blocks: list[str], k: int, piece: int = _QUERIES) -> DataFrame:
    """(query, neighbour, similarity) of the k best rows of ``right`` per row of ``left`` in each pair of blocks; both have ``id`` and ``vec``.

    At most ``piece`` queries are multiplied at a time.
    """

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": left["id"][:0], "neighbour": right["id"][:0], "similarity": np.empty(0)})]
        if len(left) and len(right):
            right = right.sort_values("id")
            keys, rows = right["id"].to_numpy(), _unit_rows(right["vec"])
            for at in range(0, len(left), piece):
                part = left.iloc[at : at + piece]
                sims, places = _best(_unit_rows(part["vec"]), rows, k)
                out.append(pd.DataFrame({"query": np.repeat(part["id"].to_numpy(), sims.shape[1]), "neighbour": keys[places.ravel()], "similarity": sims.ravel()}))
        return pd.concat(out[1:] or out, ignore_index=True)

    schema = StructType().add("query", left.schema["id"].dataType).add("neighbour", right.schema["id"].dataType).add("similarity", DoubleType())
    return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(multiply, schema)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best neighbours per query with their ``rank``, ties by the smaller key."""
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), F.asc("neighbour"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbours(
    queries: DataFrame, corpus: DataFrame, id_col: str, vec_col: str, k: int = 15, *, block_bytes: int = BLOCK_BYTES, block_rows: int | None = None
) -> DataFrame:
    """(query, neighbour, similarity, rank) of the k most similar corpus rows per query, ties by the smaller key; keys of any type.

    A task multiplies at most about ``block_bytes`` of queries at a time. What travels as one block has ``block_rows`` rows where given, else at most
    about ``BLOCK_BYTES`` of vectors (or ``block_bytes``, if more), so small pieces send no row more often. Counts both sides in jobs of its own.
    """
    session = queries.sparkSession

    def vector(df: DataFrame) -> Column:
        # every float is a double: half the bytes travel
        return F.col(vec_col) if df.schema[vec_col].dataType == ArrayType(FloatType()) else F.col(vec_col).cast("array<double>")

    q, c = (df.select(F.col(id_col).alias("id"), vector(df).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL") for df in (queries, corpus))

    def sizes(df: DataFrame, least: int) -> tuple[int, int]:
        """Blocks of a side, and rows of ``block_bytes``."""
        seen = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("width")).first()
        of = 8 * max(seen["width"], 1)
        rows = block_rows or max(max(block_bytes, BLOCK_BYTES) // of, 1)
        return max(-(-seen["n"] // rows), min(least, seen["n"]), 1), max(block_bytes // of, 1)

    (q_blocks, piece), (c_blocks, _) = sizes(q, 1), sizes(c, session.sparkContext.defaultParallelism)

    def blocked(df: DataFrame, mine: str, n: int, other: str, m: int) -> DataFrame:
        own = df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        return own.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left, right = blocked(q, "qb", q_blocks, "cb", c_blocks), blocked(c, "cb", c_blocks, "qb", q_blocks)
    return best_of(block_products(left, right, ["qb", "cb"], k, min(piece, _QUERIES)), k)

"""Joining per-key results back to rows when a key may hold a large share of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.session import staged


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def attach_by_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    n_col: str,
    *,
    how: str = "left",
    broadcast_rows: int = 100_000,
    max_heavy: int = 512,
) -> DataFrame:
    """Add the columns of ``per_key`` (one row per key) to every row of ``rows``.

    ``per_key`` is written once to the shared folder, so its size is known and
    no later step aggregates again. Up to ``broadcast_rows`` keys it is
    broadcast. Beyond that, a key is heavy when its ``n_col`` is more than
    1/``max_heavy`` of all rows; there are fewer than ``max_heavy`` such keys
    whatever the data, and only they are broadcast. Rows of heavy keys are
    answered then and are spread by their own hash, so no join partition grows
    with a hot key. ``n_col`` is not part of the result.
    """
    payload = [c for c in per_key.columns if c not in keys and c != n_col]
    table = staged(per_key, "per-key")
    if table.count() <= broadcast_rows:
        return rows.join(F.broadcast(table.drop(n_col)), keys, how).select(*rows.columns, *payload)
    total = table.agg(F.sum(n_col)).first()[0]
    packed = table.select(*keys, F.struct(F.lit(True).alias("_hit"), *payload).alias("_pack"), F.col(n_col).alias("_n"))
    heavy = packed.where(F.col("_n") * max_heavy > total).select(*keys, F.col("_pack").alias("_heavy"))
    light = packed.where(F.col("_n") * max_heavy <= total)
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(65536)) + 1
    marked = rows.join(F.broadcast(heavy), keys, "left").withColumn(
        "_spread", F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise(spread)
    )
    joined = marked.join(
        light.select(*keys, F.lit(0).cast("bigint").alias("_spread"), F.col("_pack").alias("_light")),
        [*keys, "_spread"],
        "left",
    )
    out = joined.select(*rows.columns, F.coalesce("_heavy", "_light").alias("_pack"))
    if how == "inner":
        out = out.where(F.col("_pack._hit"))
    return out.select(*rows.columns, *[F.col(f"_pack.{c}").alias(c) for c in payload])

"""Permutation importance and counterfactual scoring."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthline.operators.evaluation import classification_metrics, confusion_cells
from hearthline.operators.orderstats import hash_positions
from hearthline.operators.splits import hash_sample
from hearthline.session import staged


def shuffled_column(df: DataFrame, col: str, id_col: str, seed: int | str) -> DataFrame:
    """(id, value): the column's values dealt out again by matching two seeded orders of the rows."""
    places = hash_positions(df.select(id_col), id_col, f"{seed}|to").select(id_col, "position")
    values = hash_positions(df.select(id_col, col), id_col, f"{seed}|from").select(F.col(col).alias("_new"), "position")
    return places.join(values, "position").select(id_col, "_new")


def permuted_positions(position: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0..n-1, one place at a time.

    Eight Feistel rounds over pairs (place // b, place % b) of a rectangle a x b that holds n or few more places; a place that
    leaves the range walks on until it is back in it, which keeps the map a bijection.
    """
    a = max(1, int(np.ceil(np.sqrt(n))))
    b = -(-n // a)
    out = position.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // np.uint64(b), out[todo] % np.uint64(b)
        for turn in range(4):
            left = (left + _mixed(right, key, 2 * turn) % np.uint64(a)) % np.uint64(a)
            right = (right + _mixed(left, key, 2 * turn + 1) % np.uint64(b)) % np.uint64(b)
        out[todo] = left * np.uint64(b) + right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _mixed(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    """64 well mixed bits per number, key and round."""
    z = x + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def variant_key(seed: int | str, feature: str, repeat: int) -> int:
    return int(hashlib.md5(f"{seed}|{feature}|{repeat}".encode()).hexdigest()[:15], 16)


def permuted_variants(df: DataFrame, features: list[str], id_col: str, repeats: int, seed: int | str) -> DataFrame:
    """Every row once as it is (feature '', repeat 0) and once per feature and repeat with that feature taken from another row.

    Rows get dense numbers once. Each row sends its value of every feature to one place per repeat; the values meet their rows in one shuffle of
    (place, variant, value) and one join by place, and the copies of whole rows exist only after that, inside the scoring stage.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    numbered = staged(hash_positions(df, id_col, f"{seed}|places"), "numbered")
    n = numbered.count()
    keys = [(i, r, variant_key(seed, f, r)) for i, f in enumerate(features) for r in range(repeats)]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["position"].to_numpy()
            for i, r, key in keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(permuted_positions(at, n, key)), pa.array(np.full(len(at), i, np.int32)), pa.array(np.full(len(at), r, np.int32)), batch[f"v{i}"]],
                    names=["position", "i", "r", "value"],
                )

    texts = numbered.select("position", *[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(features)])
    moves = texts.mapInArrow(places, "position long, i int, r int, value string")
    dealt = moves.groupBy("position").agg(F.collect_list(F.struct("i", "r", "value")).alias("moves"))  # features x repeats entries each
    own = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("r"), F.lit(None).cast("string").alias("value")))
    rows = numbered.join(dealt, "position").select(*df.columns, F.explode(F.concat(own, "moves")).alias("_m"))
    changed = {f: F.when(F.col("_m.i") == i, F.col("_m.value").cast(kinds[f])).otherwise(F.col(f)) for i, f in enumerate(features)}
    named = F.element_at(F.array(F.lit(""), *[F.lit(f) for f in features]), F.col("_m.i") + 2)
    return rows.select(named.alias("feature"), F.col("_m.r").alias("repeat"), *[changed.get(c, F.col(c)).alias(c) for c in df.columns])


def permutation_importance(
    df: DataFrame,
    features: list[str],
    id_col: str,
    score: Callable[[DataFrame], DataFrame],
    *,
    repeats: int = 5,
    sample: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """(feature, importance_mean, importance_std): drop in QWK when one column is shuffled.

    Rows carry the true code ``t``; ``score`` adds the predicted code ``p``. All
    variants are scored as one table and judged by one grouped count. All rows
    are used unless ``sample`` asks for that many, chosen by a hash of the id.
    """
    base = df if sample is None else hash_sample(df, sample, id_col, seed)
    scored = score(permuted_variants(base, features, id_col, repeats, seed))
    kappas = staged(
        classification_metrics(confusion_cells(scored, by=["feature", "repeat"]), ["feature", "repeat"], metrics=["qwk"]), "kappas"
    )
    whole = kappas.where("feature = ''").select("qwk").scalar()
    return kappas.where("feature <> ''").withColumn("drop", whole - F.col("qwk")).groupBy("feature").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")
    )


def counterfactuals(df: DataFrame, variants: dict[str, dict[str, Column]], name: str = "variant") -> DataFrame:
    """Every row once per named variant with that variant's columns replaced; ``variants`` is a short fixed list."""
    kinds = {f.name: f.dataType for f in df.schema}
    copies = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in variants])))
    touched = {c for override in variants.values() for c in override if c in kinds}
    new = {}
    for c in touched:
        value = F.col(c)
        for v, override in variants.items():
            if c in override:
                value = F.when(F.col(name) == v, override[c].cast(kinds[c])).otherwise(value)
        new[c] = value
    return copies.withColumns(new)

"""Segmentation of mixed numeric and categorical rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from hearthline.functions import scalars as S
from hearthline.operators.orderstats import mode_per_group, range_bucket, running_totals
from hearthline.operators.skew import attach_by_key
from hearthline.operators.splits import hash_sample
from hearthline.operators.summary import arg_max
from hearthline.session import staged


def mixed_frame(df: DataFrame, numeric: list[str], categorical: list[str], keep: list[str] | None = None) -> DataFrame:
    """Numbers as double, categories as text, complete rows only."""
    return df.select(
        *(keep or []),
        *[S.nan_to_null(F.col(c).cast("double")).alias(c) for c in numeric],
        *[F.col(c).cast("string").alias(c) for c in categorical],
    ).dropna(subset=[*numeric, *categorical])


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    stats = df.agg(
        F.struct(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.stddev_pop(c).alias(f"{c}_s") for c in cols])
    ).scalar()
    held = df.withColumn("_st", stats)
    scaled = {
        c: F.when(F.col(c).isNotNull(),
                  (F.col(c) - F.col("_st")[f"{c}_m"])
                  / F.when(F.col("_st")[f"{c}_s"] == 0, F.lit(1.0)).otherwise(F.col("_st")[f"{c}_s"]))
        for c in cols
    }
    return held.withColumns(scaled).drop("_st")


# --- K-Prototypes ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Prototypes:
    """Fitted centres: k rows of means and modes, plus the weight of a mismatch."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    means: tuple[tuple[float, ...], ...]
    modes: tuple[tuple[str, ...], ...]
    gamma: float
    cost: float = float("nan")
    rounds: int = 0
    cost_path: tuple[float, ...] = ()

    def distances(self) -> list[str]:
        """Cost of a row under every centre, as SQL text (one short parse instead of many column calls)."""
        out = []
        for means, modes in zip(self.means, self.modes):
            parts = [f"({c} - {m!r}D) * ({c} - {m!r}D)" for c, m in zip(self.numeric, means)]
            parts += [f"IF({c} = {_quoted(m)}, 0.0D, {self.gamma!r}D)" for c, m in zip(self.categorical, modes)]
            out.append(" + ".join(parts))
        return out

    def assign(self, df: DataFrame, name: str = "cluster", cost: str | None = None) -> DataFrame:
        """Nearest centre of every row; the lower number wins a tie."""
        costs = ", ".join(f"struct({d} AS d, {i} AS i)" for i, d in enumerate(self.distances()))
        held = df.select("*", F.expr(f"array_min(array({costs})) AS _best"))
        picked = ["_best.i AS " + name] + ([f"_best.d AS {cost}"] if cost else [])
        return held.selectExpr(*[c for c in df.columns if c not in (name, cost)], *picked)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_prototypes(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str],
    k: int,
    id_col: str,
    *,
    seed: int = 42,
    gamma: float = 0.5,
    max_rounds: int = 20,
    tolerance: float = 1e-6,
    starts: int = 3,
) -> Prototypes:
    """The cheapest of several starts; the first wins a tie. The frame is written once, since every round reads it."""
    frame = staged(df.select(id_col, *numeric, *categorical), "prototypes")
    return _cheapest(frame, numeric, categorical, [k], id_col, seed, gamma, max_rounds, tolerance, starts)[k]


def _cheapest(
    df: DataFrame, numeric: list[str], categorical: list[str], ks: Iterable[int], id_col: str,
    seed: int | str = 42, gamma: float = 0.5, max_rounds: int = 20, tolerance: float = 1e-6, starts: int = 3,
) -> dict[int, Prototypes]:
    """The cheapest start of every k. One pass over the rows per round serves every k and every start.

    The starting centres are the rows of the smallest seeded hashes. The centres are the only state between rounds, so no lineage builds up.
    """
    ks = list(ks)
    running: dict[tuple[int, int], Prototypes] = {}
    for i, own_seed in enumerate([seed, *(f"{seed}|{i}" for i in range(1, starts))]):
        rows = hash_sample(df.select(id_col, *numeric, *categorical), max(ks), id_col, own_seed).collect()
        for k in ks:
            means = tuple(tuple(float(r[c]) for c in numeric) for r in rows[:k])
            running[k, i] = Prototypes(tuple(numeric), tuple(categorical), means, tuple(tuple(r[c] for c in categorical) for r in rows[:k]), gamma)
    done: dict[tuple[int, int], Prototypes] = {}
    for turn in range(1, max_rounds + 1):
        found = _round(df, list(running.values()))
        for at, (job, model) in enumerate(list(running.items())):
            of = {(r["cluster"], r["column"]): r for r in found if r["model"] == at}
            path = (*model.cost_path, sum(r["total"] for (_, column), r in of.items() if column == ""))
            means = tuple(
                tuple(of[i, c]["total"] / of[i, c]["n"] if (i, c) in of else m for c, m in zip(numeric, old)) for i, old in enumerate(model.means)
            )
            modes = tuple(tuple(of[i, c]["value"] if (i, c) in of else m for c, m in zip(categorical, old)) for i, old in enumerate(model.modes))
            settled = len(path) > 1 and path[-2] - path[-1] <= tolerance * abs(path[-2])
            if settled or turn == max_rounds or (means == model.means and modes == model.modes):
                done[job] = replace(model, cost=path[-1], rounds=turn, cost_path=path)
                del running[job]
            else:
                running[job] = replace(model, means=means, modes=modes, cost_path=path)
        if not running:
            break
    return {k: min((done[k, i] for i in range(starts)), key=lambda m: m.cost) for k in ks}


def _round(df: DataFrame, models: list[Prototypes]) -> list[Row]:
    """Per model, cluster and column: rows, sum of the numbers or most frequent level; column '' holds the cost.

    Tasks add up their batches; equal levels meet by key, and one row per model, cluster and column comes back.
    """
    numeric, categorical, gamma = models[0].numeric, models[0].categorical, models[0].gamma

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in numeric], axis=1) if numeric else np.zeros((batch.num_rows, 0))
            levels = [batch[c].dictionary_encode() for c in categorical]
            codes = [d.indices.to_numpy() for d in levels]
            names = [d.dictionary.to_pylist() for d in levels]
            out: list[tuple] = []
            for at, m in enumerate(models):
                cost = np.stack([((x - np.array(mean)) ** 2).sum(axis=1) for mean in m.means], axis=1)
                for j, (code, name) in enumerate(zip(codes, names)):
                    place = {v: i for i, v in enumerate(name)}
                    cost += gamma * (code[:, None] != np.array([place.get(modes[j], -1) for modes in m.modes]))
                own = cost.argmin(axis=1)
                k = len(m.means)
                n = np.bincount(own, minlength=k)
                sums = [("", cost[np.arange(len(own)), own])] + [(c, x[:, i]) for i, c in enumerate(numeric)]
                for column, values in sums:
                    total = np.bincount(own, weights=values, minlength=k)
                    out += [(at, i, column, None, int(n[i]), float(total[i])) for i in np.flatnonzero(n)]
                for c, code, name in zip(categorical, codes, names):
                    count = np.bincount(own * len(name) + code, minlength=k * len(name))
                    out += [(at, int(i // len(name)), c, name[i % len(name)], int(count[i]), 0.0) for i in np.flatnonzero(count)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), _SUM_TYPES)], names=_SUM_NAMES)

    sums = df.select(*numeric, *categorical).mapInArrow(add_up, "model int, cluster int, column string, value string, n long, total double")
    added = sums.groupBy("model", "cluster", "column", "value").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return added.groupBy("model", "cluster", "column").agg(
        F.min_by(F.col("value"), F.struct(-F.col("n"), F.col("value"))).alias("value"), F.sum("n").alias("n"), F.sum("total").alias("total")
    ).collect()


_SUM_NAMES = ["model", "cluster", "column", "value", "n", "total"]
_SUM_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.float64()]


# --- mixed-type distance without pairs ------------------------------------------------------------


def group_distances(
    df: DataFrame,
    id_col: str,
    cluster: str,
    numeric: list[str],
    categorical: list[str],
    clusters: list[int],
    *,
    buckets: int | None = None,
) -> DataFrame:
    """Summed Gower distance of every row to the rows of each cluster: ``d0 .. d<k-1>``, with sizes ``n0 ..``.

    Gower distance is a mean over features, so the sum over a cluster needs
    only, per feature, the running count and sum of the cluster's values (or
    the count of equal categories). Exact for the whole table in
    O(rows * features * clusters), without ever forming a pair of rows.
    """
    ks = range(len(clusters))
    size_of = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).where(F.col(cluster).isin(*clusters)).collect()
    sizes = [next((r["n"] for r in size_of if r[cluster] == c), 0) for c in clusters]
    in_cluster = [f"count_if({cluster} = {c}) AS c{i}" for i, c in enumerate(clusters)]
    parts = []
    if numeric:
        # + 0.0 turns -0.0 into 0.0, so that equal numbers have equal texts below
        numbers = df.selectExpr(cluster, *[f"CAST({c} AS DOUBLE) + 0.0D AS {c}" for c in numeric]).unpivot(
            [cluster], numeric, "column", "value"
        )
        counts = numbers.groupBy("column", "value").agg(*[F.expr(e) for e in ["count(1) AS rows", *in_cluster]])
        counts = counts.selectExpr("*", *[f"c{i} * value AS s{i}" for i in ks])
        measures = [f"{m}{i}" for i in ks for m in "cs"]
        counts, ranges = range_bucket(counts, "value", ["column"], buckets)
        placed = running_totals(counts, ["value"], ["column"], measures, ranges)
        span = df.selectExpr(*[f"max({c}) - min({c}) AS {c}" for c in numeric]).first()
        width = "CASE column " + " ".join(f"WHEN '{c}' THEN {float(span[c]) or 1.0!r}D" for c in numeric) + " END"
        sums = ", ".join(
            f"(value * (2 * c{i}_before + c{i} - c{i}_total) - 2 * s{i}_before - s{i} + s{i}_total) / ({width})" for i in ks
        )
        parts.append(placed.selectExpr("column", "CAST(value AS STRING) AS key", "rows", f"array({sums}) AS f"))
    if categorical:
        levels = df.select(cluster, *categorical).unpivot([cluster], categorical, "column", "key")
        counts = levels.groupBy("column", "key").agg(*[F.expr(e) for e in ["count(1) AS rows", *in_cluster]])
        others = ", ".join(f"CAST({sizes[i]} - c{i} AS DOUBLE)" for i in ks)
        parts.append(counts.selectExpr("column", "key", "rows", f"array({others}) AS f"))
    per_value = reduce(DataFrame.unionByName, parts)
    long = df.selectExpr(
        id_col, cluster, *[f"CAST(CAST({c} AS DOUBLE) + 0.0D AS STRING) AS {c}" for c in numeric], *categorical
    ).unpivot([id_col, cluster], [*numeric, *categorical], "column", "key")
    features = float(len(numeric) + len(categorical))
    found = attach_by_key(long, per_value, ["column", "key"], "rows")
    return found.groupBy(id_col, cluster).agg(*[F.expr(f"sum(f[{i}]) / {features}D AS d{i}") for i in ks]).selectExpr(
        "*", *[f"{n} AS n{i}" for i, n in enumerate(sizes)]
    )


def mean_group_distance(distances: DataFrame, id_col: str, cluster: str, clusters: list[int]) -> DataFrame:
    """Mean distance to each cluster; a row is left out of its own cluster's mean."""
    means = []
    for i, c in enumerate(clusters):
        others = F.col(f"n{i}") - F.when(F.col(cluster) == c, 1).otherwise(0)
        means.append(F.try_divide(F.col(f"d{i}"), others.cast("double")).alias(f"mean{i}"))
    return distances.select(id_col, cluster, *means)


def silhouette(distances: DataFrame, id_col: str, cluster: str, clusters: list[int]) -> DataFrame:
    """Silhouette width of every row; 0 in a cluster of one."""
    means = mean_group_distance(distances, id_col, cluster, clusters)
    own = F.coalesce(*[F.when(F.col(cluster) == c, F.col(f"mean{i}")) for i, c in enumerate(clusters)])
    other = F.array_min(
        F.array(*[F.when(F.col(cluster) != c, F.col(f"mean{i}")) for i, c in enumerate(clusters)])
    )
    held = means.withColumns({"a": own, "b": other})
    width = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return held.select(id_col, cluster, F.coalesce(width, F.lit(0.0)).alias("silhouette"))


def separation_indices(df: DataFrame, cluster: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin on numbers plus one-hot categories.

    A 0/1 column's squared deviations follow from category counts, so the
    one-hot matrix is never built.
    """
    base = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in numeric],
        *[F.var_pop(c).alias(f"v_{c}") for c in numeric],
    )
    base = staged(base, "centres")
    whole = df.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(f"v_{c}") for c in numeric]).first()
    n_all = F.lit(float(whole["n"]))
    zero = F.lit(0.0)
    within_num = reduce(lambda a, b: a + b, [F.col("n") * F.col(f"v_{c}") for c in numeric], zero)
    long = df.select(cluster, *categorical).unpivot([cluster], categorical, "column", "value")
    cat = staged(long.groupBy(cluster, "column", "value").agg(F.count(F.lit(1)).alias("c")), "levels")
    per_cluster_cat = cat.groupBy(cluster).agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("sq"))
    total_cat = (
        cat.groupBy("column", "value").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c").cast("double") * F.col("c"))).scalar()
    )
    width = float(len(categorical))
    wss = base.join(per_cluster_cat, cluster).select(
        "*", (within_num + F.lit(width) * F.col("n") - F.col("sq") / F.col("n")).alias("wss")
    )
    inner = wss.agg(F.struct(F.sum("wss").alias("w"), F.count(F.lit(1)).alias("k"))).scalar()
    numeric_tss = F.lit(float(sum(whole["n"] * whole[f"v_{c}"] for c in numeric)))
    tss = numeric_tss + F.lit(width) * n_all - total_cat / n_all

    # Davies-Bouldin: mean distance to the centre, then the worst ratio per cluster.
    share = cat.join(base.select(cluster, "n"), cluster).select(
        cluster, "column", "value", (F.col("c") / F.col("n")).alias("share")
    )
    centre = base.select(
        cluster, *[F.col(f"m_{c}") for c in numeric]
    ).join(share.groupBy(cluster).agg(F.sum(F.col("share") * F.col("share")).alias("share_sq")), cluster)
    # cluster x category shares of one cluster as a map: as many entries as levels
    maps = share.groupBy(cluster).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "column", "value"), "share"))).alias("shares")
    )
    centres = centre.join(maps, cluster)
    # k rows only
    rows = df.join(F.broadcast(centres.withColumnRenamed(cluster, "_k")), F.col(cluster) == F.col("_k"))
    gap = reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.col(f"m_{c}"), 2) for c in numeric], zero)
    for c in categorical:
        gap = gap + 1.0 - 2.0 * F.coalesce(
            F.try_element_at("shares", F.concat_ws("\u0001", F.lit(c), F.col(c))), zero
        )
    spread = rows.groupBy(cluster).agg(F.avg(F.sqrt(F.greatest(gap + F.col("share_sq"), zero))).alias("s"))
    ends = staged(centres.join(spread, cluster), "spread")
    listed = ends.agg(
        F.collect_list(F.struct(cluster, "s", "share_sq", "shares", *[f"m_{c}" for c in numeric])).alias("all")
    ).scalar()
    ones = ends.withColumn("_all", listed)

    def ratio_to(o: Column) -> Column:
        num = reduce(lambda a, b: a + b, [F.pow(F.col(f"m_{c}") - o[f"m_{c}"], 2) for c in numeric], zero)
        dot = F.aggregate(
            F.map_entries("shares"), F.lit(0.0),
            lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(o["shares"], e["key"]), F.lit(0.0)),
        )
        return F.try_divide(F.col("s") + o["s"], F.sqrt(F.greatest(num + F.col("share_sq") + o["share_sq"] - 2.0 * dot, F.lit(0.0))))

    worst = F.array_max(
        F.transform(F.filter("_all", lambda o: o[cluster] != F.col(cluster)), ratio_to)
    )
    db = ones.agg(F.avg(worst)).scalar()
    return df.sparkSession.range(1).select(
        F.try_divide((tss - inner["w"]) * (n_all - inner["k"]), inner["w"] * (inner["k"] - 1)).alias("calinski_harabasz"),
        db.alias("davies_bouldin"),
    )


# --- profiles -------------------------------------------------------------------------------------


def segment_profile(
    df: DataFrame, cluster: str, score: str, numeric: list[str], modal: list[str]
) -> DataFrame:
    """n, percent, means and modal values per segment."""
    total = df.agg(F.count(F.lit(1))).scalar()
    out = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        *[F.avg(c).alias(f"mean_{c}") for c in numeric],
    ).withColumn("pct", F.col("n") * 100.0 / total)
    for c in modal:
        out = out.join(mode_per_group(df, [cluster], c, f"modal_{c}"), cluster, "left")
    return out


def standardised_profile(df: DataFrame, cluster: str, numeric: list[str]) -> DataFrame:
    """(cluster mean - global mean) / global sample deviation."""
    stats = df.agg(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_samp(c).alias(f"s_{c}") for c in numeric])
    ).scalar()
    means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in numeric]).withColumn("_st", stats)
    return means.select(
        cluster,
        *[F.try_divide(F.col(c) - F.col("_st")[f"m_{c}"], F.col("_st")[f"s_{c}"]).alias(f"z_{c}") for c in numeric],
    )


def sweep(
    df: DataFrame, numeric: list[str], categorical: list[str], id_col: str, ks: range = range(2, 8), **fit
) -> DataFrame:
    """Cost, silhouette and separation per k. All fits share their passes over the staged frame; only the finished row of each k comes back."""
    # one even part per core, since well packed rows come in few splits
    even = df.select(id_col, *numeric, *categorical).repartition(df.sparkSession.sparkContext.defaultParallelism)
    df = staged(even, "sweep")
    rows = []
    for k, model in _cheapest(df, numeric, categorical, ks, id_col, **fit).items():
        labelled = staged(model.assign(df), "labelled")
        clusters = list(range(k))
        distances = group_distances(labelled, id_col, "cluster", numeric, categorical, clusters)
        width = silhouette(distances, id_col, "cluster", clusters).agg(F.avg("silhouette").alias("silhouette")).first()
        indices = separation_indices(labelled, "cluster", numeric, categorical).first()
        rows.append(
            (k, model.cost, width["silhouette"], indices["calinski_harabasz"], indices["davies_bouldin"])
        )
    return df.sparkSession.createDataFrame(
        rows, "k int, cost double, silhouette double, calinski_harabasz double, davies_bouldin double"
    )


def best_k(swept: DataFrame) -> DataFrame:
    """The k with the widest silhouette; the smaller k wins a tie."""
    return arg_max(swept, "k", "silhouette")

"""Threshold search, cross-validation, parameter search and ablation."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.hashing import uniform
from hearthline.operators.evaluation import K, classification_metrics, confusion_cells
from hearthline.operators.summary import fold_aggregate
from hearthline.session import staged

GRID = tuple(round(0.1 + 0.05 * i, 2) for i in range(17))


def threshold_cells(df: DataFrame, probs: str, code: str, grid: Iterable[float] = GRID) -> DataFrame:
    """(t, g0..g6, n): how many grid values each cumulative probability reaches, counted.

    Every threshold of the search lies on the grid, so these counts decide every
    prediction. The g's never fall from one class to the next, which bounds the
    number of distinct cells whatever the number of rows.
    """
    marks = list(grid)
    cum = df.select(
        F.col(code).alias("t"),
        *[F.expr(" + ".join(f"{probs}[{j}]" for j in range(k + 1))).alias(f"c{k}") for k in range(K)],
    )
    reached = [F.expr(" + ".join(f"IF(c{k} >= {g!r}D, 1, 0)" for g in marks)).alias(f"g{k}") for k in range(K)]
    return cum.select("t", *reached).groupBy("t", *[f"g{k}" for k in range(K)]).agg(F.count(F.lit(1)).alias("n"))


def _first_hit(classes: range, steps: list[int], otherwise: int) -> Column:
    """First of the classes whose reached count is at its step."""
    arms = " ".join(f"WHEN g{k} >= {steps[k]} THEN {k}" for k in classes)
    return F.expr(f"CASE {arms} ELSE {otherwise} END" if arms else str(otherwise))


def tune_thresholds(
    df: DataFrame, probs: str, code: str, grid: Iterable[float] = GRID, sweeps: int = 3, gain: float = 1e-5
) -> tuple[list[float], float]:
    """Coordinate search for the thresholds of highest QWK. Rows are read once; the search works on the counted cells."""
    marks = list(grid)
    cells = staged(threshold_cells(df, probs, code, marks), "threshold-cells")

    def kappas(steps: list[int], k: int) -> dict[int, float]:
        # a candidate only matters between the classes hit before and after k
        narrow = cells.groupBy(
            "t", _first_hit(range(k), steps, -1).alias("before"), F.col(f"g{k}").alias("g"),
            _first_hit(range(k + 1, K), steps, K - 1).alias("after"),
        ).agg(F.sum("n").alias("n"))
        trial = narrow.withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(len(marks)))))
        p = F.expr(f"CASE WHEN before >= 0 THEN before WHEN g >= candidate THEN {k} ELSE after END")
        counted = trial.groupBy("candidate", "t", p.alias("p")).agg(F.sum("n").alias("n"))
        return {r["candidate"]: r["qwk"] for r in classification_metrics(counted, ["candidate"], metrics=["qwk"]).collect()}

    best = [marks.index(0.5) + 1] * K
    best_qwk = kappas(best, 0)[best[0]]
    best_qwk = -1.0 if best_qwk is None else best_qwk
    for _ in range(sweeps):
        improved = False
        for k in range(K):
            found = kappas(best, k)
            for step in range(1, len(marks) + 1):
                if found[step] is not None and found[step] > best_qwk + gain:
                    best[k], best_qwk, improved = step, found[step], True
        if not improved:
            break
    return [marks[i - 1] for i in best], best_qwk


# --- runs over folds and configurations -----------------------------------------------------------

FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def cross_validate(df: DataFrame, configs: dict[str, FitPredict], fold: str = "fold", k: int = 5, parallelism: int = 2) -> DataFrame:
    """(config, fold, metrics): every configuration on every fold, a few fits at a time.

    A configuration gets (train, validation) and returns the validation rows
    with the codes ``t`` and ``p``; one row of metrics per run comes back.
    """
    return run_folds(staged(df, "folds"), configs, fold, k, parallelism)


def run_folds(df: DataFrame, configs: dict[str, FitPredict], fold: str = "fold", k: int = 5, parallelism: int = 2) -> DataFrame:
    """``cross_validate`` of a table that is cheap to read again and again."""

    def one(job: tuple[str, int]) -> tuple:
        name, i = job
        scored = configs[name](df.where(F.col(fold) != i), df.where(F.col(fold) == i))
        m = classification_metrics(confusion_cells(scored)).first()
        return (name, i, m["n"], m["accuracy"], m["balanced_accuracy"], m["macro_f1"], m["qwk"])

    jobs = [(name, i) for name in configs for i in range(k)]
    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(one, jobs))
    return df.sparkSession.createDataFrame(
        rows, "config string, fold int, n bigint, accuracy double, balanced_accuracy double, macro_f1 double, qwk double"
    )


def summarise_folds(runs: DataFrame) -> DataFrame:
    return fold_aggregate(runs, "config", ["accuracy", "balanced_accuracy", "macro_f1", "qwk"])


Space = dict[str, tuple[float, float, str]]


def from_unit(space: Space, units: dict[str, float]) -> dict:
    """Values between 0 and 1 to the named ranges (low, high, kind); kind is int, float or log, or log-int."""
    draw = {}
    for n, (lo, hi, kind) in space.items():
        draw[n] = (lo * (hi / lo) ** units[n]) if kind.startswith("log") else lo + (hi - lo) * units[n]
        if kind.endswith("int"):
            draw[n] = int(round(draw[n]))
    return draw


def draw_parameters(spark, space: Space, trials: int, seed: int | str = 42) -> list[dict]:
    """Random draws per named range."""
    names = list(space)
    rows = spark.range(trials).select("id", *[uniform(f"{seed}|{n}", F.col("id")).alias(n) for n in names]).orderBy("id").collect()
    return [from_unit(space, r.asDict()) for r in rows]


class Parzen:
    """One window per seen value between 0 and 1, and a flat one; the width is the wider gap to a neighbour (Bergstra et al., 2011)."""

    def __init__(self, seen: list[float]):
        self.at = sorted(seen)
        around = [0.0, *self.at, 1.0]
        floor = 1.0 / min(100.0, len(self.at) + 2.0)
        self.width = [max(floor, around[i] - around[i - 1], around[i + 1] - around[i]) for i in range(1, len(around) - 1)]

    def draw(self, rng: random.Random) -> float:
        i = rng.randrange(len(self.at) + 1)
        if i == len(self.at):
            return rng.random()
        while True:
            x = rng.gauss(self.at[i], self.width[i])
            if 0.0 <= x <= 1.0:
                return x

    def density(self, x: float) -> float:
        total = 1.0
        for m, s in zip(self.at, self.width):
            inside = 0.5 * (math.erf((1.0 - m) / s / math.sqrt(2)) - math.erf(-m / s / math.sqrt(2)))
            total += math.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi) * inside)
        return total / (len(self.at) + 1)


def propose(history: list[tuple[dict[str, float], float]], space: Space, seed: int | str, startup: int = 5, share: float = 0.25, candidates: int = 24) -> dict[str, float]:
    """Units of the next trial: random at first, then the candidate that is likeliest among the best trials against the others.

    ``history`` holds (units, value), larger values being better; it and the proposals depend on the seed and the number of the trial alone.
    """
    rng = random.Random(f"{seed}|{len(history)}")
    if len(history) < startup:
        return {n: rng.random() for n in space}
    ranked = sorted(history, key=lambda h: -h[1])
    best = math.ceil(share * len(ranked))
    out = {}
    for n in space:
        good, bad = (Parzen([units[n] for units, _ in part]) for part in (ranked[:best], ranked[best:]))
        out[n] = max((good.draw(rng) for _ in range(candidates)), key=lambda x: math.log(good.density(x)) - math.log(bad.density(x)))
    return out


def parzen_search(
    df: DataFrame, fit: Callable[..., FitPredict], space: Space, trials: int = 8, fold: str = "fold", k: int = 3, seed: int | str = 42, parallelism: int = 3
) -> DataFrame:
    """Mean QWK of every trial over the folds, each trial chosen by what the earlier ones gave. The folds of a trial run side by side."""
    df = staged(df, "trials")
    history: list[tuple[dict[str, float], float]] = []
    rows = []
    for i in range(trials):
        units = propose(history, space, seed)
        chosen = from_unit(space, units)
        found = summarise_folds(run_folds(df, {"trial": fit(**chosen)}, fold, k, parallelism)).first()
        history.append((units, -math.inf if found["qwk_mean"] is None else found["qwk_mean"]))
        rows.append((f"trial-{i:03d}", str(chosen), k, found["qwk_mean"], found["qwk_std"]))
    return df.sparkSession.createDataFrame(rows, "config string, parameters string, folds int, qwk_mean double, qwk_std double")


def search(df: DataFrame, fit: Callable[..., FitPredict], draws: list[dict], fold: str = "fold", k: int = 3, parallelism: int = 2) -> DataFrame:
    """Mean QWK of every draw over the folds; ``fit(**draw)`` gives a configuration."""
    configs = {f"trial-{i:03d}": fit(**d) for i, d in enumerate(draws)}
    runs = summarise_folds(cross_validate(df, configs, fold, k, parallelism))
    named = df.sparkSession.createDataFrame([(f"trial-{i:03d}", str(d)) for i, d in enumerate(draws)], "config string, parameters string")
    return runs.join(named, "config").select("config", "parameters", "folds", "qwk_mean", "qwk_std")


def ablate(switches: dict[str, dict], run: Callable[..., DataFrame]) -> DataFrame:
    """(config, metrics) of every named set of switches; ``run`` returns rows with the codes ``t`` and ``p``."""
    rows, spark = [], None
    for name, options in switches.items():
        scored = run(**options)
        spark = scored.sparkSession
        m = classification_metrics(confusion_cells(scored)).first()
        rows.append((name, m["n"], m["accuracy"], m["macro_f1"], m["qwk"]))
    return spark.createDataFrame(rows, "config string, n bigint, accuracy double, macro_f1 double, qwk double")

"""Metrics of ordinal and numeric predictions, computed from confusion cells.

Every metric needs one pass that counts (group, truth, prediction) cells, at
most K*K per group; the rest is arithmetic on those few rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.operators.orderstats import exact_percentiles

K = len(C.BANDS)


def _total(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def prediction_frame(
    df: DataFrame, score_true: str, score_pred: str, by: Iterable[str] = (), extra: Iterable[str] = ()
) -> DataFrame:
    """Scores plus the class index (0..6) of truth ``t`` and prediction ``p``."""
    return df.select(
        *by,
        *extra,
        F.col(score_true).cast("double").alias("y"),
        F.col(score_pred).cast("double").alias("yhat"),
        S.score_to_code(F.col(score_true)).alias("t"),
        S.score_to_code(F.col(score_pred)).alias("p"),
    )


def confusion_cells(df: DataFrame, true: str = "t", pred: str = "p", by: Iterable[str] = ()) -> DataFrame:
    """Count of every (truth, prediction) cell that occurs."""
    both = F.col(true).isNotNull() & F.col(pred).isNotNull()
    # rows without a class count as 0 and go afterwards; a filter before the count
    # would compute both class expressions twice per row
    counted = df.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count_if(both).alias("n"))
    return counted.where(F.col("n") > 0)


def confusion_grid(df: DataFrame, true: str = "t", pred: str = "p") -> DataFrame:
    """All K*K cells, zero where nothing was counted."""
    grid = df.sparkSession.range(K * K).select(
        F.floor(F.col("id") / K).cast("int").alias("t"), (F.col("id") % K).cast("int").alias("p")
    )
    cells = confusion_cells(df, true, pred)
    return grid.join(cells, ["t", "p"], "left").select(
        S.decode_band(F.col("t")).alias("truth"), S.decode_band(F.col("p")).alias("prediction"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _marginals(cells: DataFrame, by: Iterable[str], n: str = "n") -> DataFrame:
    """Per group: class totals of truth (t0..), prediction (p0..) and agreement (d0..), and weighted distances."""
    per_class = [
        f"sum(CASE WHEN {test.format(k=k)} THEN {n} ELSE 0 END) AS {name}{k}"
        for name, test in (("t", "t = {k}"), ("p", "p = {k}"), ("d", "t = {k} AND p = {k}"))
        for k in range(K)
    ]
    sums = [f"sum({n}) AS n", f"sum({n} * abs(t - p)) AS off1", f"sum({n} * (t - p) * (t - p)) AS off2"]
    return cells.groupBy(*by).agg(*[F.expr(e) for e in [*sums, *per_class]])


def _joined(parts: Iterable[str], op: str = " + ") -> str:
    return "(" + op.join(parts) + ")"


def _f1(k: int) -> str:
    return f"coalesce(try_divide(2.0D * d{k}, CAST(t{k} + p{k} AS DOUBLE)), 0.0D)"


def _class_ratio(k: int, over: str) -> str:
    return f"try_divide(CAST(d{k} AS DOUBLE), CAST({over}{k} AS DOUBLE))"


def _kappa(observed: str, expected: str) -> str:
    """1 - observed / expected weighted distance; expected is what independent margins give, times n."""
    return f"1.0D - try_divide({observed} * CAST(n AS DOUBLE), {expected})"


def _expected_linear() -> str:
    """Sum of |i-j| t_i p_j: at every cut between two classes, the pairs that lie on its two sides."""
    cuts = []
    for k in range(K - 1):
        t, p = (_joined(f"{side}{i}" for i in range(k + 1)) for side in "tp")
        cuts.append(f"CAST({t} AS DOUBLE) * (n - {p}) + CAST({p} AS DOUBLE) * (n - {t})")
    return _joined(cuts)


def _expected_quadratic() -> str:
    """Sum of (i-j)^2 t_i p_j from the first two moments of the margins."""
    m = {side: _joined(f"{i} * {side}{i}" for i in range(1, K)) for side in "tp"}
    sq = _joined(f"{i * i} * (t{i} + p{i})" for i in range(1, K))
    return f"(CAST(n AS DOUBLE) * {sq} - 2.0D * {m['t']} * {m['p']})"


def metric_expressions() -> dict[str, str]:
    """Named metrics over the marginal columns."""
    hit = _joined(f"d{k}" for k in range(K))
    recalls = _joined(f"coalesce({_class_ratio(k, 't')}, 0.0D)" for k in range(K))
    seen = _joined(f"CASE WHEN t{k} > 0 THEN 1.0D ELSE 0.0D END" for k in range(K))
    return {
        "accuracy": f"try_divide(CAST({hit} AS DOUBLE), CAST(n AS DOUBLE))",
        "balanced_accuracy": f"try_divide({recalls}, {seen})",
        "macro_f1": f"{_joined(_f1(k) for k in range(K))} / {float(K)}D",
        "qwk": _kappa("off2", _expected_quadratic()),
        "linear_kappa": _kappa("off1", _expected_linear()),
        "mae_bands": "try_divide(CAST(off1 AS DOUBLE), CAST(n AS DOUBLE))",
    }


def classification_metrics(
    cells: DataFrame, by: Iterable[str] = (), n: str = "n", metrics: Iterable[str] | None = None
) -> DataFrame:
    """Accuracy, balanced accuracy, macro-F1, both kappas and the mean band distance per group."""
    by, known = list(by), metric_expressions()
    wanted = [F.expr(known[m]).alias(m) for m in (metrics or known)]
    return _marginals(cells, by, n).select(*by, "n", *wanted)


def per_class_metrics(cells: DataFrame, by: Iterable[str] = (), n: str = "n") -> DataFrame:
    """precision, recall, F1 and support of every class; 0 where undefined."""
    by = list(by)
    rows = ", ".join(
        f"named_struct('band', '{C.BANDS[k]}', 'precision', coalesce({_class_ratio(k, 'p')}, 0.0D), "
        f"'recall', coalesce({_class_ratio(k, 't')}, 0.0D), 'f1', {_f1(k)}, 'support', t{k})"
        for k in range(K)
    )
    return _marginals(cells, by, n).select(*by, F.expr(f"inline(array({rows}))"))


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Iterable[str] = ()) -> DataFrame:
    err = F.col(yhat) - F.col(y)
    sums = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.var_pop(y).alias("var"),
    )
    return sums.select(
        *by, "n", "mae", F.sqrt("mse").alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("var"))).alias("r2"),
    )


def within_points(df: DataFrame, y: str = "y", yhat: str = "yhat", points: Iterable[int] = (5, 10, 15)) -> DataFrame:
    err = F.abs(F.col(yhat) - F.col(y))
    return df.agg(*[F.avg((err <= k).cast("double")).alias(f"within_{k}") for k in points])


def segment_metrics(
    df: DataFrame,
    segment: str,
    score_true: str,
    score_pred: str,
    *,
    min_support: int = 30,
    points: Iterable[int] = (5, 10, 15),
) -> DataFrame:
    """Every metric per segment of at least ``min_support`` rows, from one pass over the rows.

    Rows without a segment, a true or a predicted score are left out before anything is counted.
    """
    points = list(points)
    rows = prediction_frame(df.dropna(subset=[segment, score_true, score_pred]), score_true, score_pred, [segment])
    err = F.col("yhat") - F.col("y")
    cells = rows.groupBy(segment, "t", "p").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(err)).alias("abs_err"),
        F.sum(err * err).alias("sq_err"),
        F.sum("y").alias("sy"),
        F.sum(F.col("y") * F.col("y")).alias("syy"),
        *[F.count_if(F.abs(err) <= k).alias(f"w{k}") for k in points],
    )
    classes = classification_metrics(cells, [segment]).where(F.col("n") >= min_support)
    n = F.sum("n").cast("double")
    spread = F.sum("syy") - F.sum("sy") * F.sum("sy") / n
    numbers = cells.groupBy(segment).agg(
        (F.sum("abs_err") / n).alias("mae"),
        F.sqrt(F.sum("sq_err") / n).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum("sq_err"), spread)).alias("r2"),
        *[(F.sum(f"w{k}") / n).alias(f"within_{k}") for k in points],
    )
    return classes.join(numbers, segment)


# --- quantile bins --------------------------------------------------------------------------------


def quantile_edges(df: DataFrame, value: str, bins: int, *, bounded: bool = False) -> DataFrame:
    """One row e0 .. e<bins> of quantile edges."""
    return exact_percentiles(df, value, {f"e{i}": i / bins for i in range(bins + 1)}, bounded=bounded)


def with_quantile_bin(
    df: DataFrame, value: str, bins: int, name: str = "bin", *, bounded: bool = False
) -> DataFrame:
    """0-based bin of a value between quantile edges; bins are half-open, the last one closed."""
    edges = quantile_edges(df, value, bins, bounded=bounded)
    packed = edges.select(F.struct(*edges.columns)).scalar()
    inner = [F.col("_edges")[f"e{i}"] for i in range(1, bins)]
    index = _total([F.when(F.col(value) >= e, 1).otherwise(0) for e in inner])
    return df.withColumn("_edges", packed).withColumn(name, F.when(F.col(value).isNotNull(), index)).drop("_edges")


def confidence_bins(
    df: DataFrame, confidence: str, bins: int = 4, min_rows: int = 50, *, bounded: bool = False
) -> DataFrame:
    """QWK and accuracy per confidence quantile (``df`` has ``t``, ``p``); thin bins are skipped."""
    binned = with_quantile_bin(df, confidence, bins, bounded=bounded)
    metrics = classification_metrics(confusion_cells(binned, by=["bin"]), ["bin"], metrics=["qwk", "accuracy"])
    span = binned.groupBy("bin").agg(F.min(confidence).alias("low"), F.max(confidence).alias("high"))
    return (
        metrics.where(F.col("n") >= min_rows)
        .join(span, "bin")
        .select((F.col("bin") + 1).alias("quantile"), "n", "low", "high", "qwk", "accuracy")
    )


def is_monotone(bins: DataFrame, order: str = "quantile", metric: str = "qwk") -> DataFrame:
    """Does the metric rise with every bin? The input is one row per bin."""
    listed = bins.agg(F.array_sort(F.collect_list(F.struct(order, metric))).alias("b"))
    steps = F.zip_with(
        F.slice(F.col("b"), 1, F.size("b") - 1), F.slice(F.col("b"), 2, F.size("b") - 1), lambda x, y: y[metric] >= x[metric]
    )
    return listed.select(F.forall(steps, lambda s: s).alias("monotone"), F.size("b").alias("bins"))


def reliability(df: DataFrame, label: str, prob: str, bins: int = 10) -> DataFrame:
    """Mean probability and observed share per equal-width bin, with the Brier score on every row.

    Rows without a label or a probability are left out.
    """
    df = df.dropna(subset=[label, prob])
    index = _total([F.when(F.col(prob) >= i * (1.0 / bins), 1).otherwise(0) for i in range(1, bins)])
    sq = F.pow(F.col(prob) - F.col(label), 2)
    cells = df.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_pred"),
        F.avg(F.col(label).cast("double")).alias("observed"), F.sum(sq).alias("sq"),
    )
    brier = cells.agg(F.sum("sq") / F.sum("n")).scalar()
    return cells.select("bin", "n", "mean_pred", "observed", brier.alias("brier"))


def score_reliability(
    df: DataFrame, y: str = "y", yhat: str = "yhat", bins: int = 10, min_rows: int = 5, *, bounded: bool = False
) -> DataFrame:
    """Mean predicted against mean observed score per decile."""
    binned = with_quantile_bin(df, yhat, bins, bounded=bounded)
    return (
        binned.groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(yhat).alias("mean_pred"), F.avg(y).alias("mean_obs"))
        .where(F.col("n") >= min_rows)
    )


def calibration_line(bins: DataFrame) -> DataFrame:
    return bins.agg(
        F.regr_slope("mean_obs", "mean_pred").alias("slope"),
        F.regr_intercept("mean_obs", "mean_pred").alias("intercept"),
        F.count(F.lit(1)).alias("bins_used"),
    )


# --- error structure ------------------------------------------------------------------------------


def error_structure(df: DataFrame, true: str = "t", pred: str = "p") -> DataFrame:
    """How far and in which direction predictions miss; class 0 is the best."""
    gap = F.col(pred) - F.col(true)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(gap == 0).alias("correct"),
        F.count_if(F.abs(gap) == 1).alias("off_by_1"),
        F.count_if(F.abs(gap) == 2).alias("off_by_2"),
        F.count_if(F.abs(gap) >= 3).alias("off_by_3_plus"),
        F.count_if(gap < 0).alias("predicted_better"),
        F.count_if(gap > 0).alias("predicted_worse"),
    )
    ratio = F.col("predicted_worse") / F.greatest(F.col("predicted_better"), F.lit(1))
    return counts.withColumn("conservative_bias_ratio", ratio)


def tail_recall(df: DataFrame, true: str = "t", pred: str = "p", tail: Iterable[str] = C.TAIL_BANDS) -> DataFrame:
    """Recall of the worst bands taken as a set, and of each one alone."""
    codes = [C.BANDS.index(b) for b in tail]
    in_tail, hit = F.col(true).isin(codes), F.col(pred).isin(codes)
    single = [
        F.coalesce(
            F.try_divide(F.count_if((F.col(true) == k) & (F.col(pred) == k)).cast("double"),
                         F.count_if(F.col(true) == k).cast("double")), F.lit(0.0)
        ).alias(f"recall_{C.BANDS[k]}")
        for k in codes
    ]
    return df.agg(
        (F.count_if(in_tail & hit) / F.greatest(F.count_if(in_tail), F.lit(1))).alias("tail_recall"), *single
    )


def config_deltas(metrics: DataFrame, config: str, base: str, cols: list[str]) -> DataFrame:
    """Difference of every metric from the base configuration."""
    ref = metrics.where(F.col(config) == base).select(F.struct(*cols)).scalar()
    out = metrics.withColumn("_base", ref)
    return out.select(
        config, *cols, *[(F.col(c) - F.col("_base")[c]).alias(f"{c}_delta") for c in cols]
    )

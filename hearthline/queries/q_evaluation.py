"""Metrics of ordinal and numeric predictions, and their bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.operators import bootstrap as B, evaluation as E
from hearthline.operators.summary import fold_aggregate
from hearthline.queries.q_scalars import confidence_sql
from hearthline.queries.registry import query, rounded, rsql
from hearthline.queries.roles import hash_sql, pred_cte, predictions, table, uniform_sql

BAND_VALUES = ", ".join(f"({i}, '{b}')" for i, b in enumerate(C.BANDS))
METRIC_NAMES = "accuracy balanced_accuracy macro_f1 qwk linear_kappa mae_bands"


def metric_ctes(cells: str, by: list[str], n: str = "n") -> str:
    """CTEs from a cell table (by.., t, p, n) to ``m`` (by.., n, metrics), written with joins over a class list."""
    keys = "".join(f"{b}, " for b in by)
    on = " AND ".join(f"{{a}}.{b} = {{b}}.{b}" for b in by) or "TRUE"
    eq = lambda a, b: on.replace("{a}", a).replace("{b}", b)
    grp = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""cc AS (SELECT {keys}t, p, sum({n})::DOUBLE AS n FROM {cells} GROUP BY {keys}t, p),
 tot AS (SELECT {keys}sum(n) AS n, sum(CASE WHEN t = p THEN n ELSE 0 END) AS hit, sum(n * abs(t - p)) AS o1, sum(n * (t - p) * (t - p)) AS o2 FROM cc {grp}),
 kl AS (SELECT {keys.replace(', ', ', ')}k FROM (SELECT {keys}n AS nn FROM tot) CROSS JOIN range(7) r(k)),
 cls AS (SELECT {''.join(f'kl.{b}, ' for b in by)}kl.k, coalesce(sum(CASE WHEN t = kl.k THEN n END), 0) AS nt, coalesce(sum(CASE WHEN p = kl.k THEN n END), 0) AS np,
 coalesce(sum(CASE WHEN t = kl.k AND p = kl.k THEN n END), 0) AS nd FROM kl LEFT JOIN cc ON {eq('kl', 'cc')} GROUP BY {''.join(f'kl.{b}, ' for b in by)}kl.k),
 ex AS (SELECT {''.join(f'a.{b}, ' for b in by)}sum(a.nt * b.np * abs(a.k - b.k)) AS e1, sum(a.nt * b.np * (a.k - b.k) * (a.k - b.k)) AS e2 FROM cls a JOIN cls b ON {eq('a', 'b')}
 {'GROUP BY ' + ', '.join(f'a.{b}' for b in by) if by else ''}),
 pc AS (SELECT {keys}avg(CASE WHEN nt > 0 THEN nd / nt END) AS bal, avg(CASE WHEN nt + np > 0 THEN 2 * nd / (nt + np) ELSE 0 END) AS f1 FROM cls {grp}),
 m AS (SELECT {''.join(f'tot.{b}, ' for b in by)}CAST(tot.n AS BIGINT) AS n, hit / tot.n AS accuracy, bal AS balanced_accuracy, f1 AS macro_f1, 1 - o2 * tot.n / nullif(e2, 0) AS qwk,
 1 - o1 * tot.n / nullif(e1, 0) AS linear_kappa, o1 / tot.n AS mae_bands FROM tot JOIN ex ON {eq('tot', 'ex')} JOIN pc ON {eq('tot', 'pc')})"""


CELLS = "cells AS (SELECT t, p, count(*) AS n FROM pred GROUP BY 1, 2)"
ALL_METRICS = f"WITH {pred_cte()}, {CELLS}, {metric_ctes('cells', [])}"


@query("evl1_confusion_grid", f"WITH {pred_cte()}, b(i, b) AS (VALUES {BAND_VALUES}) SELECT a.b AS truth, c.b AS prediction, count(pred.t) AS n "
       "FROM b a CROSS JOIN b c LEFT JOIN pred ON pred.t = a.i AND pred.p = c.i GROUP BY 1, 2")
def evl1(spark, d):
    return E.confusion_grid(predictions(spark, d, "t", "p"))


def _cells(spark, d, *by):
    return E.confusion_cells(predictions(spark, d), by=list(by))


@query("evl2_accuracy", rsql(f"{ALL_METRICS} SELECT n, accuracy, balanced_accuracy FROM m", "accuracy balanced_accuracy"))
def evl2(spark, d):
    return rounded(E.classification_metrics(_cells(spark, d)).select("n", "accuracy", "balanced_accuracy"))


@query("evl3_per_class", rsql(f"{ALL_METRICS}, b(i, b) AS (VALUES {BAND_VALUES}) SELECT b.b AS band, CASE WHEN np > 0 THEN nd / np ELSE 0 END AS \"precision\", "
       "CASE WHEN nt > 0 THEN nd / nt ELSE 0 END AS recall, CASE WHEN nt + np > 0 THEN 2 * nd / (nt + np) ELSE 0 END AS f1, CAST(nt AS BIGINT) AS support FROM cls JOIN b ON b.i = cls.k",
       "recall f1").replace("REPLACE (", 'REPLACE (floor("precision" * 1e6::DOUBLE + 0.50001::DOUBLE) / 1e6::DOUBLE AS "precision", '))
def evl3(spark, d):
    return rounded(E.per_class_metrics(_cells(spark, d)))


@query("evl3_macro_f1", rsql(f"{ALL_METRICS} SELECT n, macro_f1 FROM m", "macro_f1"))
def evl3_macro(spark, d):
    return rounded(E.classification_metrics(_cells(spark, d)).select("n", "macro_f1"))


@query("evl4_weighted_kappas", rsql(f"{ALL_METRICS} SELECT * FROM m", METRIC_NAMES))
def evl4(spark, d):
    return rounded(E.classification_metrics(_cells(spark, d)))


_REG = ("count(*) AS n, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, 1 - avg((yhat - y) * (yhat - y)) / var_pop(y) AS r2")


@query("evl5_regression", rsql(f"WITH {pred_cte()} SELECT {_REG} FROM pred", "mae rmse r2"))
def evl5(spark, d):
    return rounded(E.regression_metrics(predictions(spark, d, "y", "yhat")))


@query("evl6_mae_bands", rsql(f"WITH {pred_cte()} SELECT avg(abs(t - p)) AS mae_bands FROM pred", "mae_bands"))
def evl6(spark, d):
    return rounded(E.classification_metrics(_cells(spark, d)).select("mae_bands"))


_WITHIN = ", ".join(f"avg(CAST(abs(yhat - y) <= {k} AS DOUBLE)) AS within_{k}" for k in (5, 10, 15))


@query("evl7_within_points", rsql(f"WITH {pred_cte()} SELECT {_WITHIN} FROM pred", "within_5 within_10 within_15"))
def evl7(spark, d):
    return rounded(E.within_points(predictions(spark, d, "y", "yhat")))


def _segment_sql(seg: str, support: int) -> str:
    return rsql(
        f"WITH {pred_cte()}, cells AS (SELECT {seg}, t, p, count(*) AS n FROM pred GROUP BY 1, 2, 3), {metric_ctes('cells', [seg])}, "
        f"g AS (SELECT {seg}, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, 1 - avg((yhat - y) * (yhat - y)) / var_pop(y) AS r2, {_WITHIN} FROM pred GROUP BY 1) "
        f"SELECT m.*, g.* EXCLUDE ({seg}) FROM m JOIN g USING ({seg}) WHERE m.n >= {support}",
        METRIC_NAMES + " mae rmse r2 within_5 within_10 within_15")


@query("evl8_segment_metrics", _segment_sql("seg", 30))
def evl8(spark, d):
    return rounded(E.segment_metrics(predictions(spark, d), "seg", "y", "yhat"))


@query("evl8_cohort_metrics", _segment_sql("cohort", 100))
def evl8_cohort(spark, d):
    return rounded(E.segment_metrics(predictions(spark, d), "cohort", "y", "yhat", min_support=100))


@query("evl8_fine_segments", _segment_sql("part", 30))
def evl8_fine(spark, d):
    return rounded(E.segment_metrics(predictions(spark, d), "part", "y", "yhat"))


_CONF = f"conf AS (SELECT *, {confidence_sql('(yhat + part / 1000.0::DOUBLE)')} AS c FROM pred)"
_EDGES = "e AS (SELECT quantile_cont(c, 0.25) AS e1, quantile_cont(c, 0.5) AS e2, quantile_cont(c, 0.75) AS e3 FROM conf)"


def _with_conf(spark, d):
    df = predictions(spark, d)
    return df.withColumn("c", S.confidence_proxy(F.col("yhat") + F.col("part") / 1000.0))


@query("evl9_confidence_bins", rsql(
    f"WITH {pred_cte()}, {_CONF}, {_EDGES}, b AS (SELECT conf.*, CAST(c >= e1 AS INT) + CAST(c >= e2 AS INT) + CAST(c >= e3 AS INT) AS bin FROM conf, e), "
    f"cells AS (SELECT bin, t, p, count(*) AS n FROM b GROUP BY 1, 2, 3), {metric_ctes('cells', ['bin'])}, r AS (SELECT bin, min(c) AS low, max(c) AS high FROM b GROUP BY 1) "
    "SELECT CAST(m.bin + 1 AS INT) AS quantile, n, low, high, qwk, accuracy FROM m JOIN r USING (bin) WHERE n >= 50", "low high qwk accuracy"))
def evl9(spark, d):
    return rounded(E.confidence_bins(_with_conf(spark, d), "c"))


@query("evl9_monotone_confidence", f"WITH {pred_cte()}, {_CONF}, {_EDGES}, b AS (SELECT conf.*, CAST(c >= e1 AS INT) + CAST(c >= e2 AS INT) + CAST(c >= e3 AS INT) AS bin FROM conf, e), "
       f"cells AS (SELECT bin, t, p, count(*) AS n FROM b GROUP BY 1, 2, 3), {metric_ctes('cells', ['bin'])}, l AS (SELECT qwk, lag(qwk) OVER (ORDER BY bin) AS before FROM m WHERE n >= 50) "
       "SELECT bool_and(before IS NULL OR qwk >= before) AS monotone, CAST(count(*) AS INT) AS bins FROM l")
def evl9_monotone(spark, d):
    return E.is_monotone(E.confidence_bins(_with_conf(spark, d), "c"))


_PROB = "least(greatest((CAST(doc_id % 97 AS DOUBLE) / 96.0::DOUBLE + quality) / 2.0::DOUBLE, 0.0), 1.0)"


@query("evl10_reliability", rsql(
    f"WITH s AS (SELECT quality, {_PROB} AS pr FROM labels JOIN documents USING (doc_id)), b AS (SELECT *, {' + '.join(f'CAST(pr >= {i * 0.1!r}::DOUBLE AS INT)' for i in range(1, 10))} AS bin FROM s) "
    "SELECT bin, count(*) AS n, avg(pr) AS mean_pred, avg(quality) AS observed, (SELECT avg((pr - quality) * (pr - quality)) FROM s) AS brier FROM b GROUP BY 1", "mean_pred observed brier"))
def evl10(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id")
    df = joined.selectExpr("quality", "least(greatest((double(doc_id % 97) / 96.0D + quality) / 2.0D, 0.0D), 1.0D) AS pr")
    return rounded(E.reliability(df, "quality", "pr"))


_DEC = f"e AS (SELECT {', '.join(f'quantile_cont(z, {k / 10}::DOUBLE) AS e{k}' for k in range(1, 10))} FROM z)"
_DECILES = (f"WITH {pred_cte()}, z AS (SELECT y, yhat + part / 5000.0::DOUBLE AS z FROM pred), {_DEC}, b AS (SELECT y, z, {' + '.join(f'CAST(z >= e{k} AS INT)' for k in range(1, 10))} AS bin FROM z, e), "
            "r AS (SELECT bin, count(*) AS n, avg(z) AS mean_pred, avg(y) AS mean_obs FROM b GROUP BY 1 HAVING count(*) >= 5)")


def _reliability_rows(spark, d):
    return E.score_reliability(predictions(spark, d).withColumn("z", F.col("yhat") + F.col("part") / 5000.0), "y", "z")


@query("evl11_score_reliability", rsql(f"{_DECILES} SELECT * FROM r", "mean_pred mean_obs"))
def evl11(spark, d):
    return rounded(_reliability_rows(spark, d))


@query("evl11_calibration_line", rsql(f"{_DECILES} SELECT regr_slope(mean_obs, mean_pred) AS slope, regr_intercept(mean_obs, mean_pred) AS intercept, count(*) AS bins_used FROM r", "slope intercept"))
def evl11_line(spark, d):
    return rounded(E.calibration_line(_reliability_rows(spark, d)))


@query("evl12_error_structure", rsql(
    f"WITH {pred_cte()}, c AS (SELECT count(*) AS n, count(*) FILTER (t = p) AS correct, count(*) FILTER (abs(t - p) = 1) AS off_by_1, count(*) FILTER (abs(t - p) = 2) AS off_by_2, "
    "count(*) FILTER (abs(t - p) >= 3) AS off_by_3_plus, count(*) FILTER (p < t) AS predicted_better, count(*) FILTER (p > t) AS predicted_worse FROM pred) "
    "SELECT *, predicted_worse::DOUBLE / greatest(predicted_better, 1) AS conservative_bias_ratio FROM c", "conservative_bias_ratio"))
def evl12(spark, d):
    return rounded(E.error_structure(predictions(spark, d, "t", "p")))


@query("evl13_tail_recall", rsql(
    f"WITH {pred_cte()} SELECT count(*) FILTER (t >= 4 AND p >= 4)::DOUBLE / greatest(count(*) FILTER (t >= 4), 1) AS tail_recall, "
    + ", ".join(f"count(*) FILTER (t = {k} AND p = {k})::DOUBLE / greatest(count(*) FILTER (t = {k}), 1) AS recall_{C.BANDS[k]}" for k in (4, 5, 6)) + " FROM pred",
    "tail_recall recall_E recall_F recall_G"))
def evl13(spark, d):
    return rounded(E.tail_recall(predictions(spark, d, "t", "p")))


@query("evl14_config_deltas", rsql(
    f"WITH {pred_cte()}, cells AS (SELECT seg, t, p, count(*) AS n FROM pred GROUP BY 1, 2, 3), {metric_ctes('cells', ['seg'])}, b AS (SELECT qwk AS bq, accuracy AS ba FROM m WHERE seg = 'A') "
    "SELECT seg, qwk, accuracy, qwk - bq AS qwk_delta, accuracy - ba AS accuracy_delta FROM m, b", "qwk accuracy qwk_delta accuracy_delta"))
def evl14(spark, d):
    return rounded(E.config_deltas(E.classification_metrics(_cells(spark, d, "seg"), ["seg"]), "seg", "A", ["qwk", "accuracy"]))


@query("evl15_seed_stability", rsql(
    f"WITH {pred_cte()}, s AS (SELECT part % 3 AS seed, t, p FROM pred), cells AS (SELECT seed, t, p, count(*) AS n FROM s GROUP BY 1, 2, 3), {metric_ctes('cells', ['seed'])} "
    "SELECT 'champion' AS config, count(*) AS folds, avg(qwk) AS qwk_mean, stddev_samp(qwk) AS qwk_std, min(qwk) AS qwk_min, max(qwk) AS qwk_max FROM m", "qwk_mean qwk_std qwk_min qwk_max"))
def evl15(spark, d):
    rows = predictions(spark, d).withColumn("seed", F.col("part") % 3)
    per_seed = E.classification_metrics(E.confusion_cells(rows, by=["seed"]), ["seed"]).withColumn("config", F.lit("champion"))
    span = per_seed.groupBy("config").agg(F.min("qwk").alias("qwk_min"), F.max("qwk").alias("qwk_max"))
    return rounded(fold_aggregate(per_seed, "config", ["qwk"]).join(span, "config"))


# --- bootstrap ------------------------------------------------------------------------------------

REPLICATES = 1000


def poisson_sql(cells: str, keys: list[str], seed: int, replicates: int) -> str:
    """CTEs drawing one Poisson count ``w`` per cell and replicate."""
    k = ["replicate", *keys]
    u, r, a = (uniform_sql(f"{seed}|{tag}", *k) for tag in "ura")
    return f"""drawn AS (SELECT c.*, g.replicate FROM {cells} c CROSS JOIN (SELECT CAST(range AS INT) AS replicate FROM range(1, {replicates + 1})) g),
 uni AS (SELECT *, {u} AS u, sqrt(-2.0::DOUBLE * ln({r})) * cos(6.283185307179586::DOUBLE * {a}) AS z FROM drawn),
 cdf AS (SELECT n, k, sum(exp(-n::DOUBLE + k * ln(n::DOUBLE) - lgamma(k + 1.0))) OVER (PARTITION BY n ORDER BY k) AS cdf
  FROM (SELECT DISTINCT n FROM {cells} WHERE n < 32) CROSS JOIN (SELECT range AS k FROM range(0, 128))),
 low AS (SELECT {', '.join(k)}, count(*) AS w FROM uni JOIN cdf ON cdf.n = uni.n AND cdf.cdf < uni.u GROUP BY {', '.join(k)}),
 weighted AS (SELECT uni.*, CASE WHEN n < 32 THEN coalesce(w, 0) ELSE CAST(greatest(floor(n + sqrt(n::DOUBLE) * z + (z * z - 1) / 6 + 0.5), 0) AS BIGINT) END AS wt
  FROM uni LEFT JOIN low USING ({', '.join(k)}))"""


_BOOT = f"WITH {pred_cte()}, {CELLS}, {poisson_sql('cells', ['t', 'p'], 42, REPLICATES)}"
_CI = "avg(v) AS mean, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high, quantile_cont(v, 0.975) - quantile_cont(v, 0.025) AS ci_width"


@query("bst1_per_class_f1_interval", rsql(
    f"{_BOOT}, {metric_ctes('weighted', ['replicate'], 'wt')}, b(i, b) AS (VALUES {BAND_VALUES}), v AS (SELECT b.b AS band, CASE WHEN nt + np > 0 THEN 2 * nd / (nt + np) ELSE 0 END AS v FROM cls JOIN b ON b.i = cls.k) "
    f"SELECT band, {_CI} FROM v GROUP BY 1", "mean ci_low ci_high ci_width"))
def bst1(spark, d):
    return rounded(B.per_class_f1_interval(predictions(spark, d, "t", "p"), replicates=REPLICATES))


_QWK_CI = f"{_BOOT}, {metric_ctes('weighted', ['replicate'], 'wt')}, v AS (SELECT qwk AS v FROM m)"


@query("bst2_kappa_interval", rsql(f"{_QWK_CI} SELECT {_CI} FROM v", "mean ci_low ci_high ci_width"))
def bst2(spark, d):
    return rounded(B.kappa_interval(predictions(spark, d, "t", "p"), replicates=REPLICATES))


@query("bst2_score_intervals", rsql(
    f"WITH {pred_cte()}, cells AS (SELECT y, yhat, count(*) AS n FROM pred GROUP BY 1, 2), {poisson_sql('cells', ['y', 'yhat'], 42, REPLICATES)}, "
    "s AS (SELECT replicate, sum(wt * (yhat - y) * (yhat - y)) AS res, sum(wt) AS n, sum(wt * y) AS sy, sum(wt * y * y) AS syy FROM weighted GROUP BY 1), "
    "v AS (SELECT 'r2' AS metric, 1 - res / (syy - sy * sy / n) AS v FROM s UNION ALL SELECT 'rmse', sqrt(res / n) FROM s) "
    f"SELECT metric, {_CI} FROM v GROUP BY 1", "mean ci_low ci_high ci_width"))
def bst2_scores(spark, d):
    return rounded(B.score_intervals(predictions(spark, d, "y", "yhat"), replicates=REPLICATES))


@query("bst3_next_best", rsql(
    f"{_QWK_CI}, ci AS (SELECT {_CI} FROM v), r AS (SELECT seg, t, p FROM pred), rc AS (SELECT seg, t, p, count(*) AS n FROM r GROUP BY 1, 2, 3), "
    + metric_ctes("rc", ["seg"]).replace("cc AS", "cc2 AS").replace("FROM cc ", "FROM cc2 ").replace("LEFT JOIN cc ON", "LEFT JOIN cc2 ON").replace("cc.seg", "cc2.seg")
    .replace("tot AS", "tot2 AS").replace("tot.", "tot2.").replace("FROM tot)", "FROM tot2)").replace("FROM tot ", "FROM tot2 ")
    .replace("kl AS", "kl2 AS").replace("kl.", "kl2.").replace("FROM kl ", "FROM kl2 ").replace("cls AS", "cls2 AS").replace("FROM cls ", "FROM cls2 ").replace("JOIN cls ", "JOIN cls2 ")
    .replace("ex AS", "ex2 AS").replace("JOIN ex ", "JOIN ex2 ").replace("ex.seg", "ex2.seg").replace("pc AS", "pc2 AS").replace("JOIN pc ", "JOIN pc2 ").replace("pc.seg", "pc2.seg").replace("\n m AS", "\n m2 AS")
    + ", best AS (SELECT seg, qwk FROM m2 ORDER BY qwk DESC, seg DESC LIMIT 1) SELECT seg AS next_best, qwk AS next_best_value, ci_low, qwk < ci_low AS below_lower_bound FROM best, ci",
    "next_best_value ci_low"))
def bst3(spark, d):
    rivals = E.classification_metrics(_cells(spark, d, "seg"), ["seg"]).select(F.col("seg").alias("name"), "qwk")
    return rounded(B.decide_next_best(B.kappa_interval(predictions(spark, d, "t", "p"), replicates=REPLICATES), rivals))

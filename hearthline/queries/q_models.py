"""Feature preparation, models, tuning and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline import config as C
from hearthline.functions import scalars as S
from hearthline.models import estimators as M, explain, prep, tuning
from hearthline.models.histogram_boost import Settings, binned_rows, feature_edges, fit_boosted
from hearthline.models.ordinal import fit_ordinal
from hearthline.models.routed import fit_per_cohort, fit_routed, predict_per_cohort
from hearthline.operators import splits as L
from hearthline.operators.roles import model_matrix
from hearthline.operators.evaluation import classification_metrics, confusion_cells, regression_metrics
from hearthline.plans import featuring, scoring
from hearthline.queries.q_clean import split_steps_sql
from hearthline.queries.q_scalars import AGE_SQL, PROBS_CTE, WALL_SQL, era_sql, probs
from hearthline.queries.registry import query, rounded, rsql
from hearthline.queries.roles import band_sql, cert_cte, certificates, table, uniform_sql
from hearthline.session import scratch_path, staged
from hearthline.sources import model_store

CUT = "2000-06-30"
FEATURES = ["TOTAL_FLOOR_AREA", "NUMBER_HABITABLE_ROOMS", "MULTI_GLAZE_PROPORTION", "LOFT_INSULATION_MM", "PROPERTY_TYPE", "BUILT_FORM", "ROOF_DESCRIPTION"]

# --- preparation ----------------------------------------------------------------------------------

_GROUP_COLS = ["TOTAL_FLOOR_AREA", "REPORT_TYPE", "PROPERTY_TYPE", "BUILT_FORM", "ROOF_DESCRIPTION", "ADDRESS1"]


@query("mlp1_column_groups", f"WITH {cert_cte()} SELECT 'TOTAL_FLOOR_AREA' AS \"column\", 'numeric' AS \"group\", NULL AS levels UNION ALL SELECT 'REPORT_TYPE', 'numeric', NULL "
       + " ".join(f"UNION ALL SELECT '{c}', CASE WHEN count(DISTINCT {c}) <= 25 THEN 'low_card' ELSE 'high_card' END, count(DISTINCT {c}) FROM cert" for c in _GROUP_COLS[2:]))
def mlp1(spark, d):
    return prep.column_groups(certificates(spark, d, *_GROUP_COLS))


_TRAIN_SQL = f"INSPECTION_DATE <= DATE '{CUT}'"


def _is_train():
    return F.col("INSPECTION_DATE") <= F.lit(CUT).cast("date")


@query("mlp2_impute_and_scale", rsql(
    f"WITH {cert_cte()}, m AS (SELECT quantile_cont(TOTAL_FLOOR_AREA, 0.5::DOUBLE) AS a, quantile_cont(NUMBER_HEATED_ROOMS, 0.5::DOUBLE) AS b FROM cert WHERE {_TRAIN_SQL}), "
    f"q AS (SELECT quantile_cont(coalesce(TOTAL_FLOOR_AREA, a), 0.75::DOUBLE) - quantile_cont(coalesce(TOTAL_FLOOR_AREA, a), 0.25::DOUBLE) AS ra, "
    f"quantile_cont(coalesce(NUMBER_HEATED_ROOMS, b), 0.75::DOUBLE) - quantile_cont(coalesce(NUMBER_HEATED_ROOMS, b), 0.25::DOUBLE) AS rb FROM cert, m WHERE {_TRAIN_SQL}) "
    "SELECT LMK_KEY, (coalesce(TOTAL_FLOOR_AREA, a) - a) / ra AS TOTAL_FLOOR_AREA, (coalesce(NUMBER_HEATED_ROOMS, b) - b) / rb AS NUMBER_HEATED_ROOMS FROM cert, m, q",
    "TOTAL_FLOOR_AREA NUMBER_HEATED_ROOMS"))
def mlp2(spark, d):
    df = certificates(spark, d, "LMK_KEY", "INSPECTION_DATE", "TOTAL_FLOOR_AREA", "NUMBER_HEATED_ROOMS")
    return rounded(prep.impute_and_scale(df, _is_train(), ["TOTAL_FLOOR_AREA", "NUMBER_HEATED_ROOMS"]).drop("INSPECTION_DATE"))


@query("mlp3_one_hot", f"""WITH {cert_cte()}, t AS (SELECT BUILT_FORM AS v, count(*) AS n FROM cert WHERE {_TRAIN_SQL} AND BUILT_FORM IS NOT NULL GROUP BY 1),
 mo AS (SELECT v AS mv FROM t ORDER BY n DESC, v LIMIT 1), f AS (SELECT LMK_KEY, coalesce(BUILT_FORM, mv) AS v FROM cert, mo)
 SELECT LMK_KEY, CAST(v = 'Detached' AS INT) AS "BUILT_FORM=Detached", CAST(v = 'End-Terrace' AS INT) AS "BUILT_FORM=End-Terrace", CAST(v = 'Mid-Terrace' AS INT) AS "BUILT_FORM=Mid-Terrace",
 CAST(v = 'Semi-Detached' AS INT) AS "BUILT_FORM=Semi-Detached" FROM f""")
def mlp3(spark, d):
    df = certificates(spark, d, "LMK_KEY", "INSPECTION_DATE", "BUILT_FORM")
    return prep.fit_levels(df, _is_train(), ["BUILT_FORM"]).one_hot(df).drop("INSPECTION_DATE", "BUILT_FORM")


@query("mlp4_ordinal_encode", f"""WITH {cert_cte()}, t AS (SELECT ROOF_DESCRIPTION AS v, count(*) AS n FROM cert WHERE {_TRAIN_SQL} AND ROOF_DESCRIPTION IS NOT NULL GROUP BY 1),
 mo AS (SELECT v AS mv FROM t ORDER BY n DESC, v LIMIT 1), c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM t)
 SELECT LMK_KEY, CAST(coalesce(code, -1) AS INT) AS roof_code FROM cert CROSS JOIN mo LEFT JOIN c ON c.v = coalesce(ROOF_DESCRIPTION, mv)""")
def mlp4(spark, d):
    df = certificates(spark, d, "LMK_KEY", "INSPECTION_DATE", "ROOF_DESCRIPTION")
    return prep.ordinal_encode(df, _is_train(), "ROOF_DESCRIPTION", "roof_code").select("LMK_KEY", "roof_code")


# --- shared fits ----------------------------------------------------------------------------------


def _frame(spark, d):
    """Identity, labels, split, prepared inputs and class codes of every certificate."""
    needed = dict.fromkeys([*scoring.IDENTITY, C.COHORT, C.SCORE, C.TARGET, *FEATURES])
    # rating and depth are worked out once, in a step small enough to be compiled, not again on every side of the split
    eng = staged(featuring.engineer(certificates(spark, d)).select(*needed), "inputs").where(F.col(C.TARGET).isin(*C.BANDS))
    frame = scoring.training_frame(eng, FEATURES, cutoff=CUT)
    return frame.withColumns({"label": S.encode_band(F.col("label_band")).cast("double"), "t": S.encode_band(F.col("label_band"))})


def _prepared(spark, d):
    """(rows with a feature vector, frame, preparation), staged because every fit reads them."""
    frame = staged(_frame(spark, d), "frame")
    fitted = prep.preparation(FEATURES, scale=False).fit(frame.where("split = 'train'"))
    rows = fitted.transform(frame.where("split <> 'discard'"))
    weighted = L.balanced_weight(rows.select("LMK_KEY", "REPORT_TYPE", "INSPECTION_DATE", "split", "label", "label_score", "t", "features"), "label")
    return staged(weighted.repartition(spark.sparkContext.defaultParallelism, "LMK_KEY"), "prepared"), frame, fitted


def _sides(spark, d):
    rows, _, _ = _prepared(spark, d)
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def _judged(scored, pred="prediction"):
    return rounded(classification_metrics(confusion_cells(scored.withColumn("p", F.col(pred).cast("int")))))


_KEPT_CTE = (f"{cert_cte().replace('cert AS', 'all_certs AS')}, cert AS (SELECT * FROM all_certs WHERE CURRENT_ENERGY_RATING IN {C.BANDS}), "
             f"{split_steps_sql(CUT)}, k AS (SELECT cert.*, sp.split FROM cert JOIN sp USING (LMK_KEY))")


@query("mlp6_preparation", rsql(
    f"""WITH {_KEPT_CTE}, f AS (SELECT LMK_KEY, split, TOTAL_FLOOR_AREA AS a, coalesce(BUILT_FORM, '{C.MISSING_LEVEL}') AS form, coalesce(ROOF_DESCRIPTION, '{C.MISSING_LEVEL}') AS roof FROM k),
 tr AS (SELECT * FROM f WHERE split = 'train'), m AS (SELECT quantile_cont(a, 0.5::DOUBLE) AS m FROM tr),
 q AS (SELECT quantile_cont(coalesce(a, m), 0.75::DOUBLE) - quantile_cont(coalesce(a, m), 0.25::DOUBLE) AS q FROM tr, m),
 l AS (SELECT form, count(*) AS n FROM tr GROUP BY 1), s AS (SELECT form, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY form) ELSE (SELECT count(*) + 1 FROM l WHERE n >= 20) END AS slot FROM l),
 c AS (SELECT roof, row_number() OVER (ORDER BY roof) - 1 AS code FROM (SELECT DISTINCT roof FROM tr))
 SELECT LMK_KEY, split, (coalesce(a, m) - m) / q AS area, CAST(coalesce(slot, 0) AS INT) AS form_slot, CAST(coalesce(code, -1) AS DOUBLE) AS roof_code
 FROM f CROSS JOIN m CROSS JOIN q LEFT JOIN s USING (form) LEFT JOIN c USING (roof)""", "area roof_code"))
def mlp6(spark, d):
    frame = staged(_frame(spark, d), "frame")
    done = prep.preparation(FEATURES).fit(frame.where("split = 'train'")).transform(frame)
    hot = [c for c in done.columns if c.startswith("BUILT_FORM__")]
    slot = F.array_position(F.array(*[F.col(c) for c in hot]), F.lit(1.0)).cast("int")
    return rounded(done.select("LMK_KEY", "split", F.col("TOTAL_FLOOR_AREA__num").alias("area"), slot.alias("form_slot"), F.col("ROOF_DESCRIPTION__code").alias("roof_code")))


# --- baselines ------------------------------------------------------------------------------------

_CODE_CTE = f"{cert_cte()}, k AS (SELECT LMK_KEY, CURRENT_ENERGY_RATING AS b, {_TRAIN_SQL} AS train FROM cert WHERE CURRENT_ENERGY_RATING IN {C.BANDS})"


@query("mdl1_most_frequent", f"WITH {_CODE_CTE} SELECT LMK_KEY, (SELECT b FROM k WHERE train GROUP BY b ORDER BY count(*) DESC, b LIMIT 1) AS prediction FROM k WHERE NOT train")
def mdl1_most(spark, d):
    df = certificates(spark, d, "LMK_KEY", C.TARGET, C.DATE).where(F.col(C.TARGET).isin(*C.BANDS))
    return M.most_frequent(df.where(~_is_train()), df.where(_is_train()), C.TARGET).select("LMK_KEY", "prediction")


@query("mdl1_stratified_random", f"WITH {_CODE_CTE}, s AS (SELECT v.b, v.i, count(k.b) AS n FROM (VALUES {', '.join(f'({b!r}, {i})' for i, b in enumerate(C.BANDS))}) v(b, i) LEFT JOIN (SELECT * FROM k WHERE train) k ON k.b = v.b GROUP BY 1, 2), "
       "c AS (SELECT b, i, sum(n) OVER (ORDER BY i) AS upto, sum(n) OVER () AS total FROM s), "
       f"r AS (SELECT LMK_KEY, {uniform_sql(42, 'LMK_KEY')} AS u FROM k WHERE NOT train) SELECT LMK_KEY, coalesce(min_by(b, i) FILTER (u * total < upto), 'G') AS prediction FROM r, c GROUP BY 1")
def mdl1_random(spark, d):
    df = certificates(spark, d, "LMK_KEY", C.TARGET, C.DATE).where(F.col(C.TARGET).isin(*C.BANDS))
    out = M.stratified_random(df.where(~_is_train()), df.where(_is_train()), C.TARGET, "LMK_KEY", list(C.BANDS))
    return out.select("LMK_KEY", "prediction")


@query("mdl2_logistic")
def mdl2(spark, d):
    train, test = _sides(spark, d)
    return _judged(M.logistic().fit(train).transform(test))


@query("mdl2_document_quality")
def mdl2_documents(spark, d):
    """Quality of documents from their length, language and share of words; learnt on four folds of five, judged on the fifth."""
    text = F.col("text")
    docs = table(spark, d, "documents").select(
        "doc_id", "n_chars", "lang", F.size(F.split(text, r"\s+")).alias("n_words"), F.size(F.split(text, "\n")).alias("n_lines"),
        F.length(F.regexp_replace(text, r"[^A-Za-z]", "")).alias("n_letters"))
    cols = ["n_chars", "n_words", "n_lines", "n_letters", "lang"]
    rows = prep.ready(table(spark, d, "labels").join(docs, "doc_id").withColumn("label", F.col("quality").cast("double")), cols)
    rows = staged(rows.select("doc_id", "label", *cols).withColumn("fold", L.group_fold("doc_id", "doc_id", 5)), "documents")
    rows = prep.preparation(cols).fit(rows.where("fold <> 0")).transform(rows)
    train = L.balanced_weight(rows.where("fold <> 0").select("doc_id", "label", "features"), "label")
    scored = M.logistic().fit(train).transform(rows.where("fold = 0").select("doc_id", "label", "features"))
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("mdl3_random_forest")
def mdl3(spark, d):
    train, test = _sides(spark, d)
    return _judged(M.random_forest().fit(train).transform(test))


@query("mdl4_shallow_tree")
def mdl4(spark, d):
    train, test = _sides(spark, d)
    return _judged(M.shallow_tree().fit(train).transform(test))


@query("mdl5_lookup_heuristic", f"""WITH {cert_cte()}, r AS (SELECT LMK_KEY, {era_sql(AGE_SQL, C.ERA_RIGHT_CLOSED, True, 'nan')} AS era, {WALL_SQL} AS wall, CURRENT_ENERGY_EFFICIENCY AS score, {_TRAIN_SQL} AS train FROM cert),
 m AS (SELECT era, wall, quantile_cont(score, 0.5) AS med FROM r WHERE train GROUP BY ALL), g AS (SELECT quantile_cont(score, 0.5) AS med FROM r WHERE train),
 o AS (SELECT LMK_KEY, CAST(coalesce(m.med, g.med) AS DOUBLE) AS predicted_score FROM r LEFT JOIN m USING (era, wall), g WHERE NOT train)
 SELECT LMK_KEY, predicted_score, {band_sql('predicted_score')} AS predicted_band FROM o""")
def mdl5(spark, d):
    df = featuring.add_date_parts(certificates(spark, d, "LMK_KEY", C.DATE, C.SCORE, "CONSTRUCTION_AGE_BAND", "WALLS_DESCRIPTION"))
    scored = M.lookup_heuristic(df, _is_train())
    return scored.where(~_is_train()).select("LMK_KEY", "predicted_score", "predicted_band")


# --- boosted and routed models --------------------------------------------------------------------


@query("mdl6_score_regressor")
def mdl6(spark, d):
    train, test = _sides(spark, d)
    scored = M.score_regressor().fit(train).transform(test)
    return rounded(regression_metrics(scored, "label_score", "prediction"))


def _matrix(spark, d):
    """The whole feature matrix with its labels and split, and its numeric columns; text columns are codes of their levels, nulls stay null."""
    raw = certificates(spark, d).where(F.col(C.TARGET).isin(*C.BANDS))
    rows = model_matrix(featuring.engineer(raw), keep=["LMK_KEY", C.DATE], drop_raw_descriptions=True)
    texts = [f.name for f in rows.schema if f.dataType.simpleString() == "string" and f.name not in ("LMK_KEY", "label_band")]
    codes = {c: F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(c), F.lit(1 << 20)).cast("double")) for c in texts}
    rows = rows.withColumns(codes).withColumn("split", F.when(_is_train(), "train").otherwise("test"))
    skip = {"LMK_KEY", C.DATE, "label_band", "label_score", "split"}
    features = [f.name for f in rows.schema if f.name not in skip and f.dataType.simpleString() in ("double", "int", "bigint")]
    return staged(rows, "matrix"), features


@query("mdl6_histogram_regressor")
def mdl6_histogram(spark, d):
    """Leaf-wise boosted trees with native nulls on the whole feature matrix, judged on later certificates."""
    rows, features = _matrix(spark, d)
    model = fit_boosted(rows.where("split = 'train'"), features, "label_score", settings=Settings(rounds=20, leaves=31, rate=0.3))
    scored = model.predict(rows.where("split = 'test'"), ["label_score"])
    return rounded(regression_metrics(scored, "label_score", "prediction"))


@query("mdl7_joint_boosted_classifier")
def mdl7_joint(spark, d):
    """All bands in one round of boosting: one tree per band and round, softmax of their scores."""
    rows, features = _matrix(spark, d)
    rows = rows.withColumn("label", S.encode_band(F.col("label_band")).cast("double"))
    model = fit_boosted(rows.where("split = 'train'"), features, "label", classes=len(C.BANDS))
    scored = model.predict(rows.where("split = 'test'").withColumn("t", F.col("label").cast("int")), ["t"], "probs")
    return _judged(scored.withColumn("p", F.array_position("probs", F.array_max("probs")) - 1), "p")


@query("mdl7_boosted_classifier")
def mdl7(spark, d):
    train, test = _sides(spark, d)
    return _judged(M.boosted_classifier(2, maxDepth=3).fit(train).transform(test))


@query("mdl8_early_stopping")
def mdl8(spark, d):
    train, test = _sides(spark, d)
    model = M.fit_early_stopped(L.latest_slice(train, C.DATE), trees=8, floor=4, maxDepth=4)
    scored = model.transform(test)
    return rounded(regression_metrics(scored, "label_score", "prediction").withColumn("trees", F.lit(model.getNumTrees)))


_HELD_SQL = f"""{cert_cte()}, t AS (SELECT CAST(INSPECTION_DATE AS DATE) AS day, CURRENT_ENERGY_EFFICIENCY AS y, {_TRAIN_SQL} AS train FROM cert WHERE CURRENT_ENERGY_RATING IN {C.BANDS}),
 r AS (SELECT *, percent_rank() OVER (PARTITION BY coalesce(train, FALSE) ORDER BY day) > 0.85::DOUBLE AS late FROM t),
 m AS (SELECT avg(y)::DOUBLE AS m FROM r WHERE train AND NOT late)"""


@query("mdl8_held_out_stopping", rsql(
    f"WITH {_HELD_SQL} SELECT count(*) FILTER (train AND NOT late) AS learnt, count(*) FILTER (train AND late) AS held, count(*) FILTER (train IS NOT TRUE) AS tested, "
    "avg((y - m) * (y - m)) FILTER (train IS NOT TRUE) AS mean_error, TRUE AS beats_mean, TRUE AS best_round_kept FROM r, m", "mean_error"))
def mdl8_held_out(spark, d):
    """The newest slice of the training rows stops the boosting; the kept rounds are judged on later certificates beside the mean of the rows learnt from."""
    rows, features = _matrix(spark, d)
    train = L.latest_slice(rows.where("split = 'train'"), C.DATE)
    model = fit_boosted(train, features, "label_score", settings=Settings(rounds=12, leaves=15, rate=0.5, patience=3), held="is_validation")
    scored = model.predict(rows.where("split = 'test'"), ["label_score"])
    sides = train.agg(F.count_if(~F.col("is_validation")).alias("learnt"), F.count_if("is_validation").alias("held"))
    y, mean = F.col("label_score"), F.lit(float(model.base[0]))
    error, constant = F.avg((y - F.col("prediction")) ** 2), F.avg((y - mean) ** 2)
    judged = scored.agg(F.count(F.lit(1)).alias("tested"), constant.alias("mean_error"), (error < constant).alias("beats_mean"))
    kept = model.losses[len(model.trees)] == min(model.losses)
    return rounded(judged.withColumns({c: sides.select(c).scalar() for c in sides.columns}).withColumn("best_round_kept", F.lit(kept)))


def _routed(rows):
    return fit_routed(rows.where("split = 'train'"), trees=8, maxDepth=4, min_special=100)


@query("mdl9_routed_regressor")
def mdl9(spark, d):
    rows, _, _ = _prepared(spark, d)
    scored = _routed(rows).predict_band(rows.where("split = 'test'"))
    return _judged(scored.withColumn("code", S.encode_band(F.col("predicted_band"))), "code")


@query("mdl10_per_cohort")
def mdl10(spark, d):
    train, test = _sides(spark, d)
    models = fit_per_cohort(train, [100, 101], trees=4, maxDepth=4, min_rows=100)
    scored = predict_per_cohort(test, models)
    return rounded(regression_metrics(scored, "label_score", "predicted_score", by=["REPORT_TYPE"]))


# --- probability tables ---------------------------------------------------------------------------

_P2 = [f"(v[{k + 1}] / s + v[{7 - k}] / s) / 2.0::DOUBLE" for k in range(7)]


@query("mdl11_soft_vote", f"WITH {PROBS_CTE}, q AS (SELECT o_orderkey, [{', '.join(_P2)}] AS m FROM p), z AS (SELECT o_orderkey, list_transform(m, lambda x: round(x, 12)) AS m FROM q) "
       "SELECT o_orderkey, CAST(list_position(m, list_max(m)) - 1 AS INT) AS cls FROM z")
def mdl11(spark, d):
    df = probs(spark, d)
    mean = S.mean_probability(F.col("probs"), F.reverse("probs"))
    return df.select("o_orderkey", S.argmax_class(F.transform(mean, lambda x: F.round(x, 12))).alias("cls"))


def _prob_rows(spark, d):
    df = probs(spark, d)
    return df.withColumn("t", S.expected_class(F.transform("probs", lambda x: F.round(x, 2))))


@query("mdl12_threshold_tuning")
def mdl12(spark, d):
    best, qwk = tuning.tune_thresholds(_prob_rows(spark, d), "probs", "t")
    rows = _prob_rows(spark, d)
    scored = rows.withColumn("p", S.threshold_class(S.cumulative(F.col("probs")), F.array(*[F.lit(b) for b in best])))
    return rounded(classification_metrics(confusion_cells(scored)).withColumn("tuned_qwk", F.lit(qwk)))


@query("mdl13_isotonic_calibration")
def mdl13(spark, d):
    train, test = _sides(spark, d)
    folds = L.stratified_folds(train, "label", "LMK_KEY", 3)
    parts = []
    for i in range(3):
        model = M.shallow_tree(4).fit(folds.where(F.col("fold") != i))
        parts.append(M.class_probabilities(model.transform(folds.where(F.col("fold") == i))).select("label", "probs"))
    maps = M.fit_isotonic(staged(parts[0].unionByName(parts[1]).unionByName(parts[2]), "out-of-fold"))
    scored = M.class_probabilities(M.shallow_tree(4).fit(train).transform(test))
    calibrated = M.apply_isotonic(scored, maps).withColumn("code", S.argmax_class(F.col("calibrated")))
    return _judged(calibrated, "code")


# --- runs -----------------------------------------------------------------------------------------


def _tree_config(depth: int = 4, min_rows: int = 1):
    def run(train, valid):
        scored = M.shallow_tree(int(depth), minInstancesPerNode=int(min_rows)).fit(train).transform(valid)
        return scored.withColumn("p", F.col("prediction").cast("int"))

    return run


def _folded(spark, d, k):
    train, _ = _sides(spark, d)
    return train.withColumn("fold", L.group_fold("LMK_KEY", "LMK_KEY", k))


@query("mdl14_parameter_search")
def mdl14(spark, d):
    draws = tuning.draw_parameters(spark, {"depth": (2, 5, "int"), "min_rows": (5, 50, "log")}, 2)
    return rounded(tuning.search(_folded(spark, d, 2), _tree_config, draws, k=2))


@query("mdl14_parzen_search")
def mdl14_parzen(spark, d):
    """Eight sequential trials of the histogram booster on three folds of the whole feature matrix."""
    rows, features = _matrix(spark, d)
    train = rows.where("split = 'train'").withColumn("t", S.encode_band(F.col("label_band"))).withColumn("fold", L.group_fold("LMK_KEY", "LMK_KEY", 3))
    edges = feature_edges(train, features, 64)
    train = binned_rows(train, features, edges, ["LMK_KEY", "label_score", "t", "fold"])

    def config(leaves, rate, l2):
        def run(fit, valid):
            model = fit_boosted(fit, features, "label_score", settings=Settings(rounds=2, leaves=leaves, rate=rate, l2=l2, bins=64), edges=edges)
            return model.predict(valid, ["t"]).withColumn("p", S.score_to_code(F.col("prediction")))

        return run

    return rounded(tuning.parzen_search(train, config, {"leaves": (3, 31, "log-int"), "rate": (0.1, 1.0, "log"), "l2": (0.1, 50.0, "log")}))


@query("mdl15_cross_validation")
def mdl15(spark, d):
    runs = tuning.cross_validate(_folded(spark, d, 3), {"depth-3": _tree_config(3), "depth-5": _tree_config(5)}, k=3)
    return rounded(tuning.summarise_folds(runs))


@query("mdl16_ablation")
def mdl16(spark, d):
    frame = staged(_frame(spark, d).where("split <> 'discard'"), "ablation")

    def run(columns, weighted):
        train = frame.where("split = 'train'")
        fitted = prep.preparation(columns, scale=False).fit(train)
        rows = fitted.transform(train)
        rows = L.balanced_weight(rows.select("label", "features"), "label") if weighted else rows
        model = M.shallow_tree(4)
        model = (model.setWeightCol("weight") if weighted else model).fit(rows)
        return model.transform(fitted.transform(frame.where("split = 'test'"))).withColumn("p", F.col("prediction").cast("int"))

    return rounded(tuning.ablate(
        {"all": {"columns": FEATURES, "weighted": False}, "no descriptions": {"columns": FEATURES[:-1], "weighted": False},
         "weighted": {"columns": FEATURES, "weighted": True}}, run))


@query("mdl17_batch_scoring")
def mdl17(spark, d):
    rows, frame, fitted = _prepared(spark, d)
    return scoring.predict_table(frame, fitted, _routed(rows), FEATURES)


_SIDES_SQL = "SELECT CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS split, count(*) AS n"


@query("mdl17_scored_contract", f"WITH {_KEPT_CTE} {_SIDES_SQL}, count(*) AS in_range, count(*) AS band_follows_score, count(*) AS correct_follows_bands, "
       "count(CURRENT_ENERGY_EFFICIENCY) AS errors FROM k GROUP BY 1")
def mdl17_contract(spark, d):
    """Every certificate is scored once, within 1-100, and the derived columns follow from score and truth."""
    scored = mdl17(spark, d)
    score, band = F.col("predicted_sap_score"), F.col("predicted_band")
    # the published score has two decimals, the band comes from the score before that
    follows = band.isin(*C.BANDS) & ((band == S.score_to_band(score - 0.005)) | (band == S.score_to_band(score + 0.005)))
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(score.between(1, 100)).alias("in_range"), F.count_if(follows).alias("band_follows_score"),
        F.count_if(F.col("band_correct") == (band == F.col("actual_band"))).alias("correct_follows_bands"),
        F.count_if(F.abs(F.abs(F.col("actual_sap_score") - score) - F.col("abs_score_error")) < 0.011).alias("errors"))


@query("mdl18_permutation_importance")
def mdl18(spark, d):
    rows, frame, fitted = _prepared(spark, d)
    model = _routed(rows)

    def score(rows):
        return model.predict_band(fitted.transform(rows)).withColumn("p", S.encode_band(F.col("predicted_band")))

    test = frame.where("split = 'test'").select("LMK_KEY", "REPORT_TYPE", "t", *FEATURES)
    return rounded(explain.permutation_importance(test, FEATURES, "LMK_KEY", score))


@query("mdl19_ordinal_decomposition")
def mdl19(spark, d):
    train, test = _sides(spark, d)
    heads = M.fit_exceedance(train)
    return _judged(M.predict_exceedance(test, heads), "predicted_code")


@query("mdl19_ordinal_shared_weights")
def mdl19_shared(spark, d):
    """One weight vector with K-1 thresholds on the prepared features, judged on later certificates."""
    train, test = _sides(spark, d)
    return _judged(fit_ordinal(L.latest_slice(train, C.DATE)).predict(test), "predicted_code")


@query("mdl19_monotone_exceedance", f"WITH {_KEPT_CTE} SELECT count(*) AS n, 0::BIGINT AS rises, TRUE AS beats_most_frequent FROM k WHERE split = 'test'")
def mdl19_monotone(spark, d):
    """P(class > k) falls with k on every row, and the kappa is above that of the most frequent class, which is 0."""
    train, test = _sides(spark, d)
    scored = staged(fit_ordinal(L.latest_slice(train, C.DATE)).predict(test), "exceedance")
    qwk = classification_metrics(confusion_cells(scored.withColumnsRenamed({"predicted_code": "p"})), metrics=["qwk"]).select("qwk").scalar()
    rises = F.exists(F.sequence(F.lit(1), F.size("exceed") - 1), lambda k: F.get("exceed", k) > F.get("exceed", k - 1))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(rises).alias("rises"), (qwk > 0.2).alias("beats_most_frequent"))


@query("cfx1_counterfactual_scores")
def cfx1(spark, d):
    rows, frame, fitted = _prepared(spark, d)
    base = frame.where("split = 'test'").select("LMK_KEY", "REPORT_TYPE", *FEATURES)
    kinds = {k: {"PROPERTY_TYPE": F.lit(k), "TOTAL_FLOOR_AREA": F.lit(90.0)} for k in ("House", "Flat", "Bungalow", "Maisonette")}
    scored = _routed(rows).predict_band(fitted.transform(explain.counterfactuals(base, kinds)))
    return rounded(scored.select("LMK_KEY", "variant", "predicted_score", "predicted_band"), 4)


@query("snk5_model_store", f"WITH {_KEPT_CTE} {_SIDES_SQL}, 0::BIGINT AS changed FROM k GROUP BY 1")
def snk5(spark, d):
    """A reloaded model scores every certificate as the one that was saved."""
    rows, frame, fitted = _prepared(spark, d)
    routed, path = _routed(rows), scratch_path(spark, "model")
    model_store.save_model(spark, path, fitted, routed, frame, FEATURES)
    loaded, model, contract = model_store.load_model(spark, path)
    before = scoring.predict_table(frame, fitted, routed, FEATURES).select("LMK_KEY", F.col("predicted_sap_score").alias("was"))
    after = scoring.predict_table(frame, loaded, model, list(contract)).join(before, "LMK_KEY", "left")
    same = F.col("was").eqNullSafe(F.col("predicted_sap_score"))
    return after.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("changed"))

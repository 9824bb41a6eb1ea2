"""Time the headline queries; prints one JSON line. Warm session, noop sink, median of the runs."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "evl4_weighted_kappas", "evl8_segment_metrics", "evl9_confidence_bins", "evl11_calibration_line", "evl12_error_structure",
    "bst1_per_class_f1_interval", "bst2_kappa_interval",
    "cln1_build_clean", "cln2_build_longitudinal", "log1_cleaning_log", "ded2_best_quality_per_key", "rep6_winsorise",
    "spl2_group_temporal_split", "spl3_stratified_folds", "win3_row_weights", "win4_quantile_bins",
    "eng1_engineer", "scl8_parse_cost", "scl4_document_flags",
    "agg1_measure_summary", "agg2_total_cost", "agg5_crosstab", "agg11_quartiles_by_group", "agg13_describe", "agg18_cardinalities",
    "agg24_spearman_complete", "agg25_cramers_v", "agg26_document_terms", "agg27_baskets",
    "jn1_of_kept_certificates", "jn4_lookup_with_fallback", "jn5_nearest_neighbours",
    "rec1_frequent_itemsets", "rec2_association_rules", "rec3_neighbour_recommendations",
    "clu3_mean_gower_distance", "clu4_silhouette", "clu5_separation_indices",
    "mlp2_impute_and_scale", "mlp4_ordinal_encode", "mdl6_score_regressor", "mdl12_threshold_tuning",
]


def main() -> None:
    from hearthline.queries import load_registry
    from hearthline.session import build_session

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_registry()
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    chosen = [n for n in HEADLINE if not sys.argv[1:] or any(part in n for part in sys.argv[1:])]
    for name in chosen:
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            registry[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()

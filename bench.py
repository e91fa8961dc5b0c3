"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "join_identity_left", "feat_uid_proxy", "hist_prior_count", "hist_seconds_since_previous", "hist_prior_numeric_stats", "hist_prior_nunique",
    "hist_causal_features", "ref_build", "ref_apply", "ref_merge", "sequence_number", "split_chronological",
    "validate_rows", "profile_table", "amount_by_label", "eval_pr_curve", "eval_average_precision", "eval_roc_auc",
    "eval_threshold", "eval_confusion", "eval_capacity", "blend_fit", "enc_frequency", "enc_rare_levels", "enc_vocabulary", "enc_median_scale",
    "train_logistic", "train_boosted", "score_models", "score_external_model", "batch_scoring",
    "derive_alerts", "alert_queue", "alert_apply_actions", "export_history_flat", "upsert_latest", "explain_reason",
]


#: Models that these queries apply to every row.
SCORED_PER_ROW = {"score_models": 2, "score_external_model": 1}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from checks import QUERIES

    keys = sys.argv[1:] or HEADLINE
    rows = spark.read.parquet(f"{folder}/events.parquet").count()  # starts the executors before timing
    times: dict[str, float] = {}
    per_row: dict[str, float] = {}  # milliseconds of the whole query per scored row and model
    for key in keys:
        started = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - started, 3)
        if key in SCORED_PER_ROW:
            per_row[key] = round(1000 * times[key] / rows / SCORED_PER_ROW[key], 5)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "ms_per_row": per_row, "sf": os.path.basename(folder).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

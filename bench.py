"""Time the registered queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs twice and the second time counts.  ``BENCH_QUERIES``
(comma-separated) limits the run to some queries.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from gleanmark import catalog

HEADLINE = (
    "quality_micro", "accuracy_macro", "match_counts", "entry_errors", "errors_by_text", "strict_vs_lenient",
    "evaluate_quality", "raw_quality", "rescore_counts", "unified_errors", "salvage_marked", "salvage_truncated",
    "validate_schema", "validation_rates", "clean_values", "dedup_items", "drop_labeled", "pair_disagreement",
    "format_and_content", "knn_outliers", "length_profile", "token_summary", "latest_runs", "leaderboard_f1",
    "backend_slice", "derive_method", "run_counters", "assemble_records", "render_prompts", "progress_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names.split(",") if names else HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

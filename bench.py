"""Time the headline queries; one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the tables and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogue import all_queries  # noqa: E402
from loomprep import build_session  # noqa: E402

HEADLINE = (
    "profile_numeric", "profile_categorical", "classify_columns", "unique_counts", "top_values_long_text",
    "correlation_matrix", "histogram_30", "boxplot_stats", "missing_profile", "fill_mean", "fill_median", "fill_mode",
    "fill_forward", "fill_backward", "interpolate_linear", "fill_bulk", "outliers_iqr", "outlier_report_iqr",
    "outlier_report_zscore", "outlier_totals", "remediate_bulk", "snapshot_columns", "undo_resolution", "recipe_replay",
    "csv_round_trip", "parquet_round_trip", "label_encode", "stratified_split", "ols_regression", "knn_regress",
    "classification_metrics", "regression_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("OFF")
    known = all_queries()
    # Start the JVM's compiler and the Python workers before the clock runs.
    for name in ("profile_categorical", "unique_counts", "knn_regress"):
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()

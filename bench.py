"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data (default /root/testdata/sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabulith import catalog  # noqa: E402
from tabulith.session import build_session, discard_scratch  # noqa: E402

HEADLINE = (
    "group_agg_sum", "group_agg_median", "multi_agg", "pivot_table", "describe_numeric", "describe_categorical", "kpis",
    "correlation_matrix", "percentile_table", "seasonality", "value_counts", "pareto", "moving_average", "ema", "trend",
    "percentile_rank_global", "clean_table", "profile_numeric", "profile_dataset", "smart_join_left", "smart_join_outer",
    "join_quality", "value_overlap", "detect_keys", "zscore_outliers", "iqr_outliers", "anomalies_combined_lines",
    "isolation_forest", "lof", "anderson_darling", "anova", "chi_square", "linear_regression", "tax_rate_inconsistency",
    "duplicate_amounts_orders", "expense_breakdown", "histogram", "insights",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    names = sys.argv[1:] or HEADLINE
    # start the JVM, the file reader and the Python workers before the clock runs
    catalog.QUERIES["group_agg_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(8).mapInPandas(lambda batches: batches, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        discard_scratch(spark)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

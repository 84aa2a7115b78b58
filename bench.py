"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Each query is run BENCH_RUNS times (default 1) after one warm-up query; the median counts.
"""

import importlib
import json
import os
import statistics
import sys
import time

from poolspark.session import build_session

HEADLINE = (
    "clean_master", "target_labels", "target_metadata", "measure_percentiles", "log_histogram", "strat_split",
    "init_random", "select_topk", "select_diverse", "qbc_diagnostics", "auc_by_group", "fit_score", "summary",
    "rank_table", "descriptor_quantiles", "descriptor_corr", "fingerprint", "knn_jaccard", "stream_clean",
    "comparison_report", "backtest", "init_diverse", "campaign_panel", "experiment_card", "committee_backtest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    queries["label_counts"](spark, sf_dir).collect()

    taken = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        taken[name] = round(statistics.median(times), 3)
        print(f"{name}: {taken[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_time", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()

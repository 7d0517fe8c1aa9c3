"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder with the tables (default /root/testdata/sf0.1),
BENCH_CPUS the cores of the local session (default 8). Each query runs twice
and builds all of its inputs from the given tables each time; the shorter run
counts. Results go to a sink that reads every row and column.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks import catalog
from spendtrace.session import drop_intermediate, local_session

HEADLINE = [
    "point_features", "sequences_long", "similarity", "risk_scores_fixed", "scored_log",
    "reasons_topk", "batch_score", "batch_score_summary", "fraud_rings_min_k",
    "feature_summary", "auc_roc", "point_features_skewed", "customer_profile",
    "failed_logins_24h_derived", "report_rows", "trained_metrics",
]
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    queries, seconds = catalog.all_queries(), {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            catalog.forget_tables()
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name} {best:.2f} s", file=sys.stderr, flush=True)
    drop_intermediate(spark)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "events": rows,
        "feature_rows_per_second": round(rows / seconds["point_features"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

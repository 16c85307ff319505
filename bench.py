"""Time the headline queries and print one JSON line.

`BENCH_SF_DIR` and `BENCH_CPUS` choose the data and the local cores. Each query runs
from raw tables to a fully computed result: once to warm up, then `BENCH_RUNS` times;
the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "order_mart",
    "item_features",
    "state_late_rates",
    "worst_route_pairs",
    "monthly_rolling_average",
    "late_rate_all_dimensions",
    "baseline_summary",
    "price_quartiles",
    "correlations",
    "missing_values",
    "table_overview",
    "feature_matrix",
    "roc_auc",
    "risk_factors",
    "stream_late_windows",
]


def main() -> None:
    from ontide.plans.registry import QUERIES
    from ontide.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "ontide-bench",
        spark__master=f"local[{cpus}]",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "20g"),
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median warm query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()

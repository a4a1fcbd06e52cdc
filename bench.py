"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the sample tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names instead of the headline list
BENCH_RUNS    runs per query; the fastest counts (default 3)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from factorloom.session import local_session  # noqa: E402

HEADLINE = ["scan_price_panel", "scan_fundamentals_first", "january_snapshot", "month_anchor",
            "daily_returns", "rolling_volatility", "rolling_liquidity", "factor_momentum",
            "factor_volatility", "factor_liquidity", "factor_value", "factor_growth",
            "factor_panel_one_pass", "normalize_cross_section", "null_ratio_columns",
            "spearman_rank", "linear_fit", "development_groups", "hdi_groups",
            "analyze_all_countries"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores), memory="16g")
    spark.read.parquet(f"{folder}/region.parquet").count()
    taken = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - start
            best = seconds if best is None else min(best, seconds)
        taken[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(taken.values()), 3),
                      "unit": "sec", "queries": taken, "sf": os.path.basename(folder.rstrip("/")),
                      "cpus": int(cores)}))


if __name__ == "__main__":
    main()

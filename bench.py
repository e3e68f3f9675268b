"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local
cores. Every query runs once to warm the JVM up and is then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattcell.registry import QUERIES  # noqa: E402
from wattcell.session import local_session  # noqa: E402

HEADLINE = [
    "prepare",
    "thresholds_global",
    "thresholds_cell",
    "thresholds_global_bracketed",
    "policy_plain_global",
    "policy_hysteresis_global",
    "policy_hysteresis_one_day",
    "policy_probability",
    "bs_summary_hysteresis",
    "bs_mean_state_bs",
    "cell_kpis",
    "overview",
    "risk_metrics",
    "top_by_eco_saved_kwh",
    "score_profile",
    "pareto_sweep",
    "drift_stats",
    "drift_hist_prb",
    "binary_metrics",
    "prb_rank_baseline",
    "best_threshold",
    "calibration_deciles",
    "dup_profiles",
    "split_cell_group",
    "feature_matrix",
    "lineitem_thresholds_cell",
    "lineitem_policy_summary",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "wattcell-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, sf_dir)
    for name in HEADLINE:
        seconds[name] = round(timed(spark, name, sf_dir), 3)
        spark.catalog.clearCache()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Headline queries on the bench tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from skyledger.queries import QUERIES  # noqa: E402
from skyledger.session import local_session  # noqa: E402

HEADLINE = [
    "a07_leaderboard", "a05_slice_tables", "w05_first_scope_pnl", "w04_drawdown", "w12_greedy_cap", "j17_policy_overlap", "j11_consensus",
    "j01_value_change", "j04_join_decisions_to_tape", "t02_checkpoints", "b08_decision_summaries", "a14_feed_summary", "p01_decision_cache",
    "a38_decision_grain", "p05_score_rules", "a15_score_distributions", "d09_shift_distribution", "r01_cluster_bootstrap", "w01_snapshots", "p12_incremental_after_peer",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session("skyledger-bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start-up is not part of any query
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.  Each query is
planned and run to the end with its rows discarded on the executors.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattframe.plans.catalog import QUERIES  # noqa: E402
from wattframe.session import local_session  # noqa: E402

HEADLINE = (
    "heuristic_energy",
    "pid_batch_merge",
    "cpu_slices",
    "cpu_stats_exec_reset",
    "mem_stats",
    "gpu_stats",
    "feature_snapshot",
    "container_enrich",
    "container_asof",
    "system_summary",
    "energy_by_container",
    "ai_vs_general",
    "topk_energy",
    "carbon_by_region",
    "counter_cumulative",
    "counter_rate",
    "carbon_per_min",
    "faults_per_min",
    "metric_samples",
    "confidence_median",
    "fallback_estimates",
    "energy_breakdown",
    "train_model",
    "decode_records",
    "stream_pid_merge",
    "stream_exec_reset",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cpus, partitions=cpus)
    QUERIES["heuristic_energy"](spark, sf_dir).limit(1).collect()  # start the JVM's code paths

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {
        name: round(rows / seconds[name])
        for name in ("heuristic_energy", "pid_batch_merge", "cpu_slices", "stream_pid_merge")
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "events": rows,
                "events_per_second": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

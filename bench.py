"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and
print one JSON line with per-query seconds.

Every query is forced to completion with the ``noop`` sink (all rows computed, nothing
collected to the driver). Session start-up and a warm-up query are not timed; each
query runs ``BENCH_REPEATS`` times (default 2) and the best time is reported, which
keeps JIT warm-up and a noisy host out of the comparison between rounds.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sensorlake.plans.catalog import QUERIES  # noqa: E402
from sensorlake.session import get_session  # noqa: E402

HEADLINE = [
    "decode_readings",
    "stream_ingest",
    "dashboard",
    "latest_100",
    "page_3",
    "point_lookup",
    "row_numbers",
    "row_numbers_global",
    "row_numbers_hot_sensor",
    "step_flags",
    "step_flags_hot_sensor",
    "temperature_residual",
    "range_flags",
    "split_good",
    "error_summary",
    "unpivot",
    "csv_roundtrip",
    "csv_skip_max",
    "format_columns",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(
        f"local[{cpus}]",
        app_name="sensorlake-bench",
        shuffle_partitions=max(2, cpus),
        conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")},
    )
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    # Warm-up (JIT, codegen caches); not timed.
    QUERIES["decode_readings"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "2")))
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(repeats):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "rows": n_events,
                "rows_per_sec": {k: round(n_events / v) for k, v in times.items() if v > 0},
                "cpus": cpus,
                "repeats": repeats,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query runs to completion through the ``noop`` sink (no collect).  The
fixture store (long-layout sample tables derived from the input) is built
first and reported separately; a warm-up run starts the Python workers.
Each query runs once to warm up; the median of ``BENCH_RUNS`` (default 3)
further runs counts, so that one slow moment of the machine does not.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wavespark.plans import catalog, viewing  # noqa: E402, F401  (viewing registers its queries)
from wavespark.plans.fixtures import fixture_store  # noqa: E402
from wavespark.session import local_session  # noqa: E402

HEADLINE = [
    "capture_ingest",        # S1-S3, S7, S9, S10 (fresh ingest each run)
    "linear_transform",      # P5, P6
    "trace_stats",           # P5 + A1-A5
    "trace_stats_selected",  # A6
    "power_multiply",        # J3
    "trace_divide",          # J4
    "derived_of_derived",    # J6
    "version_compare",       # J7
    "lowpass",               # L1/L2
    "savgol_odd",            # L3 + L4
    "savgol_percent",        # L3
    "spectrum",              # L5/L6
    "view_rows",             # R13
]


def run(spark, name, sf):
    if name == "capture_ingest":
        catalog.ingest_orders(spark, sf, fresh=True)
    df = catalog.QUERIES[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2)
    t = time.time()
    fixture_store(spark, sf)
    setup = time.time() - t
    times = {}
    for name in HEADLINE:
        run(spark, name, sf)  # warm-up (first run also builds cached inputs)
        took = []
        for _ in range(runs):
            t = time.time()
            run(spark, name, sf)
            took.append(time.time() - t)
        times[name] = round(median(took), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_warm", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
                      "fixture_setup_sec": round(setup, 3), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()

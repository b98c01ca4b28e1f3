"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 5), BENCH_QUERIES (comma list, default the headline set).
Every query is run once to warm up, then BENCH_RUNS timed rounds run all queries
in rotation; each time covers building the DataFrame, planning, running and
collecting the result. Reported: the median per query. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.catalog import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = ["q1a", "q1b", "q2a", "q2b", "j5", "j7", "x1", "a3_cond", "q1_pk", "q2_fk"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "16g"})
    out, rows, times = {}, {}, {q: [] for q in names}
    for q in names:                      # warm-up: JIT, class loading, file listing
        rows[q] = len(QUERIES[q](spark, sf_dir).collect())
    for _ in range(runs):                # timed rounds, queries in rotation
        for q in names:
            t0 = time.perf_counter()
            QUERIES[q](spark, sf_dir).collect()   # build + plan + run + collect
            times[q].append(time.perf_counter() - t0)
    out = {q: round(statistics.median(ts), 4) for q, ts in times.items()}
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(out.values()), 4)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": total, "unit": "sec",
                      "queries": out, "rows": rows, "sf": float(m.group(1)) if m else None,
                      "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()

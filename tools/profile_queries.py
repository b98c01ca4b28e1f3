"""Per-query jobs, stages, tasks and shuffle bytes from Spark's event log.

Usage: python tools/profile_queries.py SF_DIR SCRATCH_DIR [key ...]
Runs each query once to warm up and once measured with the event log written to
SCRATCH_DIR (use a fresh folder). Prints one JSON line per query.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.plans.catalog import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402


def main():
    sf_dir, scratch = sys.argv[1], sys.argv[2]
    keys = sys.argv[3:] or ["q1a", "q1b", "q2a", "q2b", "j5", "j7", "x1", "a3_cond", "q1_pk",
                            "q2_fk"]
    spark = build_session("local[8]", 8, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": scratch,
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    sc = spark.sparkContext
    marks = {}
    for k in keys:
        QUERIES[k](spark, sf_dir).collect()
        sc.setJobGroup(k, k)
        t0 = time.time()
        rows = len(QUERIES[k](spark, sf_dir).collect())
        marks[k] = (t0, time.time(), rows)
        sc.setJobGroup("idle", "idle")
    spark.stop()
    log = [p for p in glob.glob(os.path.join(scratch, "**", "*"), recursive=True)
           if os.path.isfile(p)][0]
    job_group, stage_job = {}, {}
    acc = {k: {"jobs": 0, "stages": 0, "tasks": 0, "shuffle_write_bytes": 0,
               "shuffle_read_bytes": 0, "input_bytes": 0} for k in keys}
    for line in open(log):
        e = json.loads(line)
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            if g in acc:
                job_group[e["Job ID"]] = g
                acc[g]["jobs"] += 1
                for s in e["Stage IDs"]:
                    stage_job[s] = g
        elif ev == "SparkListenerStageCompleted":
            g = stage_job.get(e["Stage Info"]["Stage ID"])
            if g:
                acc[g]["stages"] += 1
        elif ev == "SparkListenerTaskEnd":
            g = stage_job.get(e["Stage ID"])
            m = e.get("Task Metrics") or {}
            if g and m:
                a = acc[g]
                a["tasks"] += 1
                a["shuffle_write_bytes"] += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                r = m.get("Shuffle Read Metrics", {})
                a["shuffle_read_bytes"] += r.get("Remote Bytes Read", 0) + r.get("Local Bytes Read", 0)
                a["input_bytes"] += m.get("Input Metrics", {}).get("Bytes Read", 0)
    for k in keys:
        t0, t1, rows = marks[k]
        print(json.dumps({"query": k, "seconds": round(t1 - t0, 3), "rows": rows, **acc[k]}))


if __name__ == "__main__":
    main()

"""Per-report jobs, stages, tasks and times from Spark's event log.

Usage: python scripts/stage_report.py [sf_dir]   (default /root/testdata/sf0.1)

Builds curated tables from ``sf_dir``, runs every report twice with the event
log written to a new scratch folder, and prints for the second (warm) run:
wall seconds, Spark jobs, job milliseconds, stages and tasks per report.
The difference between wall time and job time is driver-side work.
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _lines(path: str):
    if path.endswith(".zstd"):
        import zstandard

        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(path) as fh:
            yield from fh


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="ananas-events-")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("ananas-stages")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "16").config("spark.sql.session.timeZone", "UTC")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{scratch}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from ananas.plans.catalog import reports
    from ananas.plans.jobs import JOBS
    from ananas.session import staging_path
    from ananas.sources.tables import Tables

    t = Tables.from_synthetic(spark, sf_dir).write(staging_path(spark, "stages"))
    wall = {}
    for rep in (1, 2):
        for name, fn in reports().items():
            if name in JOBS:
                continue
            spark.sparkContext.setJobGroup(f"{name}#{rep}", name)
            start = time.time()
            fn(t).write.format("noop").mode("overwrite").save()
            wall[f"{name}#{rep}"] = time.time() - start
    spark.stop()

    jobs, stages = {}, {}
    for path in glob.glob(f"{scratch}/*/*") + glob.glob(f"{scratch}/*"):
        if os.path.isdir(path) or "appstatus" in path:
            continue
        for line in _lines(path):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                jobs[e["Job ID"]] = {"group": e.get("Properties", {}).get("spark.jobGroup.id"),
                                     "start": e["Submission Time"], "stages": e.get("Stage IDs", [])}
            elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                jobs[e["Job ID"]]["end"] = e["Completion Time"]
            elif ev == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                if "Completion Time" in si and "Submission Time" in si:
                    stages[si["Stage ID"]] = si["Number of Tasks"]
    per = collections.defaultdict(lambda: [0, 0, 0, 0])
    for info in jobs.values():
        g = info["group"]
        if not g or not g.endswith("#2"):
            continue
        p = per[g]
        p[0] += 1
        p[1] += info.get("end", info["start"]) - info["start"]
        for s in info["stages"]:
            if s in stages:
                p[2] += 1
                p[3] += stages[s]
    print(f"{'report':32s} {'wall_s':>7s} {'jobs':>5s} {'job_ms':>7s} {'stages':>6s} {'tasks':>6s}")
    for g, (nj, jms, ns, nt) in sorted(per.items(), key=lambda x: -wall[x[0]]):
        print(f"{g[:-2]:32s} {wall[g]:7.2f} {nj:5d} {jms:7d} {ns:6d} {nt:6d}")
    total = sum(v for k, v in wall.items() if k.endswith("#2"))
    print(f"total wall {total:.2f} s; job time {sum(p[1] for p in per.values()) / 1000:.2f} s; event log in {scratch}")


if __name__ == "__main__":
    main()

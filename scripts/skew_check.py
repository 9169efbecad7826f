"""Measure task balance when one municipality holds two thirds of the survey.

Usage: python scripts/skew_check.py [sf_dir]   (default /root/testdata/sf0.1)

Runs RG4 (two-phase flag counts) and, for contrast, a per-municipality
``collect_set`` on a survey where two thirds of the rows are moved to one
municipality, with AQE off so partitions stay as planned, and prints for each
shuffle-reading stage the largest and the median shuffle bytes read by a task
(from Spark's event log in a scratch folder).
"""

from __future__ import annotations

import glob
import io
import json
import os
import statistics
import sys
import tempfile

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
    scratch = tempfile.mkdtemp(prefix="ananas-skew-")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (
        SparkSession.builder.master("local[8]").appName("ananas-skew")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "32").config("spark.sql.adaptive.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{scratch}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import dataclasses

    from ananas.plans import registration
    from ananas.plans.common import raw_person
    from ananas.sources.tables import Tables

    t = Tables.from_synthetic(spark, sf_dir)
    hot = t.qp_farmer_raw.withColumn(
        "raw_municipality",
        F.when(F.pmod(F.xxhash64("logs", "raw_lname"), F.lit(3)) != 0, F.lit("1")).otherwise(F.col("raw_municipality")),
    )
    skewed = dataclasses.replace(t, qp_farmer_raw=hot)
    spark.sparkContext.setJobGroup("two_phase", "RG4 two-phase flag counts")
    registration.rbsba_table(skewed).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("collect_set", "per-municipality collect_set")
    hot.groupBy("raw_municipality").agg(F.size(F.collect_set(raw_person("ws"))).alias("n")).write.format(
        "noop").mode("overwrite").save()
    spark.stop()

    report(scratch)


def report(scratch: str) -> None:
    group_of_stage, tasks = {}, {}
    for path in glob.glob(f"{scratch}/*/*") + glob.glob(f"{scratch}/*"):
        if os.path.isdir(path) or "appstatus" in path:
            continue
        for line in _lines(path):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                g = e.get("Properties", {}).get("spark.jobGroup.id")
                for s in e.get("Stage IDs", []):
                    group_of_stage[s] = g
            elif ev == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                sr = m.get("Shuffle Read Metrics") or {}
                read = sr.get("Local Bytes Read", 0) + sr.get("Remote Bytes Read", 0)
                if read:
                    tasks.setdefault(e["Stage ID"], []).append(read)
    print(f"{'plan':12s} {'stage':>5s} {'tasks':>5s} {'max_bytes':>11s} {'median':>8s} {'max/median':>10s}")
    for stage in sorted(tasks):
        group = group_of_stage.get(stage)
        if group not in ("two_phase", "collect_set"):
            continue
        reads = tasks[stage]
        med = statistics.median(reads)
        print(f"{group:12s} {stage:5d} {len(reads):5d} {max(reads):11d} {med:8.0f} {max(reads) / max(med, 1):10.1f}")


if __name__ == "__main__":
    main()

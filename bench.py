"""Benchmark: every registered report over curated tables at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line. Steps:

1. ``curate``: build the domain tables from the synthetic star schema and
   write them as parquet (what ingest produces in production), timed;
2. a warm-up pass of every report on the smallest scale (untimed, JIT);
3. each report, run to completion with the ``noop`` sink (full execution,
   no driver collect), timed one by one; a report's time is the best of
   ``BENCH_REPEAT`` runs (default 2), as single runs on a shared machine
   vary by about 25%;
4. ``dashboard``: the 21 result sets of the main page, submitted together
   from a thread pool over a cached survey projection, timed as one.
"""

from __future__ import annotations

import json
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ananas.plans import dashboard  # noqa: E402
from ananas.plans.catalog import ALIASES, AS_OF, reports  # noqa: E402
from ananas.plans.jobs import JOBS  # noqa: E402
from ananas.session import local_session, staging_path  # noqa: E402
from ananas.sources.tables import Tables  # noqa: E402



def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=2 * cpus, app="ananas-bench")
    spark.sparkContext.setLogLevel("ERROR")
    sf = sf_dir.rsplit("sf", 1)[-1]

    t0 = time.time()
    curated = Tables.from_synthetic(spark, sf_dir).write(staging_path(spark, f"bench-curated-sf{sf}"))
    curate_sec = time.time() - t0

    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.exists(os.path.join(warm_dir, "lineitem.parquet")):
        warm = Tables.from_synthetic(spark, warm_dir)
        for name, fn in reports().items():
            if name not in JOBS:
                run(fn(warm))

    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    times: dict[str, float] = {"curate": round(curate_sec, 3)}
    first_total = 0.0
    for name, fn in reports().items():
        if name in ALIASES:
            continue
        best = float("inf")
        for i in range(1 if name in JOBS else repeat):
            start = time.time()
            run(fn(curated))
            took = time.time() - start
            if i == 0 and name not in JOBS:
                first_total += took
            best = min(best, took)
        times[name] = round(best, 3)

    fresh = Tables.from_curated(spark, curated_path(curated))
    start = time.time()
    page = dashboard.dashboard_page(fresh, AS_OF)
    with ThreadPoolExecutor(max_workers=8) as pool:
        list(pool.map(run, page.values()))
    times["dashboard"] = round(time.time() - start, 3)

    report_total = sum(v for k, v in times.items() if k not in JOBS and k not in ("curate", "dashboard"))
    print(json.dumps({
        "metric": "report_suite_seconds",
        "value": round(report_total, 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "reports": len([k for k in times if k not in JOBS and k not in ("curate", "dashboard")]),
        "jobs_seconds": round(sum(v for k, v in times.items() if k in JOBS), 3),
        "repeat": repeat,
        "first_run_report_seconds": round(first_total, 3),
    }))


def curated_path(t: Tables) -> str:
    files = t.qp_farmer_raw.inputFiles()
    return os.path.dirname(os.path.dirname(files[0])) if files else ""


if __name__ == "__main__":
    main()

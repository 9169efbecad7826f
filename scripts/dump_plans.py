"""Write PLANS.md: physical plans of representative reports over curated tables.

Usage: python scripts/dump_plans.py [sf_dir]   (default /root/testdata/sf0.01)
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ananas.plans import area, farmers, market, population, registration  # noqa: E402
from ananas.plans.catalog import AS_OF  # noqa: E402
from ananas.session import local_session, staging_path  # noqa: E402
from ananas.sources.tables import Tables  # noqa: E402

CASES = [
    ("AR5 area_ranking (flagship)", lambda t: area.area_ranking(t),
     "Scan pruned to two columns; the 25-row municipality list is broadcast (size-checked); partial "
     "aggregate before the only shuffle; the ranking window runs over one row per municipality."),
    ("RG4 rbsba_table", lambda t: registration.rbsba_table(t),
     "Three self-joined COUNT(DISTINCT) subqueries become one scan and a two-phase aggregate: the first "
     "shuffle is on (municipality, person), so a hot municipality spreads over tasks; no Expand, no join "
     "between aggregates; the dimension join happens after aggregation."),
    ("FA6 farmer_count_series", lambda t: farmers.farmer_count_series(t),
     "Total and per-year distinct counts in one ROLLUP: Expand x2 feeds a map-side partial aggregate, so "
     "the doubled rows never reach a shuffle; the one-row fallback (a total row even on empty input) is "
     "folded into the small rollup output."),
    ("AR7 area_all", lambda t: area.area_all(t, AS_OF),
     "Per-municipality rows and the provincial total from one scan: broadcast left join, then one "
     "aggregate over two grouping sets; the year range is pushed to the scan."),
    ("HV1 expected_harvest_total", lambda t: population.expected_harvest_total(t, AS_OF),
     "YEAR(d) = y written as a half-open range: both bounds in PushedFilters, so files and row groups "
     "outside the year are skipped (facts are range-partitioned and sorted by date)."),
    ("PE1 pest_list", lambda t: market.pest_list(t, "Pests"),
     "ROW_NUMBER over the whole catalogue without a single-partition window over rows: rows are "
     "range-partitioned on their quantile bucket and numbered by a window per bucket, plus a running "
     "total over the bucket counts (a bounded list) broadcast back. Partitions come out in number "
     "order, so the final sort adds no exchange."),
]


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def summarize(plan: str) -> str:
    tree, details = plan.split("\n\n\n", 1) if "\n\n\n" in plan else (plan, "")
    keep = []
    for block in details.split("\n\n"):
        head = block.strip().splitlines()[0] if block.strip() else ""
        if head.startswith("(") and ("Scan" in head or "Window" in head or "Expand" in head):
            lines = [ln for ln in block.strip().splitlines()
                     if ln.startswith("(") or re.match(r"(PushedFilters|ReadSchema|Arguments|Location)", ln)]
            keep.append("\n".join(re.sub(r"#\d+L?", "", ln) for ln in lines))
    tree = re.sub(r"#\d+L?", "", tree.strip())
    return tree + "\n\n" + "\n\n".join(keep)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables.from_synthetic(spark, sf_dir).write(staging_path(spark, "plans"))
    out = ["# PLANS", "",
           f"Physical plans (`explain('formatted')`, before adaptive re-planning) of representative reports over "
           f"the curated tables built from `{sf_dir}`. Generated by `scripts/dump_plans.py`.", ""]
    for title, fn, why in CASES:
        plan = summarize(formatted(fn(t)))
        plan = re.sub(r"file:[^\]]*/ananas-staging/[^/\]]*/", ".../", plan)
        out += [f"## {title}", "", why, "", "```", plan, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()

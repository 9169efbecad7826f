"""Command line: curate, ingest, and run any registered report.

    python -m ananas curate  --sf-dir /root/testdata/sf0.1 --out PATH
    python -m ananas load    --feed survey --source DIR --target PATH --rejects PATH [--muni PATH]
    python -m ananas stream  --feed price --source DIR --out DIR --checkpoint DIR [--once] [--muni PATH]
    python -m ananas report  NAME --curated PATH [--as-of 2001-06-30] [--muni NATION_3] [--year 2000] [--out PATH]
    python -m ananas list
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="ananas")
    sub = p.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("curate", help="build the domain tables from a synthetic star schema and write them")
    c.add_argument("--sf-dir", required=True)
    c.add_argument("--out", required=True)
    ld = sub.add_parser("load", help="ingest a folder of CSV files of one feed (idempotent per file)")
    ld.add_argument("--feed", required=True, choices=["survey", "soil", "price", "harvest", "pests", "weather"])
    ld.add_argument("--source", required=True)
    ld.add_argument("--target", required=True, help="the table's folder: rows, rejects and ledger")
    st = sub.add_parser("stream", help="ingest new CSV files dropped into a folder (Structured Streaming)")
    st.add_argument("--feed", required=True, choices=["survey", "soil", "price", "harvest", "pests", "weather"])
    st.add_argument("--source", required=True)
    st.add_argument("--out", required=True)
    st.add_argument("--checkpoint", required=True)
    st.add_argument("--once", action="store_true", help="process the files present now, then stop")
    st.add_argument("--max-files", type=int, default=1000, help="files per micro-batch (bounds batch size)")
    for x in (ld, st):
        x.add_argument("--muni", help="tbl_muni parquet, for the survey feed's municipality ids (N2)")
        x.add_argument("--farmers", help="farmer_demo parquet, for its farmer ids (N1)")
        x.add_argument("--barangay", help="tbl_barangay parquet, for its barangay ids (N3)")
        x.add_argument("--date-format", action="append", help="a date pattern of the feed; may be repeated")
    r = sub.add_parser("report", help="run one registered report")
    r.add_argument("name")
    r.add_argument("--curated", required=True)
    r.add_argument("--as-of", default=None)
    r.add_argument("--muni", default=None)
    r.add_argument("--year", type=int, default=None)
    r.add_argument("--out", help="write JSON lines here instead of printing")
    sub.add_parser("list", help="list registered report names")
    a = p.parse_args(argv)

    from ananas.plans.catalog import AS_OF, HARVEST_YEAR, MUNI, reports

    if a.cmd == "list":
        print("\n".join(reports()))
        return 0

    from ananas.session import local_session
    from ananas.sources import feeds
    from ananas.sources.tables import Tables

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    if a.cmd == "curate":
        Tables.from_synthetic(spark, a.sf_dir).write(a.out)
        return 0
    if a.cmd in ("load", "stream"):
        from ananas.sources import weather

        read = weather.ingest_weather if a.feed == "weather" else feeds.feed_reader(feeds.FEEDS[a.feed], a.date_format or feeds.DEFAULT_DATE_FORMATS)
        key, transform = feeds.KEYS.get(a.feed), None
        if a.feed == "survey":
            if not a.muni:
                p.error("--muni is required for the survey feed")
            muni, demo, brgy = (spark.read.parquet(x) if x else None for x in (a.muni, a.farmers, a.barangay))
            transform = lambda good: feeds.curate_survey(good, muni, demo, brgy)
        if a.cmd == "load":
            ok, bad = feeds.load_files(spark, feeds.list_files(spark, a.source), a.target, read, transform, key)
            print(f"accepted {ok} rejected {bad}")
            return 0
        from ananas.streaming import ingest as stream

        paths = stream.StreamPaths(a.source, a.out, a.checkpoint)
        q = stream.start_stream(spark, paths, read, transform, key, available_now=a.once, max_files_per_trigger=a.max_files)
        q.awaitTermination()
        return 0
    as_of = dt.date.fromisoformat(a.as_of) if a.as_of else AS_OF
    table = reports(as_of, a.muni or MUNI, a.year or HARVEST_YEAR)
    if a.name not in table:
        p.error(f"unknown report {a.name!r}; see `python -m ananas list`")
    df = table[a.name](Tables.from_curated(spark, a.curated))
    if a.out:
        feeds.write_result(df, a.out)
    else:
        for row in df.toLocalIterator():
            print(row.asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())

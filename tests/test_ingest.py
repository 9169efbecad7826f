"""Ingest, sync and streaming jobs on hand-made feeds."""

import dataclasses
import datetime as dt
import os
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ananas.operators.sync import sync_barangay_id, sync_farmer_id, sync_municipality_id
from ananas.session import staging_path
from ananas.sources import feeds, weather
from ananas.streaming import ingest as stream
from tests.conftest import DEFAULT_MUNI


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as fh:
        fh.write(text)
    return path


PRICE_CSV = "DATE,Medium,Large,BUYER/SELLER\n2001-01-05,10.50,12.25,Juan\n2001-01-06,x,13.00,\n2001-13-01,1,2,Ana\n"


def test_price_rejects_do_not_raise(spark):
    path = _write(staging_path(spark, "t-price"), "a.csv", PRICE_CSV)
    good, bad = feeds.ingest(spark, path, feeds.PRICE)
    g = good.collect()
    assert [(r.date, r.med_price, r.lg_price, r.buyer_seller) for r in g] == [
        (dt.date(2001, 1, 5), Decimal("10.50"), Decimal("12.25"), "Juan")
    ]
    assert sorted(r._reject for r in bad.collect()) == ["date", "med_price"]


def test_wrong_cell_count_is_rejected(spark):
    text = "DATE,Medium,Large,BUYER/SELLER\n2001-01-05,1,2,Juan\n2001-01-06,1,2\n2001-01-07,1,2,x,extra\n,,,\n"
    path = _write(staging_path(spark, "t-malformed"), "a.csv", text)
    good, bad = feeds.ingest(spark, path, feeds.PRICE)
    assert good.count() == 1 and good.select("date").count() == 1
    assert [r.date for r in good.select("date").collect()] == [dt.date(2001, 1, 5)]
    assert sorted(r._reject for r in bad.collect()) == ["empty", "malformed", "malformed"]


def test_cells_are_found_by_header_name(spark):
    path = staging_path(spark, "t-price-names")
    _write(path, "a.csv", "Large,More,DATE,Medium,BUYER/SELLER\n1,q,2020-1-8,2,x\n")
    _write(path, "b.csv", "DATE,Medium,Large\n2001-01-02,1,2\n")  # lacks a column: rejects, and the others are read
    _write(path, "c.csv", "\ufeffDATE,Medium,Large,BUYER/SELLER\n2001/1/3,1,2,y\n")
    _write(path, "d.csv", "")
    good, bad = feeds.ingest(spark, path, feeds.PRICE)
    got = sorted((r.date, r.med_price, r.lg_price, r.buyer_seller) for r in good.collect())
    assert got == [(dt.date(2001, 1, 3), Decimal(1), Decimal(2), "y"), (dt.date(2020, 1, 8), Decimal(2), Decimal(1), "x")]
    assert [r._reject for r in bad.collect()] == ["header:BUYER/SELLER"]


def test_quotes_blanks_and_quoted_breaks(spark):
    text = 'DATE,Medium,Large,BUYER/SELLER\n2001-01-02,1,2,"Ba ""sud"" x"\n2001-01-03, 1 ,2, Daet \n2001-01-04,1,2,"two\nlines, one"\n'
    path = _write(staging_path(spark, "t-dialect"), "a.csv", text)
    good, bad = feeds.ingest(spark, path, feeds.PRICE)
    assert [r.buyer_seller for r in good.orderBy("date").collect()] == ['Ba "sud" x', "Daet", "two\nlines, one"]
    assert bad.count() == 0


def test_wide_weather_sheet_keeps_every_cell(spark):
    heads = ["Day", "2020"] + ["Jan", "Feb"] * 12
    path = _write(staging_path(spark, "t-wide"), "w.csv", ",".join(heads) + "\n" + ",".join(["1", "x"] + [str(i) for i in range(24)]) + "\n")
    good, bad = weather.ingest_weather(spark, path)
    assert sorted(int(r.rain_amount) for r in good.collect()) == list(range(24)) and bad.count() == 0


SURVEY_HEAD = ",".join(feeds.SURVEY.headers)


def test_survey_ingest_syncs_municipality_names(spark):
    body = [
        "Alpha,b1,Ana,,Cruz,F,1980-02-03,1.5,100,2000-01-02,Vegetative,2001-03-04,ok,R1,0917,Owner",
        "Nowhere,b2,Ben,Q,Diaz,M,1970-01-01,2,7,2000-01-02,,2001-03-04,,,,",
        "Beta,b3,Cy,R,Eve,M,1970-01-01,2,seven,2000-01-02,,2001-03-04,,,,",
    ]
    path = _write(staging_path(spark, "t-survey"), "s.csv", SURVEY_HEAD + "\n" + "\n".join(body) + "\n")
    good, bad = feeds.ingest(spark, path, feeds.SURVEY)
    muni = spark.createDataFrame(DEFAULT_MUNI, "muni_id string, muni_name string")
    cur = {r.raw_fname: r for r in feeds.curate_survey(good, muni).collect()}
    assert cur["Ana"].raw_municipality == "1" and cur["Ana"].raw_mname == "" and cur["Ana"].contact_number == "0917"
    assert cur["Ana"].raw_area == Decimal("1.5000") and cur["Ana"].tenurial == "Owner"
    assert cur["Ben"].raw_municipality == "Nowhere" and cur["Ben"].RBSBA == ""
    assert all(r.is_synced for r in cur.values())
    assert [r._reject for r in bad.collect()] == ["raw_population"]


def test_soil_date_is_day_month_year(spark):
    text = ",".join(feeds.SOIL.headers) + "\nAna,Cruz,Alpha,1.25,3-4-2001,6.5,1,2,3\n"
    path = _write(staging_path(spark, "t-soil"), "s.csv", text)
    good, bad = feeds.ingest(spark, path, feeds.SOIL)
    r = good.collect()[0]
    assert r.sampled == dt.date(2001, 4, 3) and r.ph == Decimal("6.5000") and bad.count() == 0


def test_weather_sheet(spark):
    # the year in the second column, a label column, Jan and Feb; row 30 has a Feb cell
    lines = ["Day,2020,Jan,Feb"] + [f"{d},x,{'' if d == 2 else d},{d if d in (1, 30) else ''}" for d in range(1, 32)]
    path = _write(staging_path(spark, "t-weather"), "w2020.csv", "\n".join(lines) + "\n")
    good, bad = weather.ingest_weather(spark, path)
    got = {r.date: r.rain_amount for r in good.collect()}
    assert dt.date(2020, 1, 1) in got and dt.date(2020, 1, 2) not in got  # blank cell dropped
    assert got[dt.date(2020, 2, 1)] == Decimal("1.00") and len(got) == 31
    assert [(r.ordinal, r._reject) for r in bad.collect()] == [(30, "date")]  # Feb 30


def test_weather_day_from_label(spark):
    # row 2 is missing: by position the 3rd becomes day 2, by label it stays day 3
    lines = ["2021,Day,Mar", "1,1,0.5", "3,3,0.7"]
    path = _write(staging_path(spark, "t-weather-label"), "w.csv", "\n".join(lines) + "\n")
    by_pos = {r.date for r in weather.ingest_weather(spark, path)[0].collect()}
    by_label = {r.date for r in weather.ingest_weather(spark, path, day_from="label")[0].collect()}
    assert by_pos == {dt.date(2021, 3, 1), dt.date(2021, 3, 2)}
    assert by_label == {dt.date(2021, 3, 1), dt.date(2021, 3, 3)}


def test_weather_sheet_round_trip(spark):
    daily = spark.createDataFrame(
        [(dt.date(2019, 12, 31), Decimal("1.25")), (dt.date(2020, 2, 29), Decimal("0.00"))], "date date, rain_amount decimal(10,2)"
    )
    path = staging_path(spark, "t-weather-rt")
    weather.write_sheets(daily, path)
    good, bad = weather.ingest_weather(spark, path)
    assert sorted((r.date, r.rain_amount) for r in good.collect()) == sorted(tuple(r) for r in daily.collect())
    assert bad.count() == 0


def test_stream_is_exactly_once(spark):
    src = staging_path(spark, "t-drop")
    _write(src, "a.csv", PRICE_CSV)
    base = staging_path(spark, "t-stream")
    paths = stream.StreamPaths(src, f"{base}/out", f"{base}/ckpt")
    stream.run_once(spark, feeds.PRICE, paths)
    assert stream.read_accepted(spark, paths).count() == 1
    stream.run_once(spark, feeds.PRICE, paths)  # same folder again: nothing new
    assert stream.read_accepted(spark, paths).count() == 1
    _write(src, "b.csv", "DATE,Medium,Large,BUYER/SELLER\n2001-02-01,1,2,x\n2001-02-02,1,2,y\n")
    stream.run_once(spark, feeds.PRICE, paths)
    assert stream.read_accepted(spark, paths).count() == 3
    assert feeds.read_rejects(spark, paths.output).count() == 2
    assert feeds.load_feed(spark, src, feeds.PRICE, paths.output) == (3, 2)  # a batch load of the same folder adds nothing


def test_sync_farmer_id(spark):
    survey = spark.createDataFrame(
        [("1", "Ana", "Q", "Cruz"), ("1", "Ana", None, "Cruz"), ("1", "Ben", "R", "Diaz")],
        "f_id string, raw_fname string, raw_mname string, raw_lname string",
    )
    demo = spark.createDataFrame(
        [("7", "Ana", "Q", "Cruz"), ("9", "Ana", "Q", "Cruz"), ("5", "Ana", None, "Cruz")],
        "f_id string, f_name string, m_name string, l_name string",
    )
    out = sync_farmer_id(survey, demo)
    assert out.count() == 3
    assert sorted(((r.raw_fname, r.raw_mname or "", r.f_id) for r in out.collect())) == [
        ("Ana", "", "1"), ("Ana", "Q", "9"), ("Ben", "R", "1")
    ]


def test_sync_municipality_only_unsynced(spark):
    survey = spark.createDataFrame(
        [("Alpha", False), ("Alpha", True), ("Gamma", False)], "raw_municipality string, is_synced boolean"
    )
    muni = spark.createDataFrame(DEFAULT_MUNI, "muni_id string, muni_name string")
    out = sorted((r.raw_municipality, r.is_synced) for r in sync_municipality_id(survey, muni).collect())
    assert out == [("1", True), ("Alpha", True), ("Gamma", True)]


def test_sync_barangay_two_column_key(spark):
    survey = spark.createDataFrame(
        [("Poblacion", "1"), ("Poblacion", "2"), ("Poblacion", "3")], "raw_barangay string, raw_municipality string"
    )
    brgy = spark.createDataFrame(
        [("11", "Poblacion", "1"), ("21", "Poblacion", "2")], "brgy_id string, brgy_name string, muni_id string"
    )
    out = sorted(tuple(r) for r in sync_barangay_id(survey, brgy).collect())
    assert out == [("11", "1"), ("21", "2"), ("Poblacion", "3")]


def test_sync_keeps_row_count(synthetic):
    q = synthetic.qp_farmer_raw
    n = q.count()
    assert sync_farmer_id(q, synthetic.farmer_demo).count() == n
    assert sync_barangay_id(q, synthetic.tbl_barangay).count() == n
    assert sync_municipality_id(q.withColumn("is_synced", F.lit(False)), synthetic.tbl_muni).count() == n


def test_survey_stream_with_municipality_sync(spark):
    src = staging_path(spark, "t-survey-drop")
    body = "Alpha,b1,Ana,,Cruz,F,1980-02-03,1.5,100,2000-01-02,,2001-03-04,,R1,,Owner\n"
    _write(src, "s1.csv", SURVEY_HEAD + "\n" + body)
    base = staging_path(spark, "t-survey-stream")
    paths = stream.StreamPaths(src, f"{base}/out", f"{base}/ckpt")
    muni = spark.createDataFrame(DEFAULT_MUNI, "muni_id string, muni_name string")
    stream.run_once(spark, feeds.SURVEY, paths, transform=lambda good: feeds.curate_survey(good, muni))
    rows = stream.read_accepted(spark, paths).collect()
    assert [(r.raw_municipality, r.raw_municipality_name, r.is_synced) for r in rows] == [("1", "Alpha", True)]


def test_unpublished_load_is_loaded_again(spark):
    src, target = staging_path(spark, "t-half-src"), staging_path(spark, "t-half-out")
    _write(src, "a.csv", PRICE_CSV)
    good, _ = feeds.ingest(spark, src, feeds.PRICE)
    good.write.parquet(f"{target}/rows/load_id=000000-dead")  # a load that died before its ledger entry
    assert feeds.load_feed(spark, src, feeds.PRICE, target) == (1, 2)
    assert feeds.load_feed(spark, src, feeds.PRICE, target) == (1, 2)
    assert feeds.read_loaded(spark, target).count() == 1 and feeds.read_rejects(spark, target).count() == 2


def test_a_failed_load_keeps_all_files_for_the_next(spark):
    src, target = staging_path(spark, "t-fail-src"), staging_path(spark, "t-fail-out")
    _write(src, "a.csv", PRICE_CSV)
    _write(src, "b.csv", "DATE,Medium,Large,BUYER/SELLER\n2001-02-01,1,2,x\n")

    def broken(good):
        raise RuntimeError("lost")

    try:
        feeds.load_feed(spark, src, feeds.PRICE, target, broken)
    except RuntimeError:
        pass
    assert feeds.load_feed(spark, src, feeds.PRICE, target) == (2, 2)


def test_second_load_reads_only_new_files(spark):
    src, target = staging_path(spark, "t-new-src"), staging_path(spark, "t-new-out")
    _write(src, "a.csv", PRICE_CSV)
    seen = []

    def read(s, paths):
        seen.append(sorted(os.path.basename(p) for p in paths))
        return feeds.feed_reader(feeds.PRICE)(s, paths)

    load = lambda: feeds.load_files(spark, feeds.list_files(spark, src), target, read)
    load()
    load()
    _write(src, "b.csv", "DATE,Medium,Large,BUYER/SELLER\n2001-02-01,1,2,x\n")
    assert load() == (2, 2) and seen == [["a.csv"], ["b.csv"]]


def test_loaded_rows_have_unique_keys(spark):
    src, target = staging_path(spark, "t-key-src"), staging_path(spark, "t-key-out")
    for i in range(3):
        _write(src, f"p{i}.csv", f"Category,Name,Description,Damage,Management,Report Count\nPests,a,{i},,,3\nPests,b,,,,x\nWeeds,c,,,,5\n")
        feeds.load_feed(spark, src, feeds.PESTS, target)
    rows = feeds.pest_catalogue(feeds.read_loaded(spark, target)).collect()
    assert len(rows) == len({r.id for r in rows}) == 6
    assert {(r.category, r.rank, round(r.percent, 3)) for r in rows} == {("Pests", 1, 33.333), ("Weeds", 1, 33.333)}


def test_continuous_stream_picks_up_new_files(spark):
    src = staging_path(spark, "t-live-drop")
    _write(src, "a.csv", "DATE,Medium,Large,BUYER/SELLER\n2001-03-01,1,2,x\n")
    base = staging_path(spark, "t-live")
    paths = stream.StreamPaths(src, f"{base}/out", f"{base}/ckpt")
    q = stream.start_feed_stream(spark, feeds.PRICE, paths, available_now=False, interval="1 second")
    try:
        q.processAllAvailable()
        assert stream.read_accepted(spark, paths).count() == 1
        _write(src, "b.csv", "DATE,Medium,Large,BUYER/SELLER\n2001-03-02,1,2,y\n2001-03-03,1,2,z\n")
        q.processAllAvailable()
        assert stream.read_accepted(spark, paths).count() == 3
    finally:
        q.stop()


# ------------------------------------------------------------------ content, snapshots, resync

ONE = "DATE,Medium,Large,BUYER/SELLER\n2001-02-01,1,2,x\n2001-02-02,3,4,y\n"


def test_a_copy_under_another_name_adds_nothing(spark):
    src, target = staging_path(spark, "t-copy-src"), staging_path(spark, "t-copy-out")
    _write(src, "b.csv", ONE)
    _write(src, "c.csv", ONE)  # in the same load
    _write(src, "empty.csv", "")
    assert feeds.load_feed(spark, src, feeds.PRICE, target) == (2, 0)
    _write(src, "a.csv", ONE)  # only copies: no load at all
    assert feeds.load_feed(spark, src, feeds.PRICE, target) == (2, 0)
    _write(src, "d.csv", ONE.replace("x", "z"))
    _write(src, "e.csv", ONE)
    assert feeds.load_feed(spark, src, feeds.PRICE, target) == (4, 0)
    assert sorted(r.buyer_seller for r in feeds.read_loaded(spark, target).collect()) == ["x", "y", "y", "z"]
    entries = feeds.ledger(spark, target).collect()
    assert sorted(os.path.basename(e.file) for e in entries) == ["a.csv", "b.csv", "c.csv", "d.csv", "e.csv"]  # an empty file is none
    assert len(feeds.loads(spark, target)) == 2


def test_reading_as_of_a_load(spark):
    src, target = staging_path(spark, "t-asof-src"), staging_path(spark, "t-asof-out")
    for k in range(3):
        _write(src, f"p{k}.csv", f"DATE,Medium,Large,BUYER/SELLER\n2001-03-0{k + 1},1,2,x\nbad,1,2,x\n")
        feeds.load_feed(spark, src, feeds.PRICE, target)
    for k in (1, 2, 3):
        assert feeds.read_loaded(spark, target, upto=k).count() == feeds.read_rejects(spark, target, upto=k).count() == k
    assert feeds.read_loaded(spark, target).count() == 3
    with pytest.raises(ValueError):
        feeds.read_loaded(spark, target, upto=0)


SURVEY_LINE = "{muni},{brgy},{first},{middle},{last},F,1980-02-03,1.5,100,2000-01-02,,2001-03-04,,R1,,Owner\n"


def test_resync_rewrites_only_loads_that_a_change_touches(spark):
    src, target = staging_path(spark, "t-sync-src"), staging_path(spark, "t-sync-out")
    muni = lambda rows: spark.createDataFrame(rows, "muni_id string, muni_name string")
    demo = lambda rows: spark.createDataFrame(rows, "f_id string, f_name string, m_name string, l_name string")
    brgy = lambda rows: spark.createDataFrame(rows, "brgy_id string, brgy_name string, muni_id string")
    m, d, b = [("1", "Alpha")], [("7", "Ana", "Q", "Cruz")], [("11", "Poblacion", "1")]
    people = [("Alpha", "Poblacion", "Ana", "Q", "Cruz"), ("Beta", "Poblacion", "Ben", "R", "Diaz"), ("Gamma", "Sitio", "Ana", "QC", "ruz")]
    for k, (place, village, first, middle, last) in enumerate(people):
        _write(src, f"s{k}.csv", SURVEY_HEAD + "\n" + SURVEY_LINE.format(muni=place, brgy=village, first=first, middle=middle, last=last) + ("bad\n" if k == 1 else ""))
        feeds.load_feed(spark, src, feeds.SURVEY, target, lambda good: feeds.curate_survey(good, muni(m), demo(d), brgy(b)))
    state = lambda upto=None: {r.logs: (r.raw_municipality, r.raw_barangay, r.f_id) for r in feeds.read_loaded(spark, target, upto).collect()}
    sync = lambda: feeds.resync(spark, target, muni(m), demo(d), brgy(b))
    keys = sorted(state())
    was = state()
    assert [was[k] for k in keys] == [("1", "11", "7"), ("Beta", "Poblacion", None), ("Gamma", "Sitio", "7")]
    sync()  # the first call meets all names
    assert state() == was
    quiet = feeds.loads(spark, target)
    assert sync() == [] and feeds.loads(spark, target) == quiet
    m.append(("2", "Beta"))
    b.append(("21", "Poblacion", "2"))
    old = sync()
    assert state() == {keys[0]: ("1", "11", "7"), keys[1]: ("2", "21", None), keys[2]: ("Gamma", "Sitio", "7")}
    untouched = [x for x in quiet if x not in old]
    assert untouched and set(untouched) <= set(feeds.loads(spark, target))  # Gamma's load stays as it is
    d[0] = ("8", "Ana", "Q", "Cruz")
    d.append(("9", "Ben", "R", "Diaz"))
    sync()
    assert state() == {keys[0]: ("1", "11", "8"), keys[1]: ("2", "21", "9"), keys[2]: ("Gamma", "Sitio", "8")}
    m.pop(0)  # a municipality goes: its rows have the name again
    sync()
    assert state()[keys[0]] == ("Alpha", "Poblacion", "8")
    assert feeds.read_rejects(spark, target).count() == 1
    assert feeds.load_feed(spark, src, feeds.SURVEY, target)[0] == 3  # counts are of files, not of rewritings
    assert state(upto=3) == was  # the table as it was loaded
    assert state(upto=1) == {keys[0]: ("1", "11", "7")}


def test_totals_stream_counts_late_files_and_restarts(spark):
    src, base = staging_path(spark, "t-totals-src"), staging_path(spark, "t-totals")
    paths = stream.StreamPaths(src, f"{base}/out", f"{base}/ckpt")
    line = lambda date, area: f"Alpha,b1,Ana,,Cruz,F,1980-02-03,{area},100,{date},,2001-03-04,,R1,,Owner\n"
    run = lambda: stream.run_totals_once(spark, feeds.SURVEY, paths, F.year("raw_dgathered"), "raw_area")
    got = lambda: {r.key: (float(r.total), r.n) for r in stream.read_totals(spark, paths).collect()}
    _write(src, "a.csv", SURVEY_HEAD + "\n" + line("2000-01-02", "1.5") + line("2001-01-02", "2") + line("2001-01-02", "x"))
    run()
    assert got() == {2000: (1.5, 1), 2001: (2.0, 1)}
    run()  # nothing new
    _write(src, "b.csv", SURVEY_HEAD + "\n" + line("2003-01-02", "4") + line("", "1"))
    run()
    _write(src, "c.csv", SURVEY_HEAD + "\n" + line("1990-01-02", "0.25") + line("2000-12-31", "1"))  # long after its years
    run()
    assert got() == {2000: (2.5, 2), 2001: (2.0, 1), 2003: (4.0, 1), None: (1.0, 1), 1990: (0.25, 1)}


# ------------------------------------------------------------------ loads read and parse once

def test_a_load_parses_each_row_once(spark):
    src, target = staging_path(spark, "t-once-src"), staging_path(spark, "t-once-out")
    _write(src, "a.csv", PRICE_CSV)
    _write(src, "b.csv", "DATE,Medium,Large,BUYER/SELLER\n2001-02-01,1,2,x\n")
    seen, reader = spark.sparkContext.accumulator(0), feeds.feed_reader(feeds.PRICE)

    def read(s, paths, headers=None):
        return feeds.split(read.parsed(s, paths, headers))

    def parsed(s, paths, headers=None):
        def count(frames):
            for f in frames:
                seen.add(len(f))
                yield f

        rows = reader(s, paths, headers)
        both = rows[0].withColumn("_reject", F.lit(None).cast("string")).unionByName(rows[1])
        return both.mapInPandas(count, both.schema)

    read.takes_headers, read.parsed = True, parsed
    assert feeds.load_files(spark, feeds.list_files(spark, src), target, read) == (2, 2)
    assert seen.value == 4
    assert sorted(r._reject for r in feeds.read_rejects(spark, target).collect()) == ["date", "med_price"]


def test_keys_of_a_load_have_no_gap_where_rows_were_rejected(spark):
    src, target = staging_path(spark, "t-dense-src"), staging_path(spark, "t-dense-out")
    _write(src, "p.csv", "Category,Name,Description,Damage,Management,Report Count\n" + "".join(f"Pests,n{i},,,,{'x' if i % 3 else i}\n" for i in range(30)))
    assert feeds.load_feed(spark, src, feeds.PESTS, target) == (10, 20)
    assert sorted(r.id for r in feeds.read_loaded(spark, target).collect()) == list(range(1, 11))


def test_a_cell_is_parsed_once_and_as_its_format_says(spark):
    odd = ["2000-01-02", "2000-1-2", "2000/1/2", "2000/01/02", "2000-02-30", "2000-01-1T", "2000-01-1\t", "+999-01-01", "-999-01-01",
           "0000-01-01", "0999-12-31", "9999-12-31", "12000-1-01", "2000-13-01", "2000-001-2", "2000-01-02T00", "20000102", "x", " 2001-02-03 "]
    rows = spark.createDataFrame([(c, "1", "2", "", "f") for c in odd], "DATE string, Medium string, Large string, `BUYER/SELLER` string, _source string")
    out = feeds.parse(rows, feeds.PRICE)
    cell = F.trim("DATE")
    want = rows.select(F.coalesce(F.try_to_date(cell, "yyyy-M-d"), F.try_to_date(cell, "yyyy/M/d")).cast("string").alias("d")).collect()
    got = out.select(F.col("date").cast("string"), "_reject").collect()
    assert [r.date for r in got] == [r.d for r in want]
    assert [r._reject for r in got] == [None if r.d else "date" for r in want]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp") == 2  # a formatter each


def test_header_and_digest_of_files_against_plain_python(spark):
    src = staging_path(spark, "t-scan")
    texts = {"a.csv": "x,y\n1,2\n", "b.csv": "y,x\n1,2\n", "c.csv": "x,y\n1,2\n", "d.csv": "x,y\n2,1\n1,2\n", "e.csv": "x,y\n1,2\n2,1\n"}
    for name, text in texts.items():
        _write(src, name, text)
    got = {os.path.basename(f): (h, d) for f, h, d in feeds.scan_files(spark, [r.file for r in feeds.list_files(spark, src).collect()])}
    for name, text in texts.items():
        lines = spark.createDataFrame([(v,) for v in text.splitlines()], "value string")
        hashes = lines.select(F.xxhash64("value").alias("a"), F.xxhash64("value", F.lit("second")).alias("b")).collect()
        size = sum(len(v) for v in text.splitlines())
        assert got[name] == (text.splitlines()[0], f"{len(hashes)}-{size}-{sum(r.a for r in hashes)}-{sum(r.b for r in hashes)}")


def test_resync_reads_no_rows_when_nothing_changed(spark, monkeypatch):
    src, target = staging_path(spark, "t-quiet-src"), staging_path(spark, "t-quiet-out")
    _write(src, "s.csv", SURVEY_HEAD + "\n" + SURVEY_LINE.format(muni="Alpha", brgy="Poblacion", first="Ana", middle="Q", last="Cruz"))
    feeds.load_feed(spark, src, feeds.SURVEY, target, lambda good: feeds.curate_survey(good, spark.createDataFrame([], "muni_id string, muni_name string")))
    muni = spark.createDataFrame([("1", "Alpha")], "muni_id string, muni_name string")
    demo = spark.createDataFrame([("7", "Ana", "Q", "Cruz")], "f_id string, f_name string, m_name string, l_name string")
    brgy = spark.createDataFrame([("11", "Poblacion", "1")], "brgy_id string, brgy_name string, muni_id string")
    met, rows_of = [], feeds._rows_of
    monkeypatch.setattr(feeds, "_rows_of", lambda *a: met.append(a[2:]) or rows_of(*a))
    assert len(feeds.resync(spark, target, muni, demo, brgy)) == 1
    assert len(met) == 1  # the municipality touches the only load: barangays and farmers are not met
    assert feeds.resync(spark, target, muni, demo, brgy) == [] and len(met) == 1
    r = feeds.read_loaded(spark, target).first()
    assert (r.raw_municipality, r.raw_barangay, r.f_id) == ("1", "11", "7")


def test_totals_state_is_kept_by_many_tasks(spark):
    src, base = staging_path(spark, "t-tasks-src"), staging_path(spark, "t-tasks")
    paths = stream.StreamPaths(src, f"{base}/out", f"{base}/ckpt")
    _write(src, "a.csv", SURVEY_HEAD + "\nAlpha,b1,Ana,,Cruz,F,1980-02-03,1,100,2000-01-02,,2001-03-04,,R1,,Owner\n")
    q = stream.start_totals_stream(spark, feeds.SURVEY, paths, F.year("raw_dgathered"), "raw_area")
    q.awaitTermination()
    track = spark.sparkContext.statusTracker()
    stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup(str(q.runId)) for s in track.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [(r.key, float(r.total), r.n) for r in stream.read_totals(spark, paths).collect()] == [(2000, 1.0, 1)]


def test_survey_drops_are_the_shares_of_the_feed(spark, make_tables):
    from ananas.plans import jobs
    from tests.conftest import survey_row

    t = make_tables(qp_farmer_raw=[survey_row(logs=i, fname=f"n{i}") for i in (1, 2, 3, 4)])
    drop = staging_path(spark, "t-shares")
    for k in jobs._survey_drops(t, 5, drop):  # share 0 has no row
        names = [r["First Name"] for r in feeds.read_text(spark, f"{drop}/{k}", feeds.SURVEY).collect()]
        assert names == ([f"n{k}"] if k else [])


# ------------------------------------------------------------------ disk of large loads

def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def _gone(spark, before):
    for _ in range(50):  # removal is asynchronous
        if _shuffle_files(spark) <= before:
            return True
        time.sleep(0.2)
    return False


def _survey_files(src, files, rows=4):
    line = lambda k, i: SURVEY_LINE.format(muni="Alpha", brgy=f"b{i}", first=f"n{k}", middle="Q", last=f"l{i}")
    for k in range(files):
        _write(src, f"s{k}.csv", SURVEY_HEAD + "\n" + "".join(line(k, i) for i in range(rows)) + "bad\n")


def _places(spark):
    muni = spark.createDataFrame([("1", "Alpha")], "muni_id string, muni_name string")
    demo = spark.createDataFrame([("7", "n1", "Q", "l1"), ("8", "n2", "Q", "l0")], "f_id string, f_name string, m_name string, l_name string")
    brgy = spark.createDataFrame([("11", "b1", "1")], "brgy_id string, brgy_name string, muni_id string")
    return muni, demo, brgy


def _state(spark, target):
    rows = feeds.read_loaded(spark, target).collect()
    return sorted((r.raw_fname, r.raw_lname, r.raw_municipality, r.raw_barangay, r.f_id or "") for r in rows), sorted(r.logs for r in rows)


def test_a_load_is_curated_in_batches(spark, monkeypatch):
    monkeypatch.setattr(feeds, "BATCH_BYTES", 1, raising=False)
    monkeypatch.setattr(feeds, "STAGED_ROWS", 3, raising=False)
    monkeypatch.setattr(feeds, "BATCHES", 3, raising=False)
    src, target = staging_path(spark, "t-batch-src"), staging_path(spark, "t-batch-out")
    _survey_files(src, 6)
    places, seen = _places(spark), []

    def curate(good):
        seen.append(good.count())
        return feeds.curate_survey(good, *places)

    assert feeds.load_feed(spark, src, feeds.SURVEY, target, curate) == (24, 6)
    assert 1 < len(seen) <= 3 and sum(seen) == 24
    rows, keys = _state(spark, target)
    assert keys == list(range(1, 25))  # as if all were curated at once
    assert rows == sorted((f"n{k}", f"l{i}", "1", "11" if i == 1 else f"b{i}", {(1, 1): "7", (2, 0): "8"}.get((k, i), "")) for k in range(6) for i in range(4))
    assert feeds.read_rejects(spark, target).count() == 6
    assert not any(os.scandir(f"{target}/staged"))


def test_shuffle_files_of_loads_and_resyncs_go_with_their_queries(spark):
    src, target = staging_path(spark, "t-drop-src"), staging_path(spark, "t-drop-out")
    _survey_files(src, 2)
    places = _places(spark)
    was = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    before = _shuffle_files(spark)
    feeds.load_feed(spark, src, feeds.SURVEY, target, lambda good: feeds.curate_survey(good, places[0]))
    assert _gone(spark, before)
    assert len(feeds.resync(spark, target, *places)) == 1
    assert _gone(spark, before)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == was


def test_resync_rewrites_a_load_in_batches_of_its_files(spark, monkeypatch):
    monkeypatch.setattr(feeds, "STAGED_ROWS", 3, raising=False)
    monkeypatch.setattr(feeds, "BATCH_BYTES", 1, raising=False)
    monkeypatch.setattr(feeds, "BATCHES", 3, raising=False)
    src, target = staging_path(spark, "t-rewrite-src"), staging_path(spark, "t-rewrite-out")
    _survey_files(src, 4)
    muni, demo, brgy = _places(spark)
    feeds.load_feed(spark, src, feeds.SURVEY, target, lambda good: feeds.curate_survey(good, muni.limit(0), demo.limit(0), brgy.limit(0)))
    calls, curate = [], feeds.curate_survey
    monkeypatch.setattr(feeds, "curate_survey", lambda *a: calls.append(1) or curate(*a))
    assert len(feeds.resync(spark, target, muni, demo, brgy)) == 1
    assert 1 < len(calls) <= feeds.BATCHES
    rows, keys = _state(spark, target)
    assert keys == list(range(1, 17))
    assert rows == sorted((f"n{k}", f"l{i}", "1", "11" if i == 1 else f"b{i}", {(1, 1): "7", (2, 0): "8"}.get((k, i), "")) for k in range(4) for i in range(4))


def test_the_survey_is_laid_out_in_passes_and_dropped_when_loaded(spark, make_tables, monkeypatch):
    from ananas.plans import area, jobs
    from tests.conftest import survey_row

    keys = [None, None, *range(0, 12_000, 1000)]
    t = make_tables(qp_farmer_raw=[survey_row(logs=k, fname=f"n{i}", muni=str(1 + i % 2)) for i, k in enumerate(keys)])
    t = t.write(staging_path(spark, "t-passes"), files=2)
    monkeypatch.setattr(jobs, "PASS_BYTES", 1, raising=False)
    monkeypatch.setattr(jobs, "PASSES", 2, raising=False)
    made = []
    monkeypatch.setattr(jobs, "staging_path", lambda *a: made.append(staging_path(*a)) or made[-1])
    assert jobs.load_to_area_ranking(t).collect() == area.area_ranking(t).collect()
    src, target = made
    assert feeds.read_loaded(spark, target).count() == len(keys)
    assert not os.path.exists(src)
    names = [r["First Name"] for r in feeds.read_text(spark, jobs._write_survey(t, staging_path(spark, "t-laid")), feeds.SURVEY).collect()]
    assert sorted(names) == sorted(f"n{i}" for i in range(len(keys)))
    made.clear()
    rows = jobs.resync_survey(dataclasses.replace(t, qp_farmer_raw=t.qp_farmer_raw.where("logs is not null"))).collect()
    assert sorted(r.raw_fname for r in rows) == sorted(f"n{i}" for i, k in enumerate(keys) if k is not None)
    assert not os.path.exists(made[0])  # the drop folder; both loads are in the table

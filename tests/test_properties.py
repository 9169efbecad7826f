"""Properties: exact arithmetic against a Decimal model, and rewrites against the plain form."""

from decimal import ROUND_DOWN, ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ananas.functions.exprs import avg_exact, mysql_ratio_pct, round_div, trunc_dec
from ananas.operators.aggregates import flag_counts
from ananas.operators.paging import page
from ananas.plans import farmers, gender
from ananas.plans.common import raw_person
from ananas.session import staging_path
from ananas.sources import feeds


def mysql_pct(num, den, n):
    if den == 0:
        return None
    q = (Decimal(num) / Decimal(den)).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP)
    return (q * 100).quantize(Decimal(1).scaleb(-n), rounding=ROUND_DOWN)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(-10**6, 10**6)), min_size=1, max_size=300))
def test_pct_matches_decimal_model(spark, pairs):
    df = spark.createDataFrame(pairs, "num long, den long")
    got = df.select("num", "den", mysql_ratio_pct("num", "den", 2, 4).alias("p2"), mysql_ratio_pct("num", "den", 1, 4).alias("p1")).collect()
    for r in got:
        assert r.p2 == mysql_pct(r.num, r.den, 2)
        assert r.p1 == mysql_pct(r.num, r.den, 1)


def exact_pct(num, den, n):
    if den == 0:
        return None
    return (Decimal(num) * 100 / Decimal(den)).quantize(Decimal(1).scaleb(-n), rounding=ROUND_DOWN)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(-50, 50)), min_size=1, max_size=300))
def test_exact_rational_pct(spark, pairs):
    df = spark.createDataFrame(pairs, "num long, den long")
    got = df.select("num", "den", mysql_ratio_pct("num", "den", 2, div_scale=None).alias("p")).collect()
    for r in got:
        assert r.p == exact_pct(r.num, r.den, 2)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(min_value=-10**9, max_value=10**9, places=4, allow_nan=False), min_size=1, max_size=300))
def test_truncate_cuts_toward_zero(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x decimal(18,4)")
    for r in df.select("x", trunc_dec("x", 2).alias("t")).collect():
        assert r.t == r.x.quantize(Decimal("0.01"), rounding=ROUND_DOWN)
        assert abs(r.t) <= abs(r.x)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(min_value=-10**6, max_value=10**6, places=2, allow_nan=False), min_size=1, max_size=200))
def test_avg_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x decimal(18,2)")
    got = df.agg(avg_exact("x").alias("a")).collect()[0].a
    want = (sum(values) / Decimal(len(values))).quantize(Decimal("0.000001"), rounding=ROUND_HALF_UP)
    assert got == want


def test_round_div_zero_denominator(spark):
    r = spark.range(1).select(round_div(F.lit(3), F.lit(0), 4).alias("z"), round_div(F.lit(-1), F.lit(8), 2).alias("n")).collect()[0]
    assert r.z is None and r.n == Decimal("-0.13")


def test_two_phase_equals_count_distinct(synthetic):
    q = synthetic.qp_farmer_raw
    reg = F.coalesce(F.col("RBSBA"), F.lit("")) != ""
    two = flag_counts(q, ["raw_municipality"], raw_person("ws"), {"r": reg}).collect()
    plain = q.groupBy("raw_municipality").agg(
        F.count_distinct(F.when(reg, raw_person("ws"))).alias("r"), F.count_distinct(raw_person("ws")).alias("total_num")
    ).collect()
    assert sorted(tuple(r) for r in two) == sorted((r.raw_municipality, r.r, r.total_num) for r in plain)


def test_rollup_total_is_global_distinct(synthetic):
    series = {r.year_: r.count_farmer for r in farmers.farmer_count_series(synthetic).collect()}
    total = farmers.farmer_count_total(synthetic).collect()[0].count_farmer
    assert series["all"] == total
    assert sum(v for k, v in series.items() if k != "all") >= total


def test_men_plus_women_within_all(synthetic):
    for r in gender.gender_by_muni(synthetic).collect():
        assert r.Male + r.Female == r.total
    g = gender.gender_totals(synthetic).collect()[0]
    assert g.Male + g.Female <= synthetic.farmer_demo.count()
    assert g.male_percent + g.female_percent <= Decimal("100.00")


def test_paging_is_a_stable_slice(synthetic):
    full = [r.f_id for r in farmers.farmers_directory(synthetic, "ws").orderBy("f_id").collect()]
    pages = [[r.f_id for r in page(farmers.farmers_directory(synthetic, "ws"), ["f_id"], n, 7).collect()] for n in (1, 2, 3)]
    assert sum(pages, []) == full[:21]
    hits = page(farmers.farmers_directory(synthetic, "ws"), ["f_id"], 1, 50, term="machinery nation_1").collect()
    assert hits and all("MACHINERY" in r.fullname and "NATION_1" in r.municipality for r in hits)


def test_reloading_a_file_adds_nothing(spark):
    import os

    src = staging_path(spark, "t-load-src")
    os.makedirs(src)
    with open(f"{src}/a.csv", "w") as fh:
        fh.write("DATE,Medium,Large,BUYER/SELLER\n2001-01-05,10.50,12.25,Juan\n2001-01-06,x,13.00,\n")
    target = staging_path(spark, "t-load-out")
    assert feeds.load_feed(spark, src, feeds.PRICE, target) == (1, 1)
    assert feeds.load_feed(spark, src, feeds.PRICE, target) == (1, 1)
    with open(f"{src}/b.csv", "w") as fh:
        fh.write("DATE,Medium,Large,BUYER/SELLER\n2001-01-07,1,2,Ana\n")
    assert feeds.load_feed(spark, src, feeds.PRICE, target) == (2, 1)
    assert len({r._source for r in feeds.read_loaded(spark, target).collect()}) == 2


def test_approximate_distinct_is_close(synthetic):
    exact = {r.muni_name: r.farmer_count_per_muni for r in farmers.farmer_count_permuni(synthetic).collect()}
    approx = {r.muni_name: r.farmer_count_per_muni for r in farmers.farmer_count_permuni(synthetic, approx_rsd=0.02).collect()}
    assert set(exact) == set(approx)
    assert all(abs(approx[k] - exact[k]) <= max(2, 0.1 * exact[k]) for k in exact)


_names = st.sampled_from([None, "", "A", "B", "AB"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "1", "2"]), _names, _names, _names, st.sampled_from([None, "", "R", " "])),
                min_size=1, max_size=120))
def test_flag_counts_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "g string, f string, m string, l string, r string")
    person = F.concat_ws("|", "f", "m", "l")
    reg = F.coalesce(F.col("r"), F.lit("")) != ""
    got = {r.g: (r.reg, r.unreg, r.total_num) for r in flag_counts(
        df, ["g"], person, {"reg": reg, "unreg": ~reg}).collect()}

    def key(f, m, l):
        return "|".join(p for p in (f, m, l) if p is not None)

    want = {}
    for g in {row[0] for row in rows}:
        mine = [row for row in rows if row[0] == g]
        regs = {key(*row[1:4]) for row in mine if (row[4] or "") != ""}
        unregs = {key(*row[1:4]) for row in mine if (row[4] or "") == ""}
        want[g] = (len(regs), len(unregs), len({key(*row[1:4]) for row in mine}))
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.integers(-10**6, 10**6)), min_size=1, max_size=300))
def test_number_rows_is_an_ordered_numbering(spark, values):
    from ananas.operators.aggregates import number_rows

    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, tag long")
    out = sorted((r.n, r.v) for r in number_rows(df, "v", "n", buckets=8, salt=4).collect())
    assert [n for n, _ in out] == list(range(1, len(values) + 1))
    order = [(v is not None, v if v is not None else 0) for _, v in out]
    assert order == sorted(order)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1999, 2000]), st.sampled_from([None, "a", "b", "c"])), max_size=60))
def test_total_row_matches_brute_force(spark, rows):
    from ananas.operators.aggregates import with_total_row

    df = spark.createDataFrame(rows, "y long, k string")
    out = {(r.key, r._is_total): r.n for r in with_total_row(
        df, F.col("y"), "key", [F.count_distinct("k").alias("n")]).collect()}
    want = {("all", True): len({k for _, k in rows if k is not None}) if rows else None}
    for y in {y for y, _ in rows}:
        want[(None if y is None else str(y), False)] = len({k for yy, k in rows if yy == y and k is not None})
    assert out == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dates(min_value=__import__("datetime").date(1900, 1, 1), max_value=__import__("datetime").date(2030, 12, 31)),
                min_size=1, max_size=200),
       st.dates(min_value=__import__("datetime").date(1990, 1, 1), max_value=__import__("datetime").date(2030, 12, 31)))
def test_age_is_completed_years(spark, births, as_of):
    from ananas.functions.exprs import age_at

    df = spark.createDataFrame([(b,) for b in births], "b date")
    for r in df.select("b", age_at("b", as_of).alias("age")).collect():
        b = r.b
        want = as_of.year - b.year - ((as_of.month, as_of.day) < (b.month, b.day))
        assert r.age == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.integers(-10**12, 10**12).map(str),
                          st.decimals(min_value=-10**9, max_value=10**9, places=4, allow_nan=False).map(str)),
                min_size=1, max_size=100))
def test_format_currency_matches_the_page_regex(spark, texts):
    import re

    from ananas.functions.exprs import THOUSANDS_PATTERN, format_currency

    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", format_currency("s").alias("out")).collect():
        assert r.out == re.sub(THOUSANDS_PATTERN, r"\1,", r.s)


@settings(max_examples=3, deadline=None)
@given(st.dictionaries(
    st.dates(min_value=__import__("datetime").date(1999, 1, 1), max_value=__import__("datetime").date(2001, 12, 31)),
    st.decimals(min_value=0, max_value=999, places=2, allow_nan=False), min_size=1, max_size=80))
def test_weather_sheets_round_trip(spark, daily):
    from ananas.sources import weather

    df = spark.createDataFrame(sorted(daily.items()), "date date, rain_amount decimal(10,2)")
    path = staging_path(spark, "t-weather-prop")
    weather.write_sheets(df, path)
    good, bad = weather.ingest_weather(spark, path)
    assert sorted((r.date, r.rain_amount) for r in good.collect()) == sorted(daily.items())
    assert bad.count() == 0


_good_date = st.dates(min_value=__import__("datetime").date(1990, 1, 1),
                      max_value=__import__("datetime").date(2030, 12, 31)).map(lambda d: d.isoformat())
_good_num = st.decimals(min_value=-10**6, max_value=10**6, places=2, allow_nan=False).map(str)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.one_of(_good_date, st.sampled_from(["2001-13-01", "x", "2001-02-30"])),
                          st.one_of(_good_num, st.sampled_from(["abc", "1,5"])),
                          _good_num, st.sampled_from(["", "Juan", "Ana, Co"])), min_size=1, max_size=60))
def test_feed_parse_matches_a_model(spark, rows):
    import csv
    import datetime as dt
    import os

    src = staging_path(spark, "t-feed-prop")
    os.makedirs(src)
    with open(f"{src}/p.csv", "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(["DATE", "Medium", "Large", "BUYER/SELLER"])
        w.writerows(rows)
    good, bad = feeds.ingest(spark, src, feeds.PRICE)

    def date_ok(s):
        try:
            dt.date.fromisoformat(s)
            return True
        except ValueError:
            return False

    def num_ok(s):
        try:
            Decimal(s)
            return "," not in s
        except Exception:  # noqa: BLE001
            return False

    want_good = sorted((dt.date.fromisoformat(d), Decimal(m), Decimal(lg), b)
                       for d, m, lg, b in rows if date_ok(d) and num_ok(m))
    got_good = sorted((r.date, r.med_price, r.lg_price, r.buyer_seller) for r in good.collect())
    assert got_good == want_good
    want_bad = sorted(",".join(n for n, ok in (("date", date_ok(d)), ("med_price", num_ok(m))) if not ok)
                      for d, m, _, _ in rows if not (date_ok(d) and num_ok(m)))
    assert sorted(r._reject for r in bad.collect()) == want_bad


_part = st.sampled_from([None, "", "A", "B", "AB"])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(_part, _part, _part), min_size=1, max_size=40),
       st.lists(st.tuples(st.integers(1, 99).map(str), _part, _part, _part), max_size=40))
def test_sync_farmer_id_matches_brute_force(spark, survey, demo):
    from ananas.operators.sync import sync_farmer_id

    s = spark.createDataFrame([("1", *r) for r in survey], "f_id string, raw_fname string, raw_mname string, raw_lname string")
    d = spark.createDataFrame(demo, "f_id string, f_name string, m_name string, l_name string")
    got = sorted((r.raw_fname or "~", r.raw_mname or "~", r.raw_lname or "~", r.f_id)
                 for r in sync_farmer_id(s, d).collect())

    def name(parts):
        return None if any(p is None for p in parts) else "".join(parts)

    best = {}
    for fid, *parts in demo:
        n = name(parts)
        if n is not None:
            best[n] = max(best.get(n, fid), fid)
    want = sorted((f or "~", m or "~", l or "~", best.get(name((f, m, l)), "1")) for f, m, l in survey)
    assert got == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "Pob", "San", "7"]), st.sampled_from([None, "1", "2"])), min_size=1, max_size=40),
       st.lists(st.tuples(st.integers(1, 99).map(str), st.sampled_from(["Pob", "San", "Bay"]), st.sampled_from(["1", "2", "3"])),
                max_size=20))
def test_sync_barangay_matches_brute_force(spark, survey, dim):
    from ananas.operators.sync import sync_barangay_id

    s = spark.createDataFrame(survey, "raw_barangay string, raw_municipality string")
    d = spark.createDataFrame(dim, "brgy_id string, brgy_name string, muni_id string")
    got = sorted(((r.raw_barangay or "~"), (r.raw_municipality or "~")) for r in sync_barangay_id(s, d).collect())
    best = {}
    for bid, bname, mid in dim:
        best[(bname, mid)] = max(best.get((bname, mid), bid), bid)
    want = sorted(((best.get((b, m), b) or "~"), (m or "~")) for b, m in survey)
    assert got == want


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["Ana Cruz", "ben diaz", None, "ANA B"]), st.sampled_from(["Alpha", "beta", None])),
                min_size=1, max_size=40),
       st.sampled_from(["", "ana", "ANA alpha", "z", "cruz  beta"]), st.integers(1, 3), st.integers(1, 7))
def test_search_and_page_match_a_model(spark, rows, term, number, size):
    df = spark.createDataFrame([(i, n, m) for i, (n, m) in enumerate(rows)], "id long, name string, muni string")
    got = [r.id for r in page(df, ["id"], number, size, term).collect()]
    words = term.lower().split()

    def hit(i, n, m):
        cells = [str(i), (n or "").lower(), (m or "").lower()]
        return all(any(w in c for c in cells if c) for w in words)

    found = [i for i, (n, m) in enumerate(rows) if hit(i, n, m)]
    assert got == found[(number - 1) * size: number * size]

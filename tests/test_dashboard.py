"""The page-level compositions and the command line."""

import os

from ananas.__main__ import main
from ananas.plans import dashboard
from ananas.plans.catalog import AS_OF
from ananas.session import staging_path
from ananas.sources.tables import Tables
from tests.conftest import SF_SMALL, survey_row


def test_dashboard_bundle_runs_every_set(spark):
    t = Tables.from_synthetic(spark, SF_SMALL)
    bundle = dashboard.dashboard_bundle(t, AS_OF)
    assert len(bundle) == 21
    sizes = {k: df.count() for k, df in bundle.items()}
    assert sizes["farmer_count"] == sizes["area_count"] - 0 and sizes["farmer_count"] >= 2
    assert sizes["cam_norte_municipality"] == 26 and sizes["donut_data"] == 1
    # the sets that read the survey all read the one cached projection
    survey_sets = ["farmer_count_peryear1", "general_pop1", "qp_area", "rbsba_table", "expected_harvest_table",
                   "pineapple_population", "topproducer", "cam_norte_municipality", "farmer_count", "area_count",
                   "total_expected_harvest", "population_percent"]
    for k in survey_sets:
        assert "InMemoryRelation" in bundle[k]._jdf.queryExecution().optimizedPlan().toString(), k


def test_general_data_totals_is_one_row(synthetic):
    rows = dashboard.general_data_totals(synthetic).collect()
    assert len(rows) == 1 and rows[0].Farmer_ID == synthetic.farmer_demo.count()


def test_cli_curate_report_load(spark, capsys):
    out = staging_path(spark, "t-cli")
    assert main(["curate", "--sf-dir", SF_SMALL, "--out", f"{out}/cur"]) == 0
    assert main(["report", "area_ranking", "--curated", f"{out}/cur", "--out", f"{out}/ar"]) == 0
    assert spark.read.json(f"{out}/ar").count() == 25
    src = f"{out}/drop"
    os.makedirs(src)
    with open(f"{src}/p.csv", "w") as fh:
        fh.write("DATE,Medium,Large,BUYER/SELLER\n2001-01-05,10.50,12.25,Juan\n")
    args = ["load", "--feed", "price", "--source", src, "--target", f"{out}/price"]
    assert main(args) == 0 and main(args) == 0
    assert "accepted 1 rejected 0" in capsys.readouterr().out
    sargs = ["stream", "--feed", "price", "--source", src, "--out", f"{out}/s", "--checkpoint", f"{out}/ck", "--once"]
    assert main(sargs) == 0 and main(sargs) == 0
    assert spark.read.parquet(f"{out}/s/rows").count() == 1


def test_route_bundles_run(synthetic):
    bundles = [
        dashboard.chart_data(synthetic, AS_OF), dashboard.farmer_count_api(synthetic),
        dashboard.farmer_age_api(synthetic, AS_OF), dashboard.farmer_permuni_api(synthetic),
        dashboard.farmer_permuni_api(synthetic, "NATION_3"),
        dashboard.harvest_api(synthetic, AS_OF, "NATION_3", 2000),
    ]
    sizes = {k: df.count() for b in bundles for k, df in b.items()}
    assert len(sizes) == 10 + 3 + 2 + 2 + 1 + 10 - 0
    assert all(n > 0 for n in sizes.values())


def test_muni_dashboard_unknown_name_is_zero(synthetic):
    row = dashboard.muni_dashboard(synthetic, "Nowhere").collect()[0]
    assert (row.farmer_count, row.area_count) == (0, 0)


def test_cli_report_takes_the_clock(spark, capsys):
    import datetime as dt

    from ananas.plans import population

    out = staging_path(spark, "t-cli-clock")
    assert main(["curate", "--sf-dir", SF_SMALL, "--out", f"{out}/cur"]) == 0
    capsys.readouterr()
    assert main(["report", "expected_harvest_total", "--curated", f"{out}/cur", "--as-of", "1998-03-01"]) == 0
    printed = capsys.readouterr().out
    want = population.expected_harvest_total(Tables.from_synthetic(spark, SF_SMALL), dt.date(1998, 3, 1)).collect()[0]
    assert f"'expected_harvest': {want.expected_harvest}" in printed


# ------------------------------------------------------------------ the figures in one result

def _long_of(bundle):
    """Long rows from the page's own result sets."""
    from ananas.plans import figures

    shape = {
        "area_ranking": ("qp_area", "muni_name", None), "area_count": ("area_count", None, "year_"), "general_pop": ("general_pop1", None, "year_gathered"),
        "pineapple_population": ("pineapple_population", "muni_name", "year_gathered"), "topproducer": ("topproducer", "muni_name", None),
        "expected_harvest_table": ("expected_harvest_table", "muni_name", None), "total_expected_harvest": ("total_expected_harvest", None, None),
        "population_percent": ("population_percent", "muni_name", None), "farmer_count": ("farmer_count", None, "year_"),
        "farmer_count_peryear": ("farmer_count_peryear1", None, "year_gathered"), "rbsba_table": ("rbsba_table", "muni_name", None),
        "gender_data": ("gender_data", "f_municipality", None), "donut_data": ("donut_data", None, None), "harvest_count": ("harvest_count", None, "year_"),
        "qp_price": ("qp_price", None, "year_"),
    }
    leave = {"general_pop": {"year_gathereds", "quarters"}, "population_percent": {"pop_year1", "pop_year2"}}
    out = []
    for report, (name, place, period) in shape.items():
        for r in bundle[name].collect():
            text = lambda c: None if c is None or r[c] is None else str(r[c])
            for m in r.asDict():
                if m not in (place, period) and m not in leave.get(report, ()):
                    out.append((report, text(place), text(period), m, None if r[m] is None else round(float(r[m]), 6)))
    assert figures.COLUMNS == ("report", "place", "period", "measure", "value")
    return sorted(out, key=repr)


def _rows(df):
    return sorted(((r.report, r.place, r.period, r.measure, None if r.value is None else round(float(r.value), 6)) for r in df.collect()), key=repr)


def test_dashboard_long_equals_the_bundle(make_tables):
    from ananas.plans import figures

    survey = [
        survey_row(logs=1), survey_row(logs=2, fname="B", gathered="2000-06-01"), survey_row(logs=3, fname="A", gathered="1999-01-01", rbsba=""),
        survey_row(logs=4, mname=None, muni="2", gathered=None), survey_row(logs=5, mname=None, fname="AM", lname="Z", muni="2", rbsba=None, gathered="1999-05-01"),
        survey_row(logs=6, muni="77", area=None, pop=None), survey_row(logs=7, muni=None, fname="Q"), survey_row(logs=8, muni="9", area="-1.5555", pop=None, gathered="2000-01-01"),
        survey_row(logs=9, muni="9", pop=0, gathered="1999-01-01", rbsba=""), survey_row(logs=10, muni="10", harvest=None, fname=None),
        survey_row(logs=11, muni="10", harvest="2001-12-31", rbsba=""), survey_row(logs=12, fname="A", mname="MZ", lname="", muni="1"),
    ]
    for rows in (survey, []):
        t = make_tables(qp_farmer_raw=rows)
        got = _rows(figures.dashboard_long(t, AS_OF))
        assert got == _long_of(dashboard.dashboard_bundle(t, AS_OF, cache=False))


def test_dashboard_long_scans_the_survey_once(spark):
    from ananas.plans import figures

    t = Tables.from_synthetic(spark, SF_SMALL).write(staging_path(spark, "figures"))
    plan = figures.dashboard_long(t, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/qp_farmer_raw]") == 1 and "CartesianProduct" not in plan


def test_dashboard_page_has_every_set(synthetic):
    bundle, page = dashboard.dashboard_bundle(synthetic, AS_OF, cache=False), dashboard.dashboard_page(synthetic, AS_OF)
    assert len({r.report for r in page["figures"].select("report").distinct().collect()}) + len(page) - 1 == len(bundle) == 21
    for name in set(page) - {"figures"}:
        assert page[name].columns == bundle[name].columns

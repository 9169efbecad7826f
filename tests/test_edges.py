"""Hand-made rows for the rules the synthetic tables cannot show (FIXTURES.md section 4)."""

import datetime as dt
from decimal import Decimal

from ananas.plans import area, farmers, gender, market, population, registration
from tests.conftest import D, survey_row as R

AS_OF = dt.date(2001, 6, 30)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_null_middle_name_strict_skips_ws_counts(make_tables):
    t = make_tables(qp_farmer_raw=[R(fname="A", mname=None, lname="B"), R(fname="C", mname="D", lname="E")])
    assert rows(farmers.farmer_count_total(t)) == [(1,)]
    assert rows(farmers.farmer_count_permuni(t)) == [(2, "Alpha")]


def test_key_collision(make_tables):
    t = make_tables(qp_farmer_raw=[R(fname="AB", mname="C", lname="D"), R(fname="A", mname="BC", lname="D")])
    assert rows(farmers.farmer_count_total(t)) == [(1,)]
    assert rows(farmers.farmer_count_permuni(t)) == [(2, "Alpha")]


def test_one_sided_municipality(make_tables):
    t = make_tables(qp_farmer_raw=[
        R(fname="A", muni="1", rbsba="R"), R(fname="B", muni="1", rbsba=""),
        R(fname="C", muni="2", rbsba="R"),  # Beta: registered only
    ])
    assert [r.muni_name for r in registration.rbsba_table(t).collect()] == ["Alpha"]
    assert [r.muni_name for r in registration.rbsba_per_muni(t).collect()] == ["Alpha"]
    assert sorted(r.muni_name for r in registration.rbsba_percent_by_muni(t).collect()) == ["Alpha", "Beta"]
    kept = {r.muni_name: (r.rbsba_registered, r.rbsba_unregistered) for r in registration.rbsba_table(t, require_all=False).collect()}
    assert kept == {"Alpha": (1, 1), "Beta": (1, 0)}


def test_one_sided_year(make_tables):
    t = make_tables(qp_farmer_raw=[
        R(fname="A", gender="M", gathered="2000-01-01"), R(fname="B", gender="F", gathered="2000-05-01"),
        R(fname="C", gender="M", gathered="1999-01-01"),
    ])
    assert rows(gender.gender_line(t)) == [(2000, 1, 1)]
    assert rows(gender.gender_line(t, require_all=False)) == [(1999, 1, 0), (2000, 1, 1)]


def test_person_on_both_sides(make_tables):
    t = make_tables(qp_farmer_raw=[R(fname="A", rbsba="R"), R(fname="A", rbsba=None), R(fname="B", rbsba="")])
    assert rows(registration.rbsba_status(t)) == [(2, 1)]
    r = registration.rbsba_percent_by_muni(t).collect()[0]
    assert (r.registered_count, r.total_num) == (1, 2)
    assert r.registered == Decimal("50.0")


def test_null_year(make_tables):
    t = make_tables(qp_farmer_raw=[
        R(fname="A", gathered=None, rbsba="R"), R(fname="B", gathered=None, rbsba=""),
        R(fname="C", gathered="2000-01-01", rbsba="R"), R(fname="D", gathered="2000-01-01", rbsba=""),
    ])
    by_year = dict((r.year_, r.count_farmer) for r in farmers.farmer_count_by_year(t).collect())
    assert by_year == {None: 2, 2000: 2}
    assert [r.year_dg1 for r in registration.rbsba_by_year(t).collect()] == [2000]


def test_classification_base_and_missing_class(make_tables):
    t = make_tables(qp_farmer_raw=[
        R(fname="A", muni="1", tenurial=""), R(fname="B", muni="1", tenurial="Tenant"),
        R(fname="C", muni="1", tenurial=None),
        R(fname="D", muni="2", tenurial="Owner"),  # no blank tenurial: Beta absent
    ])
    out = farmers.farmer_classification(t).collect()
    assert [r.muni_name for r in out] == ["Alpha"]
    r = out[0]
    assert (r.all_, r.tenant, r.owner, r.renting) == (2, 1, None, None)


def test_population_change_rules(make_tables):
    t = make_tables(qp_farmer_raw=[
        R(muni="1", pop=5, gathered="2000-02-01"), R(muni="1", pop=7, gathered="1999-02-01"),  # 7 -> 5
        R(muni="2", pop=4, gathered="2000-02-01"), R(muni="2", pop=0, gathered="1999-02-01"),  # zero base
        R(muni="9", pop=3, gathered="2000-02-01"), R(muni="9", pop=3, gathered="1999-02-01"),  # equal
        R(muni="10", pop=3, gathered="2000-02-01"),  # one year only: absent
    ])
    out = {r.muni_name: r for r in population.population_change(t, AS_OF).collect()}
    assert set(out) == {"Alpha", "Beta", "Nine"}
    assert out["Alpha"].change_pop == Decimal("-28.57")
    assert out["Alpha"].diff_pop == -2 and (out["Alpha"].pop_year1, out["Alpha"].pop_year2) == (2000, 1999)
    assert out["Beta"].change_pop is None
    disp = {r.muni_name: r for r in population.population_change_display(t, AS_OF).collect()}
    assert (disp["Nine"].direction, disp["Nine"].status) == ("down", "Increased")
    assert (disp["Alpha"].direction, disp["Alpha"].status) == ("down", "Decreased")
    assert disp["Beta"].direction == "down"  # NULL change counts as 0


def test_percentages_two_of_three(make_tables):
    t = make_tables(qp_farmer_raw=[R(fname="A", rbsba="R"), R(fname="B", rbsba="R"), R(fname="C", rbsba="")])
    r = registration.rbsba_table(t).collect()[0]
    # the exact ratio is cut: 66.66; a quotient rounded to 4 places first gives 66.67
    assert (r.registred_percentage, r.unregistred_percentage) == (Decimal("66.66"), Decimal("33.33"))
    r2 = registration.rbsba_table(t, div_scale=4).collect()[0]
    assert (r2.registred_percentage, r2.unregistred_percentage) == (Decimal("66.67"), Decimal("33.33"))


def test_gender_totals_empty_and_partial(make_tables):
    t = make_tables()
    assert rows(gender.gender_totals(t)) == [(None, None, None, None)]
    t = make_tables(farmer_demo=[("1", "A", "B", "C", None, None, "1", "0")])
    assert rows(gender.gender_totals(t)) == [(None, None, None, None)]
    t = make_tables(farmer_demo=[(str(i), "A", "B", "C", g, None, "1", "0") for i, g in enumerate("MMF")])
    assert rows(gender.gender_totals(t)) == [(2, 1, Decimal("66.66"), Decimal("33.33"))]


def test_unmatched_municipality(make_tables):
    t = make_tables(qp_farmer_raw=[
        R(fname="A", muni="1", gathered="2000-01-01", area="1.0000"),
        R(fname="B", muni="77", gathered="2000-01-01", area="2.0000"),
    ])
    assert rows(farmers.farmer_count_by_year(t)) == [(2, 2000)]
    assert rows(farmers.farmer_count_peryear(t)) == [(1, 2000)]
    out = {r.muni_name: r.sum_area_year for r in area.area_all(t, AS_OF).collect()}
    assert out == {"Alpha": D("1.00"), "A Camarines Norte": D("3.00")}


def test_ids_sort_as_numbers(make_tables):
    t = make_tables(qp_farmer_raw=[R(muni="10"), R(muni="9"), R(muni="2")])
    assert [r.muni_name for r in population.population_by_muni_year(t).collect()] == ["Beta", "Nine", "Ten"]
    assert [r.muni_select for r in market.municipality_picklist(t).collect()] == ["Camarines Norte", "Beta", "Nine", "Ten"]


def test_picklist_orders_by_id_length_then_name(make_tables):
    muni = [("10", "Zeta"), ("11", "Alpha"), ("9", "Omega")]
    t = make_tables(tbl_muni=muni, qp_farmer_raw=[R(muni="10"), R(muni="11"), R(muni="9"), R(muni="")])
    assert [r.muni_select for r in market.municipality_picklist(t).collect()] == ["Camarines Norte", "Omega", "Alpha", "Zeta"]


def test_truncate_cuts_toward_zero(make_tables):
    t = make_tables(qp_farmer_raw=[R(area="-1.2399", gathered="2000-01-01"), R(area="0.0050", gathered="2001-01-01")])
    by_year = {r.year_: r.Area_count for r in area.area_by_year(t).collect()}
    assert by_year == {2000: D("-1.23"), 2001: D("0.00")}
    assert rows(area.area_total(t)) == [(D("-1.23"),)]


def test_series_total_is_not_sum_of_years(make_tables):
    t = make_tables(qp_farmer_raw=[R(fname="A", gathered="2000-01-01"), R(fname="A", gathered="1999-01-01")])
    out = rows(farmers.farmer_count_series(t))
    assert out == [(1, "all"), (1, "1999"), (1, "2000")]
    empty = make_tables()
    assert rows(area.area_series(empty)) == [(D("0.00"), "all")]


def test_age_bands_zero_filled(make_tables):
    fd = [("1", "A", "B", "C", "F", dt.date(1980, 7, 1), "1", "0"),  # 20 at as_of (birthday after)
          ("2", "A", "B", "C", "M", dt.date(1975, 6, 30), "1", "0"),  # 26 exactly on as_of
          ("3", "A", "B", "C", "M", dt.date(1910, 1, 1), "1", "0")]  # 91: only in the male report
    t = make_tables(farmer_demo=fd)
    bands = rows(gender.age_bands(t, AS_OF))
    assert bands[0] == (1, "<=25") and bands[1] == (1, "26-35") and len(bands) == 7
    assert sum(c for c, _ in bands) == 2
    assert rows(gender.age_stacked(t, AS_OF, "M")) == [(1, "26-35", "M"), (1, "86-95", "M")]
    assert rows(gender.age_stacked(t, AS_OF, "F")) == [(1, "<=25", "F")]


def test_pest_numbering_matches_plain_window(make_tables, spark):
    import random

    random.seed(7)
    ids = random.sample(range(1, 10_000), 500)
    t = make_tables(pests=[(i, "Pests" if i % 3 else "Weeds", f"n{i}", "d", 1.0, 1) for i in ids])
    got = [(r.count_, r.name) for r in market.pest_list(t, "Pests", buckets=16).collect()]
    want = [(k + 1, f"n{i}") for k, i in enumerate(sorted(i for i in ids if i % 3))]
    assert got == want


def test_numbering_spreads_a_hot_value(spark):
    from ananas.operators.aggregates import number_rows

    # one value holds half of the rows: it is salted over sub-buckets
    data = [(7, f"hot{i}") for i in range(600)] + [(i, f"v{i}") for i in range(1, 601) if i != 7]
    df = spark.createDataFrame(data, "id long, name string")
    out = sorted((r.row_number, r.id) for r in number_rows(df, "id", buckets=16, salt=8).collect())
    assert [n for n, _ in out] == list(range(1, len(data) + 1))
    assert [i for _, i in out] == sorted(i for i, _ in data)


def test_collation_makes_names_case_insensitive(make_tables):
    rows_ = [R(fname="Ana", mname="M", lname="Cruz"), R(fname="ANA", mname="m", lname="cruz")]
    t = make_tables(qp_farmer_raw=rows_)
    assert rows(farmers.farmer_count_total(t)) == [(2,)]
    ci = t.with_collation("UTF8_LCASE")
    assert rows(farmers.farmer_count_total(ci)) == [(1,)]
    assert rows(farmers.farmer_count_permuni(ci)) == [(1, "Alpha")]
    assert rows(farmers.muni_farmer_count(ci, "alpha")) == [(0,)]  # farmer_demo is empty here
    assert rows(area.muni_area_total(ci, "ALPHA")) == [(D("2.00"),)]
    assert [r.muni_select for r in market.municipality_picklist(ci).collect()] == ["Camarines Norte", "Alpha"]


def test_numbering_puts_nulls_first(spark):
    from ananas.operators.aggregates import number_rows

    data = [(None, f"n{i}") for i in range(50)] + [(i, f"v{i}") for i in range(1, 101)]
    df = spark.createDataFrame(data, "id long, name string")
    out = sorted((r.row_number, r.id) for r in number_rows(df, "id", buckets=8, salt=4).collect())
    assert [n for n, _ in out] == list(range(1, 151))
    assert all(i is None for _, i in out[:50]) and [i for _, i in out[50:]] == list(range(1, 101))


def test_accent_insensitive_collation(make_tables):
    t = make_tables(qp_farmer_raw=[R(fname="José", mname="M", lname="Cruz"), R(fname="JOSE", mname="m", lname="cruz")])
    assert rows(farmers.farmer_count_total(t.with_collation("UTF8_LCASE"))) == [(2,)]
    assert rows(farmers.farmer_count_total(t.with_collation("UNICODE_CI_AI"))) == [(1,)]


def test_validate_names_missing_and_mistyped_columns(make_tables, spark):
    import pytest

    t = make_tables()
    assert t.validate() is t
    bad = make_tables()
    bad.qp_price = bad.qp_price.drop("lg_price").withColumn("date", bad.qp_price["date"].cast("string"))
    with pytest.raises(ValueError, match=r"qp_price.date is string, expected date; qp_price.lg_price is missing"):
        bad.validate()

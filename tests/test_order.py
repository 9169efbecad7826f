"""Row order: each report comes out in the order of the reference's ORDER BY.

The oracle compares multisets, so order is checked here, on sf0.001."""

import datetime as dt

import pytest

from ananas.plans.catalog import reports

AS_OF = dt.date(2001, 6, 30)
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]


def asc(v):
    return (v is not None, v)  # NULLs first, as MySQL and Spark sort ascending


def desc(v):
    return (v is None, -v if v is not None else 0)  # NULLs last when descending


ORDER = {
    "general_population_by_quarter": lambda r: (asc(r.year_gathereds), asc(r.quarters)),
    "area_all": lambda r: (r.muni_name, r.year_gathered),
    "area_ranking": lambda r: desc(r.sum_area),
    "expected_harvest_ranked": lambda r: desc(r.expected_harvest),
    "farmer_count_permuni": lambda r: r.farmer_count_per_muni,
    "farmer_count_peryear": lambda r: asc(r.year_gathered),
    "farmer_count_by_year": lambda r: asc(r.year_),
    "harvest_by_muni_year": lambda r: (r.Municipality, r.year_gathered_1),
    "rbsba_percent_by_muni": lambda r: r.muni_name,
    "rbsba_table": lambda r: r.muni_name,
    "farmer_classification": lambda r: r.muni_name,
    "rbsba_per_muni": lambda r: (desc(r.rbsba_registered), r.muni_name),
    "rbsba_by_year": lambda r: r.year_dg1,
    "gender_line": lambda r: r.year_dg,
    "gender_by_muni": lambda r: asc(r.total),
    "area_by_year": lambda r: asc(r.year_),
    "harvest_by_year": lambda r: asc(r.year_),
    "rain_by_year": lambda r: asc(r.year_date),
    "price_line": lambda r: asc(r.year_gathered),
    "price_by_year": lambda r: desc(r.year_),
    "general_data_price": lambda r: asc(r.year_),
    "top_producer": lambda r: desc(r.population),
    "population_change": lambda r: desc(r.change_pop),
    "harvest_by_quarter": lambda r: (r.Municipality, r.year_gathereds, r.quarters),
    "muni_harvest_by_year": lambda r: r.year_gathered_1,
    "harvest_by_month": lambda r: (r.Municipality, MONTHS.index(r.month_gathered)),
    "expected_harvest_by_month": lambda r: MONTHS.index(next(m for m in MONTHS if m.startswith(r.date_harvest))),
    "survey_directory": lambda r: r.logs,
    "pest_list": lambda r: r.count_,
    "disease_list": lambda r: r.count_,
    "weed_list": lambda r: r.count_,
}


@pytest.mark.parametrize("name", sorted(ORDER))
def test_rows_come_in_reference_order(synthetic, name):
    rows = reports()[name](synthetic).collect()
    keys = [ORDER[name](r) for r in rows]
    assert len(rows) > 1 and keys == sorted(keys)


@pytest.mark.parametrize("name", ["farmer_count_series", "area_series", "harvest_series"])
def test_series_start_with_the_total(synthetic, name):
    years = [r.year_ for r in reports()[name](synthetic).collect()]
    assert years[0] == "all" and years[1:] == sorted(years[1:], key=lambda y: (y is not None, y))


@pytest.mark.parametrize("name", ["area_ranking", "expected_harvest_ranked", "pest_list"])
def test_numbers_are_one_to_n(synthetic, name):
    col = {"area_ranking": "area_rank", "expected_harvest_ranked": "ranking", "pest_list": "count_"}[name]
    got = [r[col] for r in reports()[name](synthetic).collect()]
    assert got == list(range(1, len(got) + 1))

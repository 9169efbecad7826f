"""Plan shape: what Catalyst is asked to do, checked on the physical plans."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from ananas.plans import area, farmers, gender, harvest, market, population, registration
from ananas.plans.catalog import AS_OF, reports
from ananas.session import staging_path
from ananas.sources.tables import Tables
from tests.conftest import SF_SMALL


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def curated(spark):
    t = Tables.from_synthetic(spark, SF_SMALL)
    return t.write(staging_path(spark, "curated"))


@pytest.mark.parametrize("name", sorted(reports()))
def test_no_cartesian_product(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("fn", [
    registration.rbsba_table, registration.rbsba_by_year, registration.rbsba_status, registration.rbsba_per_muni,
    registration.rbsba_percent_by_muni, gender.gender_line, farmers.farmer_classification,
])
def test_flag_counts_have_no_expand(synthetic, fn):
    assert "Expand" not in plan(fn(synthetic))


@pytest.mark.parametrize("fn", [
    farmers.farmer_count_series, area.area_series, harvest.harvest_series, lambda t: area.area_all(t, AS_OF),
])
def test_totals_do_not_expand_raw_rows(curated, fn):
    """Each Expand reads an exchange or aggregate, never the scan."""
    tree = fn(curated)._jdf.queryExecution().sparkPlan().toString()
    lines = tree.splitlines()
    for i, line in enumerate(lines):
        if "Expand" in line:
            below = [x for x in lines[i + 1 :] if len(x) - len(x.lstrip(" :+-*")) > len(line) - len(line.lstrip(" :+-*"))]
            first = next(x for x in below if "Project" not in x)
            assert "Aggregate" in first or "Join" in first, tree


def _survey_scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("/qp_farmer_raw]")


@pytest.mark.parametrize("fn", [
    lambda t: area.area_all(t, AS_OF), lambda t: population.population_change(t, AS_OF),
    registration.rbsba_table, farmers.farmer_classification, gender.gender_line,
])
def test_one_survey_scan(curated, fn):
    assert _survey_scans(fn(curated)) == 1


def test_year_filter_reaches_the_scan(curated):
    p = plan(population.expected_harvest_total(curated, AS_OF))
    assert "PushedFilters: [IsNotNull(raw_dharvest), GreaterThanOrEqual(raw_dharvest,2001-01-01), LessThan(raw_dharvest,2002-01-01)]" in p


def test_scan_reads_only_needed_columns(curated):
    p = plan(area.area_total(curated))
    assert "ReadSchema: struct<raw_area:decimal(18,4)>" in p


def test_dimension_join_is_broadcast(curated):
    p = plan(area.area_ranking(curated))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_pest_numbering_window_is_partitioned(curated):
    p = plan(market.pest_list(curated, "Pests"))
    # rows are numbered by a window partitioned by bucket; the only unpartitioned
    # window is the running total over per-bucket counts
    assert "row_number() windowspecdefinition(_bucket" in p
    assert "BroadcastHashJoin" in p

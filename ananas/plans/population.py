"""Plant population and expected harvest (PO1-PO5, HV1-HV4).

Population sums are whole numbers (bigint). "This year" is the calendar
year of the explicit ``as_of`` date, turned into a date range so both
bounds reach the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.functions.exprs import (
    change_direction,
    change_status,
    format_currency,
    id_sort_key,
    in_year,
    in_years,
    mysql_ratio_pct,
    short_month,
    year_of,
)
from ananas.operators.aggregates import rank_small
from ananas.plans.common import PROVINCE_NAME, named_muni, survey_with_muni
from ananas.sources.tables import Tables


def _pop(alias: str = "population"):
    return F.sum("raw_population").cast("long").alias(alias)


def population_by_muni_year(t: Tables) -> DataFrame:
    """PO1: population per municipality and year; ids sort as numbers."""
    g = t.qp_farmer_raw.groupBy(year_of("raw_dgathered").alias("year_gathered"), "raw_municipality").agg(_pop())
    return named_muni(t, g).orderBy(*id_sort_key("raw_municipality"), "year_gathered").select("population", "year_gathered", "muni_name")


def population_by_barangay_year(t: Tables, muni_name: str) -> DataFrame:
    """PO2: population per barangay and year within one municipality.

    Aggregated to (year, barangay id) before the barangay names are joined:
    the barangay list may be too large to broadcast, and then only the
    aggregates are shuffled for the join, not the survey rows."""
    j = survey_with_muni(t, "raw_population", "raw_dgathered", "raw_barangay").where(
        F.col("muni_name") == F.lit(muni_name)
    )
    g = j.groupBy(year_of("raw_dgathered").alias("year_gathered"), "raw_barangay").agg(_pop())
    b = t.barangay.select("brgy_id", "brgy_name")
    named = g.join(b, F.col("raw_barangay") == F.col("brgy_id"), "inner")
    return named.orderBy(*id_sort_key("raw_barangay"), "year_gathered").select("population", "year_gathered", "brgy_name")


def population_drilldown(t: Tables, place: str, province: str = PROVINCE_NAME) -> DataFrame:
    """The chart route: the province gives PO1, a municipality name PO2."""
    if place == province:
        return population_by_muni_year(t)
    return population_by_barangay_year(t, place)


def general_population_by_quarter(t: Tables) -> DataFrame:
    """PO3: population per calendar quarter, labelled "2020 Q 1"."""
    q = t.qp_farmer_raw
    d = F.col("raw_dgathered")
    g = q.groupBy(year_of(d).alias("year_gathereds"), F.quarter(d).cast("long").alias("quarters")).agg(
        _pop(), F.min(d).alias("_first")
    )
    label = F.concat(F.year("_first").cast("string"), F.lit(" Q "), F.quarter("_first").cast("string"))
    return g.orderBy("_first").select("population", "year_gathereds", "quarters", label.alias("year_gathered"))


def population_change(t: Tables, as_of: dt.date, div_scale: int | None = None) -> DataFrame:
    """PO4: last year's population against the year before, per municipality.

    One scan of the two years with conditional sums; a municipality needs
    rows in both years (the reference's inner joins). ``change_pop`` is
    ``TRUNCATE((pop1 - pop2) / NULLIF(pop2, 0) * 100, 2)``.
    """
    y1, y2 = as_of.year - 1, as_of.year - 2
    q = t.qp_farmer_raw.where(in_years("raw_dgathered", y2, y1))
    is1 = in_year("raw_dgathered", y1)
    g = q.groupBy("raw_municipality").agg(
        F.sum(F.when(is1, F.col("raw_population"))).cast("long").alias("pop1"),
        F.sum(F.when(~is1, F.col("raw_population"))).cast("long").alias("pop2"),
        F.count(F.when(is1, 1)).alias("_n1"),
        F.count(F.when(~is1, 1)).alias("_n2"),
    ).where((F.col("_n1") > 0) & (F.col("_n2") > 0))
    j = g.join(t.muni, F.col("raw_municipality") == F.col("muni_id"), "inner")
    diff = F.col("pop1") - F.col("pop2")
    return j.select(
        mysql_ratio_pct(diff, "pop2", 2, div_scale).alias("change_pop"),
        "muni_name", "pop1", "pop2", diff.alias("diff_pop"),
        F.lit(y1).cast("long").alias("pop_year1"), F.lit(y2).cast("long").alias("pop_year2"),
    ).orderBy(F.col("change_pop").desc(), "muni_name")


def population_change_display(t: Tables, as_of: dt.date, as_text: bool = False) -> DataFrame:
    """PO4 with the page's display rules: direction of the change (``<= 0``
    is down), status (``pop1 < pop2`` is Decreased) and thousands separators."""
    p = population_change(t, as_of)
    return p.select(
        "muni_name", "change_pop",
        change_direction("change_pop").alias("direction"),
        change_status("pop1", "pop2", as_text).alias("status"),
        format_currency("pop1").alias("pop1_text"),
        format_currency("pop2").alias("pop2_text"),
        format_currency("diff_pop").alias("diff_text"),
    )


def top_producer(t: Tables, top: int | None = None) -> DataFrame:
    """PO5: population per municipality, largest first; ``top`` keeps the
    first rows (the page shows row 0)."""
    g = t.qp_farmer_raw.groupBy("raw_municipality").agg(_pop())
    out = named_muni(t, g).select("population", "muni_name").orderBy(F.col("population").desc(), "muni_name")
    return out.limit(top) if top else out


def expected_harvest_total(t: Tables, as_of: dt.date) -> DataFrame:
    """HV1: plants due for harvest this calendar year."""
    q = t.qp_farmer_raw.where(in_year("raw_dharvest", as_of.year))
    return q.agg(_pop("expected_harvest"))


def expected_harvest_by_muni(t: Tables, as_of: dt.date) -> DataFrame:
    """HV2: HV1 per municipality (``expected_harvest, municipality``)."""
    q = t.qp_farmer_raw.where(in_year("raw_dharvest", as_of.year))
    g = q.groupBy("raw_municipality").agg(_pop("expected_harvest"))
    return named_muni(t, g).select("expected_harvest", F.col("muni_name").alias("municipality"))


def expected_harvest_ranked(t: Tables, as_of: dt.date) -> DataFrame:
    """HV3: HV2 ranked, largest first (ties by name)."""
    e = expected_harvest_by_muni(t, as_of).withColumnRenamed("municipality", "muni_name")
    order = [F.col("expected_harvest").desc(), F.col("muni_name")]
    return rank_small(e, order, "ranking").orderBy(*order)


def expected_harvest_by_month(t: Tables, as_of: dt.date) -> DataFrame:
    """HV4: HV1 per month of harvest, labelled Jan, Feb, ... in month order."""
    q = t.qp_farmer_raw.where(in_year("raw_dharvest", as_of.year))
    d = F.col("raw_dharvest")
    g = q.groupBy(F.month(d).alias("_m")).agg(_pop("expected_harvest"), F.min(short_month(d)).alias("date_harvest"))
    return g.orderBy("_m").select("expected_harvest", "date_harvest")

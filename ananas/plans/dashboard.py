"""Pages that combine several reports (DB1, DB2)."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.operators.aggregates import collect_scalars
from ananas.plans import area, farmers, figures, gender, harvest, market, population, registration
from ananas.sources.tables import Tables


def general_data_totals(t: Tables) -> DataFrame:
    """DB1 scalars in one row: registered farmers, total area, total
    production. Three global aggregates folded together without a cross join."""
    return collect_scalars([
        t.farmer_demo.agg(F.count(F.lit(1)).alias("Farmer_ID")),
        area.area_total(t),
        harvest.harvest_total(t),
    ])


def muni_dashboard(t: Tables, muni_name: str) -> DataFrame:
    """The municipality page: registered farmers and total area of one
    municipality in one row, 0 when there is none (the page's ``?? 0``)."""
    parts = collect_scalars([farmers.muni_farmer_count(t, muni_name), area.muni_area_total(t, muni_name)])
    return parts.select(
        F.coalesce("Farmer_ID", F.lit(0)).cast("long").alias("farmer_count"),
        F.coalesce("Area_count", F.lit(0).cast("decimal(38,2)")).alias("area_count"),
    )


def chart_data(t: Tables, as_of: dt.date) -> dict[str, DataFrame]:
    """The chart-data route: ten result sets for the province charts."""
    return {
        "pineapple_population": population.population_by_muni_year(t),
        "harvest_permuni": harvest.harvest_by_muni_year(t),
        "general_pop": population.general_population_by_quarter(t),
        "rbsba_per_year": registration.rbsba_by_year(t),
        "gender_line": gender.gender_line(t),
        "area_line": area.area_by_year(t, ("sum_area_year", "year_gathered")),
        "area_all": area.area_all(t, as_of),
        "female_age_stacked": gender.age_stacked(t, as_of, "F"),
        "male_age_stacked": gender.age_stacked(t, as_of, "M"),
        "rbsba_per_muni": registration.rbsba_per_muni(t),
    }


def farmer_count_api(t: Tables) -> dict[str, DataFrame]:
    """Registered farmers per municipality, registration shares, total."""
    return {
        "qp_farmer_count": farmers.qp_farmer_count(t),
        "rbsba_percent": registration.rbsba_percent_by_muni(t),
        "total": farmers.demo_farmer_total(t),
    }


def farmer_age_api(t: Tables, as_of: dt.date) -> dict[str, DataFrame]:
    """Age bands and the registration totals."""
    return {"qp_farmer_age": gender.age_bands(t, as_of), "rbsba_status": registration.rbsba_status(t)}


def farmer_permuni_api(t: Tables, muni_name: str | None = None) -> dict[str, DataFrame]:
    """Distinct farmers per municipality and per year, or per year for one municipality."""
    if muni_name is not None:
        return {"farmer_count_peryear_permuni": farmers.farmer_count_peryear_permuni(t, muni_name)}
    return {
        "farmer_count_permuni": farmers.farmer_count_permuni(t),
        "farmer_count_peryear": farmers.farmer_count_peryear(t),
    }


def harvest_api(t: Tables, as_of: dt.date, municipality: str | None = None, year: int | None = None) -> dict[str, DataFrame]:
    """Harvest routes: by quarter (all municipalities), by year for one
    municipality, by month for one year; prices and expected harvest."""
    out = {
        "qp_harvest": harvest.harvest_by_quarter(t, as_of),
        "price": market.price_line(t),
        "pie_data": population.expected_harvest_by_muni(t, as_of),
        "line_expected_harvest": population.expected_harvest_by_month(t, as_of),
        "treemap": area.area_treemap(t),
        "weather": market.rain_by_year(t),
        "common_pests": market.common_pest(t),
        "land_area": area.area_ranking(t),
    }
    if municipality is not None:
        out["qp_harvest_muni"] = harvest.muni_harvest_by_year(t, municipality)
    if year is not None:
        out["harvest_count"] = harvest.harvest_by_month(t, year)
    return out


def general_data(t: Tables) -> dict[str, DataFrame]:
    """DB1: the general-data route: yearly price (oldest first) and the totals."""
    return {
        "qp_price": market.price_by_year(t, newest_first=False, value_name="qp_price"),
        "totals": general_data_totals(t),
    }


def general_data_page(t: Tables) -> DataFrame:
    """DB1 in one result: a row for each year's price (``part = 'price'``) and
    one with the totals (``part = 'totals'``)."""
    parts = general_data(t)
    price = parts["qp_price"].select(F.lit("price").alias("part"), "year_", "qp_price")
    totals = parts["totals"].select(F.lit("totals").alias("part"), "*")
    both = price.unionByName(totals, allowMissingColumns=True)
    return both.select("part", "year_", "qp_price", "Farmer_ID", "Area_count", "production_count").orderBy("part", "year_")


# The survey columns the main dashboard reads.
DASHBOARD_SURVEY_COLUMNS = (
    "raw_municipality", "raw_fname", "raw_mname", "raw_lname", "raw_area", "raw_population",
    "raw_dgathered", "raw_dharvest", "RBSBA",
)


def dashboard_tables(t: Tables) -> Tables:
    """``t`` with the survey pruned to the dashboard's columns, cached and
    materialized once (one scan) so the page's reports share it. Call
    ``unpersist()`` on the returned ``qp_farmer_raw`` when done; a lost
    executor's blocks are recomputed from the scan."""
    q = t.qp_farmer_raw.select(*DASHBOARD_SURVEY_COLUMNS).cache()
    q.count()
    return dataclasses.replace(t, qp_farmer_raw=q)


def dashboard_bundle(t: Tables, as_of: dt.date, cache: bool = True) -> dict[str, DataFrame]:
    """DB2: every result set of the main dashboard, as lazy DataFrames.

    The reference runs 25 statements one after another, each rescanning its
    table. Here (``cache=True``) the pruned survey projection is scanned and
    cached once (:func:`dashboard_tables`), and the reports are independent
    plans the caller may run in any order or concurrently.
    """
    if cache:
        t = dashboard_tables(t)
    return {
        "farmer_count_peryear1": farmers.farmer_count_peryear(t),
        "general_pop1": population.general_population_by_quarter(t),
        "pest_data": market.pest_list(t, "Pests"),
        "diseases_data": market.pest_list(t, "Diseases"),
        "weeds_data": market.pest_list(t, "Weeds"),
        "farmersqp": farmers.farmers_directory(t, mode="ws"),
        "qp_area": area.area_ranking(t),
        "rbsba_table": registration.rbsba_table(t),
        "expected_harvest_table": population.expected_harvest_ranked(t, as_of),
        "pineapple_population": population.population_by_muni_year(t),
        "table_data_harvest": farmers.farmers_directory(t, mode="strict"),
        "topproducer": population.top_producer(t),
        "donut_data": gender.gender_totals(t),
        "cam_norte_municipality": market.municipality_picklist(t),
        "farmer_count": farmers.farmer_count_series(t),
        "area_count": area.area_series(t),
        "gender_data": gender.gender_by_muni(t),
        "total_expected_harvest": population.expected_harvest_total(t, as_of),
        "harvest_count": harvest.harvest_series(t),
        "qp_price": market.price_by_year(t, newest_first=True),
        "population_percent": population.population_change(t, as_of),
    }


def dashboard_page(t: Tables, as_of: dt.date) -> dict[str, DataFrame]:
    """DB2 in seven results: all its figures (:func:`ananas.plans.figures.dashboard_long`) and its six lists."""
    return {
        "figures": figures.dashboard_long(t, as_of),
        "pest_data": market.pest_list(t, "Pests"),
        "diseases_data": market.pest_list(t, "Diseases"),
        "weeds_data": market.pest_list(t, "Weeds"),
        "farmersqp": farmers.farmers_directory(t, mode="ws"),
        "table_data_harvest": farmers.farmers_directory(t, mode="strict"),
        "cam_norte_municipality": market.municipality_picklist(t),
    }

"""Every report under its registered name, with the parameters the checks use."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame

from ananas.plans import area, dashboard, farmers, figures, gender, harvest, jobs, market, population, registration
from ananas.sources.tables import Tables

# The synthetic data's clock: order dates run 1995-01-01 to 2001-08-01.
AS_OF = dt.date(2001, 6, 30)
MUNI = "NATION_3"
HARVEST_YEAR = 2000

Report = Callable[[Tables], DataFrame]

# Registered a second time under the blueprint's key (same plan as another entry).
ALIASES = frozenset({"column_projection_scan", "stream_ingest"})


def reports(as_of: dt.date = AS_OF, muni: str = MUNI, harvest_year: int = HARVEST_YEAR) -> dict[str, Report]:
    return {
        # farmers
        "farmers_directory": lambda t: farmers.farmers_directory(t, "strict"),
        "farmers_directory_ws": lambda t: farmers.farmers_directory(t, "ws"),
        "survey_directory": farmers.survey_directory,
        "survey_names": farmers.survey_names,
        "column_projection_scan": farmers.survey_names,
        "farmers_directory_page": lambda t: farmers.farmers_directory_page(t, "household", 3, 8),
        "farmers_directory_next": lambda t: farmers.farmers_directory_next(t, "household", 3, 8),
        "farmer_count_total": farmers.farmer_count_total,
        "farmer_count_by_year": farmers.farmer_count_by_year,
        "farmer_count_series": farmers.farmer_count_series,
        "farmer_count_permuni": farmers.farmer_count_permuni,
        "farmer_count_peryear": farmers.farmer_count_peryear,
        "farmer_count_peryear_permuni": lambda t: farmers.farmer_count_peryear_permuni(t, muni),
        "muni_farmer_count": lambda t: farmers.muni_farmer_count(t, muni),
        "qp_farmer_count": farmers.qp_farmer_count,
        "demo_farmer_total": farmers.demo_farmer_total,
        "farmer_classification": farmers.farmer_classification,
        # gender and age
        "gender_by_muni": gender.gender_by_muni,
        "gender_totals": gender.gender_totals,
        "gender_line": gender.gender_line,
        "age_bands": lambda t: gender.age_bands(t, as_of),
        "age_stacked_female": lambda t: gender.age_stacked(t, as_of, "F"),
        "age_stacked_male": lambda t: gender.age_stacked(t, as_of, "M"),
        # area
        "area_total": area.area_total,
        "area_by_year": area.area_by_year,
        "area_line": lambda t: area.area_by_year(t, ("sum_area_year", "year_gathered")),
        "area_series": area.area_series,
        "muni_area_total": lambda t: area.muni_area_total(t, muni),
        "area_ranking": area.area_ranking,
        "area_treemap": area.area_treemap,
        "area_all": lambda t: area.area_all(t, as_of),
        # population and expected harvest
        "population_by_muni_year": population.population_by_muni_year,
        "population_by_barangay_year": lambda t: population.population_by_barangay_year(t, muni),
        "general_population_by_quarter": population.general_population_by_quarter,
        "population_change": lambda t: population.population_change(t, as_of),
        "population_change_display": lambda t: population.population_change_display(t, as_of),
        "top_producer": population.top_producer,
        "top_producer_first": lambda t: population.top_producer(t, top=1),
        "expected_harvest_total": lambda t: population.expected_harvest_total(t, as_of),
        "expected_harvest_by_muni": lambda t: population.expected_harvest_by_muni(t, as_of),
        "expected_harvest_ranked": lambda t: population.expected_harvest_ranked(t, as_of),
        "expected_harvest_by_month": lambda t: population.expected_harvest_by_month(t, as_of),
        # actual harvest
        "harvest_total": harvest.harvest_total,
        "harvest_by_year": harvest.harvest_by_year,
        "harvest_series": harvest.harvest_series,
        "harvest_by_muni_year": harvest.harvest_by_muni_year,
        "harvest_by_quarter": lambda t: harvest.harvest_by_quarter(t, as_of),
        "muni_harvest_by_year": lambda t: harvest.muni_harvest_by_year(t, muni),
        "harvest_by_month": lambda t: harvest.harvest_by_month(t, harvest_year),
        # registration
        "rbsba_status": registration.rbsba_status,
        "rbsba_percent_by_muni": registration.rbsba_percent_by_muni,
        "rbsba_by_year": registration.rbsba_by_year,
        "rbsba_table": registration.rbsba_table,
        "rbsba_per_muni": registration.rbsba_per_muni,
        # price, rain, pests, lists
        "price_by_year": market.price_by_year,
        "price_line": market.price_line,
        "rain_by_year": market.rain_by_year,
        "pest_list": lambda t: market.pest_list(t, "Pests"),
        "disease_list": lambda t: market.pest_list(t, "Diseases"),
        "weed_list": lambda t: market.pest_list(t, "Weeds"),
        "common_pest": market.common_pest,
        "municipality_picklist": market.municipality_picklist,
        "general_data_totals": dashboard.general_data_totals,
        "general_data_price": lambda t: dashboard.general_data(t)["qp_price"],
        "general_data": dashboard.general_data_page,
        "dashboard_long": lambda t: figures.dashboard_long(t, as_of),
        "muni_dashboard": lambda t: dashboard.muni_dashboard(t, muni),
        # ingest, sync and streaming jobs (S2-S7, N1-N3, ST1)
        **jobs.JOBS,
    }

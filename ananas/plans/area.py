"""Farm area reports (AR1-AR7). Sums are exact decimals cut at 2 places."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.functions.exprs import since_year, trunc_dec, year_of
from ananas.operators.aggregates import rank_small, sums_with_total_row
from ananas.plans.common import PROVINCE_TOTAL_LABEL, named_muni, survey_with_muni
from ananas.sources.tables import Tables


def _area(alias: str):
    return trunc_dec(F.sum("raw_area"), 2).alias(alias)


def area_total(t: Tables) -> DataFrame:
    """AR1: total farm area."""
    return t.qp_farmer_raw.agg(_area("Area_count"))


def area_by_year(t: Tables, names: tuple[str, str] = ("Area_count", "year_")) -> DataFrame:
    """AR2: area per year gathered (the service module names the columns
    ``sum_area_year, year_gathered``)."""
    value, year = names
    q = t.qp_farmer_raw
    return q.groupBy(year_of("raw_dgathered").alias(year)).agg(_area(value)).select(value, year).orderBy(year)


def area_series(t: Tables) -> DataFrame:
    """AR3: total as row ``year_='all'`` (0 when there is no area), then AR2."""
    r = sums_with_total_row(t.qp_farmer_raw, year_of("raw_dgathered"), "year_", "raw_area", lambda s: trunc_dec(s, 2), "Area_count")
    value = F.when(F.col("_is_total"), F.coalesce("Area_count", F.lit(0).cast("decimal(38,2)"))).otherwise(F.col("Area_count"))
    return r.orderBy(F.col("_is_total").desc(), "_order").select(value.alias("Area_count"), "year_")


def muni_area_total(t: Tables, muni_name: str) -> DataFrame:
    """AR4: total area of one municipality (one row)."""
    j = survey_with_muni(t, "raw_area")
    return j.where(F.col("muni_name") == F.lit(muni_name)).agg(_area("Area_count"))


def _area_per_muni(t: Tables, value: str, name: str) -> DataFrame:
    g = t.qp_farmer_raw.groupBy("raw_municipality").agg(_area(value))
    return named_muni(t, g).select(F.col("muni_name").alias(name), value)


def area_ranking(t: Tables) -> DataFrame:
    """AR5: municipalities ranked by area, largest first (ties by name).

    The rank is a window over the aggregated result: one row per municipality."""
    a = _area_per_muni(t, "sum_area", "muni_name")
    order = [F.col("sum_area").desc(), F.col("muni_name")]
    return rank_small(a, order, "area_rank").orderBy(*order)


def area_treemap(t: Tables) -> DataFrame:
    """AR6: area per municipality (``land_area, municipality``)."""
    return _area_per_muni(t, "land_area", "municipality").select("land_area", "municipality")


def area_all(t: Tables, as_of: dt.date, years: int = 5, total_label: str = PROVINCE_TOTAL_LABEL) -> DataFrame:
    """AR7: area per municipality and year, plus the provincial total per
    year, for the last ``years`` calendar years.

    The survey is scanned once and summed by (year, municipality id); the
    total, over every row of the year, and the names, which drop unknown
    municipalities as an inner join does, come from that small result.
    """
    first = as_of.year - (years - 1)
    q = t.qp_farmer_raw.where(since_year("raw_dgathered", first))
    g = q.groupBy(year_of("raw_dgathered").alias("year_gathered"), "raw_municipality").agg(F.sum("raw_area").alias("_s"))
    j = g.join(t.muni, F.col("raw_municipality") == F.col("muni_id"), "left")
    cut = trunc_dec(F.sum("_s"), 2).alias("sum_area_year")
    both = j.groupingSets(
        [["year_gathered", "raw_municipality", "muni_id", "muni_name"], ["year_gathered"]],
        "year_gathered", "raw_municipality", "muni_id", "muni_name",
    ).agg(cut, F.grouping("raw_municipality").alias("_total"))
    out = both.where((F.col("_total") == 1) | F.col("muni_id").isNotNull()).select(
        "sum_area_year", "year_gathered",
        F.when(F.col("_total") == 1, F.lit(total_label)).otherwise(F.col("muni_name")).alias("muni_name"),
    )
    return out.orderBy("muni_name", "year_gathered")

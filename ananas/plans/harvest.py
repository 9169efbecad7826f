"""Actual harvest reports (HA1-HA7) over ``harvest_data``.

That table keeps the municipality as a name, so no dimension join is needed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.functions.exprs import in_year, long_month, since_year, trunc_dec, year_of
from ananas.operators.aggregates import sums_with_total_row
from ananas.sources.tables import Tables


def _prod(alias: str):
    return trunc_dec(F.sum("Production"), 2).alias(alias)


def harvest_total(t: Tables) -> DataFrame:
    """HA1: total production."""
    return t.harvest_data.agg(_prod("production_count"))


def harvest_by_year(t: Tables) -> DataFrame:
    """HA2: production per year."""
    h = t.harvest_data
    return h.groupBy(year_of("year_gathered").alias("year_")).agg(_prod("production_count")).select(
        "production_count", "year_"
    ).orderBy("year_")


def harvest_series(t: Tables) -> DataFrame:
    """HA3: total as row ``year_='all'`` (0 when empty), then HA2."""
    r = sums_with_total_row(t.harvest_data, year_of("year_gathered"), "year_", "Production", lambda s: trunc_dec(s, 2), "production_count")
    value = F.when(
        F.col("_is_total"), F.coalesce("production_count", F.lit(0).cast("decimal(38,2)"))
    ).otherwise(F.col("production_count"))
    return r.orderBy(F.col("_is_total").desc(), "_order").select(value.alias("production_count"), "year_")


def harvest_by_muni_year(t: Tables) -> DataFrame:
    """HA4: production per municipality and year."""
    h = t.harvest_data
    return (
        h.groupBy(year_of("year_gathered").alias("year_gathered_1"), "Municipality")
        .agg(_prod("production_report"))
        .select("production_report", "Municipality", "year_gathered_1")
        .orderBy("Municipality", "year_gathered_1")
    )


def harvest_by_quarter(t: Tables, as_of: dt.date, years: int = 4) -> DataFrame:
    """HA5: production per municipality and quarter of the last ``years``
    calendar years, labelled "2020 Quarter 1"."""
    h = t.harvest_data.where(since_year("year_gathered", as_of.year - (years - 1)))
    d = F.col("year_gathered")
    g = h.groupBy(year_of(d).alias("year_gathereds"), F.quarter(d).cast("long").alias("quarters"), "Municipality").agg(
        _prod("production_report")
    )
    label = F.concat(F.col("year_gathereds").cast("string"), F.lit(" Quarter "), F.col("quarters").cast("string"))
    return g.orderBy("Municipality", "year_gathereds", "quarters").select(
        "production_report", "year_gathereds", "quarters", label.alias("year_gathered_1"), "Municipality"
    )


def muni_harvest_by_year(t: Tables, municipality: str) -> DataFrame:
    """HA6: production per year of one municipality (by name)."""
    h = t.harvest_data.where(F.col("Municipality") == F.lit(municipality))
    return h.groupBy(year_of("year_gathered").alias("year_gathered_1")).agg(_prod("production_report")).select(
        "production_report", "year_gathered_1"
    ).orderBy("year_gathered_1")


def harvest_by_month(t: Tables, year: int) -> DataFrame:
    """HA7: production per municipality and month of one year, with the
    month's full name."""
    h = t.harvest_data.where(in_year("year_gathered", year))
    d = F.col("year_gathered")
    g = h.groupBy("Municipality", F.month(d).alias("_m"), year_of(d).alias("year_val")).agg(
        _prod("production_report"), F.min(long_month(d)).alias("month_gathered")
    )
    return g.orderBy("Municipality", "_m").select("production_report", "month_gathered", "Municipality", "year_val")

"""Gender and age reports (GE1-GE3, AG1-AG3)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.functions.exprs import (
    AGE_BAND_EDGES,
    AGE_BAND_EDGES_MALE,
    age_at,
    age_band,
    band_labels,
    mysql_ratio_pct,
    sum_flag,
    year_of,
)
from ananas.operators.aggregates import flag_counts
from ananas.plans.common import named_muni, raw_person
from ananas.sources.tables import Tables


def _is(gender: str):
    return F.col("f_gender") == F.lit(gender)


def gender_by_muni(t: Tables) -> DataFrame:
    """GE1: registered men and women per municipality, by total."""
    g = t.farmer_demo.groupBy("f_municipality").agg(sum_flag(_is("M")).alias("Male"), sum_flag(_is("F")).alias("Female"))
    return named_muni(t, g, "f_municipality").select(
        F.col("muni_name").alias("f_municipality"), "Male", "Female", (F.col("Male") + F.col("Female")).alias("total")
    ).orderBy("total", "f_municipality")


def gender_totals(t: Tables, div_scale: int | None = None) -> DataFrame:
    """GE2: one row, men, women and their shares of (men + women), TRUNCATE 2.

    With no man or woman the shares are NULL (``NULLIF`` guard), and with no
    rows at all every column is NULL."""
    g = t.farmer_demo.agg(sum_flag(_is("M")).alias("Male"), sum_flag(_is("F")).alias("Female"))
    both = F.col("Male") + F.col("Female")
    return g.select(
        "Male", "Female",
        mysql_ratio_pct("Male", both, 2, div_scale).alias("male_percent"),
        mysql_ratio_pct("Female", both, 2, div_scale).alias("female_percent"),
    )


def gender_line(t: Tables, require_all: bool = True) -> DataFrame:
    """GE3: distinct men and women surveyed per year, only years with both
    (``require_all=False``: every year with a man or a woman)."""
    c = flag_counts(
        t.qp_farmer_raw, [year_of("raw_dgathered").alias("year_dg")], raw_person("ws"),
        {"male_count": F.col("raw_gender") == "M", "female_count": F.col("raw_gender") == "F"}, total=None,
    )
    both = (F.col("male_count") > 0) & (F.col("female_count") > 0)
    some = (F.col("male_count") > 0) | (F.col("female_count") > 0)
    c = c.where((both if require_all else some) & F.col("year_dg").isNotNull())
    return c.select("year_dg", "male_count", "female_count").orderBy("year_dg")


def age_bands(t: Tables, as_of: dt.date, edges: Sequence[int] = AGE_BAND_EDGES, birth_col: str = "f_birthdate") -> DataFrame:
    """AG1: registered farmers per age band (``counter_, range_``).

    The band views are not in the reference; edges are the views' names
    (25, 35, ... 85) read as upper bounds, age is completed years at
    ``as_of``. Every band has a row, empty ones with 0: one global aggregate
    of conditional counts, unpivoted.
    """
    labels = band_labels(edges)
    band = age_band(age_at(birth_col, as_of), edges)
    counts = t.farmer_demo.agg(*[F.count(F.when(band == lab, 1)).alias(f"b{i}") for i, lab in enumerate(labels)])
    stacked = counts.select(F.explode(F.array(*[
        F.struct(F.col(f"b{i}").cast("long").alias("counter_"), F.lit(lab).alias("range_"), F.lit(i).alias("_i"))
        for i, lab in enumerate(labels)
    ])).alias("b"))
    return stacked.select("b.counter_", "b.range_", "b._i").orderBy("_i").drop("_i")


def age_stacked(t: Tables, as_of: dt.date, gender: str, edges: Sequence[int] | None = None, birth_col: str = "f_birthdate") -> DataFrame:
    """AG2 / AG3: farmers of one gender per age band (``count_, range_, f_gender``).

    The female report stops at 85, the male one goes to 95 (the default
    edges follow the gender). Bands without such a farmer have no row.
    """
    if edges is None:
        edges = AGE_BAND_EDGES_MALE if gender == "M" else AGE_BAND_EDGES
    labels = band_labels(edges)
    order = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
    f = t.farmer_demo.where(F.col("f_gender") == F.lit(gender))
    band = age_band(age_at(birth_col, as_of), edges)
    g = f.groupBy(band.alias("range_"), "f_gender").agg(F.count(F.lit(1)).alias("count_")).where(F.col("range_").isNotNull())
    return g.select("count_", "range_", "f_gender").orderBy(order[F.col("range_")])

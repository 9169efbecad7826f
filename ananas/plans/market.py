"""Price, rainfall, pest catalogue and list reports (PR1-PR2, WE1, PE1-PE2, LI1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.functions.exprs import avg_exact, trunc_dec, year_of
from ananas.operators.aggregates import number_rows
from ananas.plans.common import PROVINCE_NAME
from ananas.sources.tables import Tables


def price_by_year(t: Tables, newest_first: bool = True, value_name: str = "price") -> DataFrame:
    """PR1: average large-fruit price per year, untruncated (MySQL's AVG of a
    2-place decimal has 6 places). The dashboard lists newest first and shows
    row 0; the general-data route lists oldest first as ``qp_price``."""
    p = t.qp_price
    g = p.groupBy(year_of("date").alias("year_")).agg(avg_exact("lg_price").alias(value_name))
    return g.select(value_name, "year_").orderBy(F.col("year_").desc() if newest_first else F.col("year_"))


def price_line(t: Tables) -> DataFrame:
    """PR2: average large and medium price per year, TRUNCATE 2."""
    p = t.qp_price
    g = p.groupBy(year_of("date").alias("year_gathered")).agg(
        avg_exact("lg_price").alias("_lg"), avg_exact("med_price").alias("_md")
    )
    return g.select(
        trunc_dec("_lg", 2).alias("price_large"), trunc_dec("_md", 2).alias("price_med"), "year_gathered"
    ).orderBy("year_gathered")


def rain_by_year(t: Tables) -> DataFrame:
    """WE1: rainfall per year, TRUNCATE 2."""
    w = t.weather_data
    return (
        w.groupBy(year_of("date").alias("year_date"))
        .agg(trunc_dec(F.sum("rain_amount"), 2).alias("rain_amount_total"))
        .orderBy("year_date")
    )


# The catalogue's three categories.
PEST_CATEGORIES = ("Pests", "Diseases", "Weeds")


def pest_list(t: Tables, category: str, buckets: int = 256) -> DataFrame:
    """PE1: one catalogue category numbered by id (``count_``).

    The numbering scales with the catalogue: quantile buckets of the id, a
    window per bucket and a broadcast running total of bucket sizes, instead
    of one window over every row on a single task."""
    p = t.pests.where(F.col("category") == F.lit(category)).select("id", "name", "description", "percent")
    n = number_rows(p, "id", "count_", buckets=buckets, ordered=True)
    return n.select("count_", "name", "description", "percent")


def common_pest(t: Tables) -> DataFrame:
    """PE2: name, rank and percent of every catalogue entry."""
    return t.pests.select("name", "rank", "percent")


def municipality_picklist(t: Tables, province: str = PROVINCE_NAME) -> DataFrame:
    """LI1: the province, then each municipality present in the survey,
    ordered by the length of its id (so ids sort as numbers by magnitude),
    then by name."""
    q = t.qp_farmer_raw.select("raw_municipality").where(
        F.col("raw_municipality").isNotNull() & (F.col("raw_municipality") != "")
    ).distinct()
    j = q.join(t.muni, F.col("raw_municipality") == F.col("muni_id"), "inner")
    pairs = j.select(F.col("muni_name").alias("muni_select"), "raw_municipality").distinct()
    ordered = pairs.select("muni_select", F.lit(1).alias("_head"), F.octet_length("raw_municipality").alias("_len"))
    name_type = ordered.schema["muni_select"].dataType  # keeps a collation, if the tables have one
    head = t.spark.range(1).select(
        F.lit(province).cast(name_type).alias("muni_select"), F.lit(0).alias("_head"),
        F.lit(None).cast("int").alias("_len"),
    )
    return ordered.unionByName(head).orderBy("_head", "_len", "muni_select").select("muni_select")

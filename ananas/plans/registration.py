"""Government registration (RBSBA) reports (RG1-RG5).

Each reference query joins two or three ``COUNT(DISTINCT person)``
subqueries that differ only in a filter on the RBSBA column. Here they are
one scan and one two-phase flag count; the inner joins' effect (a group
missing on one side disappears) is kept as an explicit filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.functions.exprs import is_blank, mysql_ratio_pct, year_of
from ananas.operators.aggregates import flag_counts
from ananas.plans.common import raw_person
from ananas.sources.tables import Tables


def _flags(registered: str, unregistered: str | None = None) -> dict:
    out = {registered: ~is_blank("RBSBA")}
    if unregistered:
        out[unregistered] = is_blank("RBSBA")
    return out


def _with_muni(t: Tables, df: DataFrame) -> DataFrame:
    return df.join(t.muni, F.col("raw_municipality") == F.col("muni_id"), "inner")


def rbsba_status(t: Tables) -> DataFrame:
    """RG1: one row, distinct unregistered and registered farmers.

    A farmer with both kinds of rows counts on both sides."""
    c = flag_counts(t.qp_farmer_raw, [], raw_person("ws"), _flags("registered_count", "notregistered_count"), total=None)
    return c.select(
        F.coalesce("notregistered_count", F.lit(0)).cast("long").alias("notregistered_count"),
        F.coalesce("registered_count", F.lit(0)).cast("long").alias("registered_count"),
    )


def rbsba_percent_by_muni(t: Tables, div_scale: int | None = None) -> DataFrame:
    """RG2: share of registered farmers per municipality (TRUNCATE 1).

    Only municipalities with at least one registered farmer."""
    c = flag_counts(t.qp_farmer_raw, ["raw_municipality"], raw_person("ws"), _flags("registered_count"))
    c = _with_muni(t, c.where(F.col("registered_count") > 0))
    return c.select(
        mysql_ratio_pct("registered_count", "total_num", 1, div_scale).alias("registered"),
        "muni_name", "registered_count", "total_num",
    ).orderBy("muni_name")


def rbsba_by_year(t: Tables, div_scale: int | None = None, require_all: bool = True) -> DataFrame:
    """RG3: registered share per year, for years with both kinds of farmer.

    A NULL year never matches in the reference's joins, so it is dropped.
    ``require_all=False`` keeps years with only one kind (its count 0)."""
    c = flag_counts(
        t.qp_farmer_raw, [year_of("raw_dgathered").alias("year_dg1")], raw_person("ws"),
        _flags("registered_count", "unregistered_count"),
    )
    both = (F.col("registered_count") > 0) & (F.col("unregistered_count") > 0)
    c = c.where((both if require_all else F.lit(True)) & F.col("year_dg1").isNotNull())
    return c.select(
        mysql_ratio_pct("registered_count", "total_num", 1, div_scale).alias("registered"),
        "year_dg1", "registered_count", "unregistered_count", "total_num",
    ).orderBy("year_dg1")


def _both_sides(t: Tables, require_all: bool = True) -> DataFrame:
    c = flag_counts(
        t.qp_farmer_raw, ["raw_municipality"], raw_person("ws"),
        _flags("rbsba_registered", "rbsba_unregistered"),
    )
    if require_all:
        c = c.where((F.col("rbsba_registered") > 0) & (F.col("rbsba_unregistered") > 0))
    return _with_muni(t, c)


def rbsba_table(t: Tables, div_scale: int | None = None, require_all: bool = True) -> DataFrame:
    """RG4: both counts, total and both shares (TRUNCATE 2) per municipality,
    for municipalities with both kinds of farmer (``require_all=False``: all
    municipalities). Output names keep the source spelling
    ``registred_percentage``."""
    c = _both_sides(t, require_all)
    return c.select(
        "rbsba_registered", "rbsba_unregistered", "total_num",
        mysql_ratio_pct("rbsba_registered", "total_num", 2, div_scale).alias("registred_percentage"),
        mysql_ratio_pct("rbsba_unregistered", "total_num", 2, div_scale).alias("unregistred_percentage"),
        "muni_name",
    ).orderBy("muni_name")


def rbsba_per_muni(t: Tables, require_all: bool = True) -> DataFrame:
    """RG5: both counts per municipality, most registered first."""
    c = _both_sides(t, require_all)
    return c.select("rbsba_registered", "rbsba_unregistered", "muni_name").orderBy(
        F.col("rbsba_registered").desc(), "muni_name"
    )

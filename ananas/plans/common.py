"""Joins and keys shared by the report families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.functions.exprs import person_key
from ananas.sources.tables import Tables

# Fixed value: the label that makes the provincial total sort first.
PROVINCE_TOTAL_LABEL = "A Camarines Norte"
# Fixed value: the province name the municipality list starts with.
PROVINCE_NAME = "Camarines Norte"


def survey_with_muni(t: Tables, *cols: str) -> DataFrame:
    """``qp_farmer_raw q JOIN tbl_muni m ON q.raw_municipality = m.muni_id``.

    Rows whose id has no municipality drop out, as in the reference."""
    q = t.qp_farmer_raw
    if cols:
        q = q.select(*dict.fromkeys(("raw_municipality", *cols)))
    return q.join(t.muni, F.col("raw_municipality") == F.col("muni_id"), "inner")


def named_muni(t: Tables, df: DataFrame, id_col: str = "raw_municipality") -> DataFrame:
    """Rows already aggregated by municipality id, with its name; unknown ids
    drop out. Ids are unique, so no group is split or doubled."""
    return df.join(t.muni, F.col(id_col) == F.col("muni_id"), "inner")


def farmers_with_muni(t: Tables, *cols: str) -> DataFrame:
    f = t.farmer_demo
    if cols:
        f = f.select(*dict.fromkeys(("f_municipality", *cols)))
    return f.join(t.muni, F.col("f_municipality") == F.col("muni_id"), "inner")


def raw_person(mode: str = "ws"):
    return person_key("raw_fname", "raw_mname", "raw_lname", mode)

"""Key-normalising jobs (N1-N3): replace names by ids on survey rows.

Each is a pure ``DataFrame -> DataFrame`` function that keeps every input row
(a left join against a dimension made unique on its match key first), so the
caller rewrites the curated table with the result. No MERGE is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F




def sync_farmer_id(survey: DataFrame, farmer_demo: DataFrame) -> DataFrame:
    """N1: set ``f_id`` on survey rows whose unseparated full name equals a
    registered farmer's.

    A NULL name part never matches (``CONCAT`` is NULL). When several farmers
    share a name the largest id wins, so the result does not depend on row
    order (the reference's last-write-wins loop). The farmer side may be
    large, so this is a plain equi-join (shuffle, with AQE splitting a hot
    name); the name -> id map is aggregated first, so it has one row per name.
    """
    names = farmer_demo.select(
        F.concat("f_name", "m_name", "l_name").alias("_name"), "f_id"
    ).where(F.col("_name").isNotNull()).groupBy("_name").agg(F.max("f_id").alias("_new_f_id"))
    keyed = survey.withColumn("_name", F.concat("raw_fname", "raw_mname", "raw_lname"))
    j = keyed.join(names, "_name", "left")
    return j.withColumn("f_id", F.coalesce("_new_f_id", "f_id")).drop("_name", "_new_f_id").select(*survey.columns)


def sync_municipality_id(survey: DataFrame, tbl_muni: DataFrame, unsynced: str = "is_synced") -> DataFrame:
    """N2: replace the municipality name by its id on rows not yet synced.

    ``unsynced`` names a boolean column (False = just ingested); rows whose
    name is unknown keep it. Spark broadcasts the municipality list while it
    is small."""
    dim = tbl_muni.groupBy(F.col("muni_name").alias("_mname")).agg(F.max("muni_id").alias("_mid"))
    j = survey.join(dim, F.col("raw_municipality") == F.col("_mname"), "left")
    todo = ~F.coalesce(F.col(unsynced), F.lit(False)) if unsynced in survey.columns else F.lit(True)
    new = F.when(todo & F.col("_mid").isNotNull(), F.col("_mid")).otherwise(F.col("raw_municipality"))
    out = j.withColumn("raw_municipality", new)
    if unsynced in survey.columns:
        out = out.withColumn(unsynced, F.lit(True))
    return out.select(*survey.columns)


def sync_barangay_id(survey: DataFrame, tbl_barangay: DataFrame) -> DataFrame:
    """N3: replace the barangay name by its id, matching on the pair (barangay
    name, municipality id), so equal village names in two municipalities stay
    apart. Unmatched rows keep their value."""
    dim = tbl_barangay.groupBy(F.col("brgy_name").alias("_bname"), F.col("muni_id").alias("_bmuni")).agg(
        F.max("brgy_id").alias("_bid")
    )
    j = survey.join(
        dim, (F.col("raw_barangay") == F.col("_bname")) & (F.col("raw_municipality") == F.col("_bmuni")), "left"
    )
    return j.withColumn("raw_barangay", F.coalesce("_bid", "raw_barangay")).select(*survey.columns)

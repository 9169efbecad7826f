"""Farmer lists and distinct-farmer counts (FA1-FA13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.functions.exprs import id_sort_key, is_blank, year_of
from ananas.operators.aggregates import flag_counts, with_total_row
from ananas.plans.common import farmers_with_muni, named_muni, raw_person, survey_with_muni
from ananas.sources.tables import Tables


def distinct_farmers(key, alias: str, approx_rsd: float | None = None):
    """``COUNT(DISTINCT key)``: exact by default; with ``approx_rsd`` a
    HyperLogLog++ estimate with that relative standard deviation, which
    shuffles one small sketch per group and map task instead of the distinct
    (group, key) pairs."""
    if approx_rsd is None:
        return F.count_distinct(key).alias(alias)
    return F.approx_count_distinct(key, approx_rsd).alias(alias)


def _fullname(mode: str, first: str, middle: str, last: str):
    if mode == "strict":  # CONCAT: a NULL part makes the name NULL
        return F.concat(F.col(first), F.lit(" "), F.col(middle), F.lit(" "), F.col(last))
    return F.concat_ws(" ", F.col(first), F.col(middle), F.col(last))


def farmers_directory(t: Tables, mode: str = "strict") -> DataFrame:
    """FA1 / FA2: farmers with municipality and barangay names.

    ``mode="strict"`` joins name parts with ``CONCAT`` (NULL middle name ->
    NULL fullname, the tables page); ``"ws"`` with ``CONCAT_WS`` (the
    service module). Inner joins: farmers without both places drop out.
    """
    f = farmers_with_muni(t, "f_id", "f_name", "m_name", "l_name", "f_gender", "f_barangay")
    b = t.barangay.select("brgy_id", "brgy_name")
    j = f.join(b, F.col("f_barangay") == F.col("brgy_id"), "inner")
    return j.select(
        "f_id",
        F.col("muni_name").alias("municipality"),
        F.col("brgy_name").alias("barangay"),
        _fullname(mode, "f_name", "m_name", "l_name").alias("fullname"),
        F.col("f_gender").alias("gender"),
    )


def survey_directory(t: Tables, ordered: bool = True) -> DataFrame:
    """FA3: one row per survey fullname, the earliest row by ``logs``.

    The reference groups by the computed name and lets MySQL pick the other
    columns; here they come from the first row in (logs, municipality,
    barangay, gender) order, NULLs first. ``min`` of a struct is a plain
    aggregate, so it combines map-side even when one name (say NULL) holds a
    large share of the rows.
    """
    q = t.qp_farmer_raw
    first = F.min(F.struct("logs", "raw_municipality", "raw_barangay", "raw_gender")).alias("_first")
    g = q.groupBy(_fullname("strict", "raw_fname", "raw_mname", "raw_lname").alias("fullname")).agg(first)
    out = g.select(
        F.col("_first.logs").alias("logs"),
        F.col("_first.raw_municipality").alias("raw_municipality"),
        F.col("_first.raw_barangay").alias("raw_barangay"),
        "fullname",
        F.col("_first.raw_gender").alias("gender"),
    )
    return out.orderBy("logs", "fullname") if ordered else out


def survey_names(t: Tables) -> DataFrame:
    """S11: the survey's name columns, every row (the unmounted tables page)."""
    return t.qp_farmer_raw.select("logs", "f_id", "raw_fname", "raw_mname", "raw_lname")


def farmers_directory_page(t: Tables, term: str | None = None, number: int = 1, size: int = 8) -> DataFrame:
    """FA1 as the dashboard's table widget shows it: searched, sorted by id, one page."""
    from ananas.operators.paging import page

    return page(farmers_directory(t, "ws"), id_sort_key("f_id"), number, size, term)


def farmers_directory_next(t: Tables, term: str | None = None, number: int = 1, size: int = 8) -> DataFrame:
    """The same page by keyset cursors: no page reads the rows of the pages before it."""
    from ananas.operators.paging import pages_after

    return pages_after(farmers_directory(t, "ws"), id_sort_key("f_id"), number, size, term)


def farmer_count_total(t: Tables, approx_rsd: float | None = None) -> DataFrame:
    """FA4: distinct farmers (unseparated name key) in the survey."""
    return t.qp_farmer_raw.agg(distinct_farmers(raw_person("strict"), "count_farmer", approx_rsd))


def farmer_count_by_year(t: Tables, approx_rsd: float | None = None) -> DataFrame:
    """FA5: distinct farmers per year gathered (a NULL year is a group)."""
    q = t.qp_farmer_raw
    return (
        q.groupBy(year_of("raw_dgathered").alias("year_"))
        .agg(distinct_farmers(raw_person("strict"), "count_farmer", approx_rsd))
        .select("count_farmer", "year_")
        .orderBy("year_")
    )


def farmer_count_series(t: Tables) -> DataFrame:
    """FA6: the total as row ``year_='all'``, then FA5. The total counts each
    farmer once, so it is not the sum of the years."""
    seen = t.qp_farmer_raw.select(year_of("raw_dgathered").alias("_y"), raw_person("strict").alias("_p")).distinct()
    r = with_total_row(seen, F.col("_y"), "year_", [F.count_distinct("_p").alias("count_farmer")])
    count = F.when(F.col("_is_total"), F.coalesce("count_farmer", F.lit(0))).otherwise(F.col("count_farmer"))
    return r.orderBy(F.col("_is_total").desc(), F.col("_order")).select(count.alias("count_farmer"), "year_")


def farmer_count_permuni(t: Tables, approx_rsd: float | None = None) -> DataFrame:
    """FA7: distinct farmers (``CONCAT_WS`` key) per municipality, ascending."""
    j = survey_with_muni(t, "raw_fname", "raw_mname", "raw_lname")
    return (
        j.groupBy("raw_municipality", "muni_name")
        .agg(distinct_farmers(raw_person("ws"), "farmer_count_per_muni", approx_rsd))
        .select("farmer_count_per_muni", "muni_name")
        .orderBy("farmer_count_per_muni", "muni_name")
    )


def farmer_count_peryear(t: Tables, approx_rsd: float | None = None) -> DataFrame:
    """FA8: distinct farmers per year, only rows with a known municipality."""
    j = survey_with_muni(t, "raw_fname", "raw_mname", "raw_lname", "raw_dgathered")
    return (
        j.groupBy(year_of("raw_dgathered").alias("year_gathered"))
        .agg(distinct_farmers(raw_person("ws"), "farmer_count_per_year", approx_rsd))
        .select("farmer_count_per_year", "year_gathered")
        .orderBy("year_gathered")
    )


def farmer_count_peryear_permuni(t: Tables, muni_name: str, approx_rsd: float | None = None) -> DataFrame:
    """FA9: FA8 for one municipality name."""
    j = survey_with_muni(t, "raw_fname", "raw_mname", "raw_lname", "raw_dgathered")
    return (
        j.where(F.col("muni_name") == F.lit(muni_name))
        .groupBy(year_of("raw_dgathered").alias("year_gathered"), "muni_name")
        .agg(distinct_farmers(raw_person("ws"), "farmer_count_per_year", approx_rsd))
        .select("farmer_count_per_year", "year_gathered", "muni_name")
        .orderBy("year_gathered")
    )


def muni_farmer_count(t: Tables, muni_name: str) -> DataFrame:
    """FA10: number of registered farmers of one municipality (one row)."""
    f = farmers_with_muni(t)
    return f.where(F.col("muni_name") == F.lit(muni_name)).agg(F.count(F.lit(1)).alias("Farmer_ID"))


def qp_farmer_count(t: Tables) -> DataFrame:
    """FA11: registered farmers per municipality."""
    g = t.farmer_demo.groupBy("f_municipality").agg(F.count(F.lit(1)).alias("farmer_count"))
    return named_muni(t, g, "f_municipality").select("farmer_count", "muni_name")


def demo_farmer_total(t: Tables) -> DataFrame:
    """FA12: number of registered farmers."""
    return t.farmer_demo.agg(F.count(F.lit(1)).alias("total_farmer"))


# The tenurial classes of the classification report, as
# (output column, stored value).
TENURIAL_CLASSES = (
    ("tenant", "Tenant"),
    ("cultivator", "Cultivator"),
    ("owner", "Owner"),
    ("lesse", "Lesse"),
    ("renting", "Renting"),
    ("co_owner", "Co-Owner"),
)


def farmer_classification(t: Tables) -> DataFrame:
    """FA13: distinct farmers per tenurial class and municipality.

    As in the reference, ``all_`` and the set of rows cover farmers whose
    tenurial is blank or NULL: a municipality without such a farmer is
    absent, and a class nobody holds is NULL rather than 0. The seven
    self-joined subqueries become one two-phase flag count.
    """
    q = t.qp_farmer_raw
    flags = {"all_": is_blank("tenurial")}
    flags.update({name: F.col("tenurial") == F.lit(value) for name, value in TENURIAL_CLASSES})
    counts = flag_counts(q, ["raw_municipality"], raw_person("ws"), flags, total=None)
    counts = counts.where(F.col("all_") > 0)
    j = counts.join(t.muni, F.col("raw_municipality") == F.col("muni_id"), "inner")
    return j.select(
        "all_",
        *[F.when(F.col(n) > 0, F.col(n)).alias(n) for n, _ in TENURIAL_CLASSES],
        "muni_name",
    ).orderBy("muni_name")

"""Every figure of the main dashboard in one long result, from one pass over the survey (DB2).

The page's 21 result sets are 15 sets of figures and 6 lists; the lists (directories, pests,
the picklist) stay reports of their own. Of the figures, 11 count or sum survey rows. Here
they come from one scan: grouping sets make of it the sums by (municipality, quarter) and
the farmers by (municipality, year), each summed before it is shuffled; each of those rows
then says which figures it belongs to.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ananas.functions.exprs import in_year, is_blank, mysql_ratio_pct, person_key, trunc_dec, year_of
from ananas.plans import gender, harvest, market
from ananas.sources.tables import Tables

VALUE = "decimal(38,6)"
COLUMNS = ("report", "place", "period", "measure", "value")


def _survey_groups(t: Tables, as_of: dt.date) -> DataFrame:
    """Sums (``_sums`` true) and farmers of the survey, with the municipality's name where it is known."""
    d = F.col("raw_dgathered")
    q = t.qp_farmer_raw.select(
        F.col("raw_municipality").alias("muni"), year_of(d).alias("y"), F.quarter(d).alias("quarter"),
        F.coalesce(in_year("raw_dharvest", as_of.year), F.lit(False)).alias("due"),
        "raw_fname", "raw_mname", "raw_lname", "raw_area", "raw_population",
        (~is_blank("RBSBA")).cast("int").alias("reg"), is_blank("RBSBA").cast("int").alias("unreg"),
    )
    keys = ["muni", "y", "quarter", "due", "raw_fname", "raw_mname", "raw_lname"]
    g = q.groupingSets([keys[:4], ["muni", "y", *keys[4:]]], *keys).agg(
        F.sum("raw_area").alias("area"), F.sum("raw_population").alias("pop"), F.count(F.lit(1)).alias("n"),
        F.max("reg").alias("reg"), F.max("unreg").alias("unreg"), (F.grouping("due") == 0).alias("_sums"),
    )
    m = t.muni.select("muni_id", "muni_name")
    return g.join(m, F.col("muni") == F.col("muni_id"), "left")


def _target(when: Column, report: str, place: bool = False, period: Column | None = None, person: Column | None = None) -> Column:
    """The figure's key that a row belongs to, where ``when`` holds."""
    none = F.lit(None).cast("string")
    return F.when(when, F.struct(
        F.lit(report).alias("report"), (F.col("muni") if place else none).alias("id"), (F.col("muni_name") if place else none).alias("place"),
        (none if period is None else period.cast("string")).alias("period"), (none if person is None else person).alias("person"),
    ))


def survey_figures(t: Tables, as_of: dt.date) -> DataFrame:
    """The dashboard's figures that come from the survey; see :func:`dashboard_long`."""
    sums, known = F.col("_sums"), F.col("muni_name").isNotNull()
    name = ("raw_fname", "raw_mname", "raw_lname")
    ws, strict = person_key(*name, "ws"), person_key(*name, "strict")
    y1, y2 = as_of.year - 1, as_of.year - 2
    year, everything = F.col("y"), F.lit("all")
    quarter = F.concat(year.cast("string"), F.lit(" Q "), F.col("quarter").cast("string"))
    targets = [
        _target(sums & known, "area_ranking", place=True),
        _target(sums, "area_count", period=everything),
        _target(sums, "area_count", period=year),
        _target(sums, "general_pop", period=quarter),
        _target(sums & known, "pineapple_population", place=True, period=year),
        _target(sums & known, "topproducer", place=True),
        _target(sums & known & F.col("due"), "expected_harvest_table", place=True),
        _target(sums & F.col("due"), "total_expected_harvest"),
        _target(sums & known & year.isin(y1, y2), "population_percent", place=True),
        _target(~sums, "farmer_count", period=everything, person=strict),
        _target(~sums, "farmer_count", period=year, person=strict),
        _target(~sums & known, "farmer_count_peryear", period=year, person=ws),
        _target(~sums & known, "rbsba_table", place=True, person=ws),
    ]
    to = F.filter(F.array(*targets), lambda x: x.isNotNull())
    rows = _survey_groups(t, as_of).select("y", "area", "pop", "n", "reg", "unreg", F.explode(to).alias("to")).select("to.*", "y", "area", "pop", "n", "reg", "unreg")
    # totals have a row even where the survey has none
    head = [("area_count", "all"), ("farmer_count", "all"), ("total_expected_harvest", None)]
    seed = t.spark.createDataFrame(head, "report string, period string")
    seed = seed.select(*[F.col(c).cast(k) if c in seed.columns else F.lit(None).cast(k).alias(c) for c, k in rows.dtypes])
    key = ["report", "id", "place", "period"]
    at = lambda k, c: F.sum(F.when(F.col("y") == k, F.col(c)))
    per_person = rows.unionByName(seed).groupBy(*key, "person").agg(
        F.sum("area").alias("area"), F.sum("pop").alias("pop"), F.max("reg").alias("reg"), F.max("unreg").alias("unreg"),
        at(y1, "pop").alias("pop1"), at(y2, "pop").alias("pop2"), at(y1, "n").alias("n1"), at(y2, "n").alias("n2"),
    )
    someone = F.col("person").isNotNull()
    total = lambda c: F.sum(c).cast("long").alias(c)
    f = per_person.groupBy(*key).agg(
        F.sum("area").alias("area"), total("pop"), total("pop1"), total("pop2"), F.max("n1").alias("n1"), F.max("n2").alias("n2"),
        F.count(F.when(someone, 1)).alias("persons"), *[F.coalesce(F.sum(F.when(someone, F.col(c))), F.lit(0)).alias(c) for c in ("reg", "unreg")],
    )
    f = f.withColumn("area", trunc_dec("area", 2))
    in_report = Window.partitionBy("report")  # a row for each municipality
    f = f.withColumn("area_rank", F.row_number().over(in_report.orderBy(F.col("area").desc(), "place")))
    f = f.withColumn("pop_rank", F.row_number().over(in_report.orderBy(F.col("pop").desc(), "place")))
    diff = F.col("pop1") - F.col("pop2")
    measures = {
        "area_ranking": [("sum_area", F.col("area")), ("area_rank", F.col("area_rank"))],
        "area_count": [("Area_count", F.when(F.col("period") == "all", F.coalesce("area", F.lit(0))).otherwise(F.col("area")))],
        "general_pop": [("population", F.col("pop"))],
        "pineapple_population": [("population", F.col("pop"))],
        "topproducer": [("population", F.col("pop"))],
        "expected_harvest_table": [("expected_harvest", F.col("pop")), ("ranking", F.col("pop_rank"))],
        "total_expected_harvest": [("expected_harvest", F.col("pop"))],
        "population_percent": [("change_pop", mysql_ratio_pct(diff, "pop2", 2)), ("pop1", F.col("pop1")), ("pop2", F.col("pop2")), ("diff_pop", diff)],
        "farmer_count": [("count_farmer", F.col("persons"))],
        "farmer_count_peryear": [("farmer_count_per_year", F.col("persons"))],
        "rbsba_table": [
            ("rbsba_registered", F.col("reg")), ("rbsba_unregistered", F.col("unreg")), ("total_num", F.col("persons")),
            ("registred_percentage", mysql_ratio_pct("reg", "persons", 2)), ("unregistred_percentage", mysql_ratio_pct("unreg", "persons", 2)),
        ],
    }
    # groups that lack one side are no rows of these two (K2)
    f = f.where((F.col("report") != "rbsba_table") | ((F.col("reg") > 0) & (F.col("unreg") > 0)))
    f = f.where((F.col("report") != "population_percent") | (F.col("n1").isNotNull() & F.col("n2").isNotNull()))
    return _long(f, measures)


def _long(f: DataFrame, measures: dict[str, Sequence[tuple[str, Column]]]) -> DataFrame:
    each = lambda pairs: F.array(*[F.struct(F.lit(n).alias("measure"), v.cast(VALUE).alias("value")) for n, v in pairs])
    chosen = None
    for report, pairs in measures.items():
        own = F.col("report") == report
        chosen = F.when(own, each(pairs)) if chosen is None else chosen.when(own, each(pairs))
    return f.select("report", "place", "period", F.explode(chosen).alias("m")).select("report", "place", "period", "m.measure", "m.value")


def long_rows(df: DataFrame, report: str, values: Sequence[str], place: str | None = None, period: str | None = None) -> DataFrame:
    """A report as long rows: one for each of its columns ``values``."""
    text = lambda c: (F.col(c).cast("string") if c else F.lit(None).cast("string"))
    f = df.select(F.lit(report).alias("report"), text(place).alias("place"), text(period).alias("period"), *values)
    return _long(f, {report: [(v, F.col(v)) for v in values]})


def dashboard_long(t: Tables, as_of: dt.date) -> DataFrame:
    """DB2 as one result: ``report, place, period, measure, value``, a row for each figure.

    ``report`` is the set's name in :func:`ananas.plans.dashboard.dashboard_bundle`, ``measure``
    the column; ``place`` is a municipality's name, ``period`` a year, a quarter, ``all``
    or NULL. Sets keep their own rules: those that join the municipalities drop rows without
    one, a NULL year is a period of its own, one-sided groups are no rows of the registration
    and change tables.
    """
    parts = [
        survey_figures(t, as_of),
        long_rows(gender.gender_by_muni(t), "gender_data", ["Male", "Female", "total"], place="f_municipality"),
        long_rows(gender.gender_totals(t), "donut_data", ["Male", "Female", "male_percent", "female_percent"]),
        long_rows(harvest.harvest_series(t), "harvest_count", ["production_count"], period="year_"),
        long_rows(market.price_by_year(t), "qp_price", ["price"], period="year_"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*COLUMNS)

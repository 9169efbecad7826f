"""Distinct farmers from stored state: equal to the reports, whatever the loads; sketches within their bound."""

import dataclasses

from pyspark.sql import functions as F

from ananas.operators import distinct_state
from ananas.plans import farmers, registration
from ananas.session import staging_path
from tests.conftest import survey_row

ROWS = [
    survey_row(logs=1), survey_row(logs=2, gathered="2001-01-01", rbsba=""), survey_row(logs=3, fname="B", muni="2"), survey_row(logs=4, fname="B", muni="2", rbsba=None),
    survey_row(logs=5, mname=None, gathered="1999-01-01"), survey_row(logs=6, fname="AM", mname="", gathered=None), survey_row(logs=7, fname="Q", muni=None),
    survey_row(logs=8, fname="R", muni="77", rbsba=""), survey_row(logs=9, fname="C", muni="2", rbsba=""), survey_row(logs=10, fname=None, gathered="1995-01-01"),
    survey_row(logs=1),
]


def _same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_counts_equal_the_reports_after_any_loads(spark, make_tables):
    t = make_tables(qp_farmer_raw=ROWS)
    for parts in (1, 2, 5):
        path = staging_path(spark, "t-state")
        for k in range(parts):
            distinct_state.add_load(t.qp_farmer_raw.where(F.col("logs") % parts == k), path)
        distinct_state.add_load(t.qp_farmer_raw.where("logs < 4"), path)  # known rows change nothing
        distinct_state.add_load(t.qp_farmer_raw.limit(0), path)
        assert _same(distinct_state.farmer_count_series(spark, path), farmers.farmer_count_series(t))
        assert _same(distinct_state.rbsba_table(spark, path, t.muni), registration.rbsba_table(t))
        # few farmers: a sketch still has each of them
        assert _same(distinct_state.farmer_count_series_sketched(spark, path), farmers.farmer_count_series(t))


def test_a_load_that_died_is_not_seen(spark, make_tables):
    t, path = make_tables(qp_farmer_raw=ROWS), staging_path(spark, "t-state-dead")
    distinct_state.add_load(t.qp_farmer_raw.where("logs <= 5"), path)
    before = distinct_state.farmer_count_series(spark, path).collect()
    spark.createDataFrame([("strict", "ghost", 1)], distinct_state.IDS).write.parquet(f"{path}/ids/dead")
    assert distinct_state.farmer_count_series(spark, path).collect() == before
    distinct_state.add_load(t.qp_farmer_raw, path)
    assert _same(distinct_state.farmer_count_series(spark, path), farmers.farmer_count_series(t))


def test_ids_are_dense_and_by_place(spark, synthetic):
    path = staging_path(spark, "t-state-ids")
    distinct_state.add_load(synthetic.qp_farmer_raw, path)
    ids = distinct_state._read(spark, path, "ids", distinct_state.IDS)
    r = ids.agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"), F.countDistinct("pid").alias("n"), F.count("*").alias("all")).first()
    assert (r.lo, r.hi) == (1, r.n) and r.n == r["all"]


def test_sketches_are_within_their_bound(spark, make_tables):
    """60,000 farmers of whom years share some: every estimate within four standard errors."""
    t = make_tables(qp_farmer_raw=ROWS[:1])
    many = spark.range(60000).select(
        F.col("id").alias("logs"), F.lit("1").alias("raw_municipality"), F.concat(F.lit("f"), F.col("id") % 45000).alias("raw_fname"), F.lit("m").alias("raw_mname"),
        F.lit("l").alias("raw_lname"), F.make_date(F.lit(1990) + (F.col("id") % 3).cast("int"), F.lit(1), F.lit(1)).alias("raw_dgathered"), F.lit("").alias("RBSBA"),
    )
    path = staging_path(spark, "t-sketch")
    for k in range(2):
        distinct_state.add_load(many.where(F.col("logs") % 2 == k), path)
    exact = {r.year_: r.count_farmer for r in farmers.farmer_count_series(dataclasses.replace(t, qp_farmer_raw=many)).collect()}
    got = {r.year_: r.count_farmer for r in distinct_state.farmer_count_series_sketched(spark, path).collect()}
    assert exact["all"] == 45000 and got.keys() == exact.keys()
    assert all(abs(got[y] - n) <= 4 * distinct_state.SKETCH_ERROR * n for y, n in exact.items())
    assert _same(distinct_state.farmer_count_series(spark, path), farmers.farmer_count_series(dataclasses.replace(t, qp_farmer_raw=many)))

"""Beyond the size check: with no broadcast allowed, every report takes the
shuffle-join path and returns the same rows. And over the curated parquet
tables (the bench's input) every report returns the same rows as over the
adapter views the oracle checks."""

import collections
import contextlib

import pytest

from ananas.plans.catalog import reports
from ananas.plans.jobs import JOBS
from ananas.session import staging_path
from ananas.sources.tables import Tables
from tests.conftest import SF_SMALL

NAMES = sorted(n for n in reports() if n not in JOBS)


@contextlib.contextmanager
def no_auto_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def bag(df):
    return collections.Counter(tuple(map(repr, r)) for r in df.collect())


@pytest.fixture(scope="module")
def small_dims(spark):
    return Tables.from_synthetic(spark, SF_SMALL)


@pytest.fixture(scope="module")
def big_dims(spark):
    return Tables.from_synthetic(spark, SF_SMALL)


@pytest.fixture(scope="module")
def curated(spark, small_dims):
    return small_dims.write(staging_path(spark, "t-curated"))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_without_broadcast_and_from_curated(spark, small_dims, big_dims, curated, name):
    want = bag(reports()[name](small_dims))
    with no_auto_broadcast(spark):
        got = bag(reports()[name](big_dims))
    assert got == want
    assert bag(reports()[name](curated)) == want


def test_dimension_join_shuffles_beyond_the_bound(spark, big_dims):
    with no_auto_broadcast(spark):
        plan = reports()["area_ranking"](big_dims)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

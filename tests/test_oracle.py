"""Every registered query agrees with its SQL oracle (DuckDB) on sf0.001."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as E
from ananas.plans.catalog import reports
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem".split()


def _norm(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE"}


def _duck_type(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return spark_type.upper().replace(" ", "")
    return _TYPES.get(spark_type, spark_type)


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


# Estimates, checked against a bound in test_distinct_state.py.
ESTIMATES = {"farmer_counts_sketched"}


def test_every_query_has_an_oracle():
    missing = set(reports()) - set(E.oracle_sql()) - ESTIMATES
    assert not missing, f"queries without oracle SQL: {sorted(missing)}"


@pytest.mark.parametrize("name", sorted(set(reports()) - ESTIMATES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    d_cols, d_rows = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _bag(s_cols, s_rows) == _bag(d_cols, d_rows)
    d_types = {r[0]: r[1].replace(" ", "") for r in duck.execute(f"describe {E.oracle_sql()[name]}").fetchall()}
    assert {c: _duck_type(t) for c, t in df.dtypes} == d_types


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["muni_name", "sum_area", "area_rank"]
    assert [r.area_rank for r in rows] == list(range(1, len(rows) + 1))


def test_oracle_uses_the_catalog_parameters():
    from ananas import oracle
    from ananas.plans import catalog

    assert (oracle.AS_OF_YEAR, oracle.MUNI, oracle.HARVEST_YEAR) == (catalog.AS_OF.year, catalog.MUNI, catalog.HARVEST_YEAR)
    assert "2001 - year(" in oracle.age("b") and (catalog.AS_OF.month, catalog.AS_OF.day) == (6, 30)

"""Keyset pages: equal to OFFSET pages, and their bound reaches the scan."""

import pytest
from pyspark.sql import functions as F

from ananas.operators.paging import CURSOR, page, page_after, pages_after
from ananas.session import staging_path

ROWS = [(k, None if k % 7 == 0 else k // 3, None if k % 11 == 0 else f"name {k % 5}") for k in range(60)]


@pytest.mark.parametrize("term", [None, "name 3", "nothing"])
def test_pages_equal_offset_pages(spark, term):
    df = spark.createDataFrame(ROWS, "id long, g long, name string")
    order = [F.col("g"), F.col("name"), F.col("id")]  # NULLs first, ties end with the key
    for number in (1, 2, 3, 8, 9, 10):
        want = [tuple(r) for r in page(df, order, number, 7, term, ["name"]).collect()]
        assert [tuple(r) for r in pages_after(df, order, number, 7, term, ["name"]).collect()] == want
    seen, cursor = [], None
    while rows := page_after(df, order, cursor, 13, term, ["name"]).collect():
        seen, cursor = seen + [r.id for r in rows], tuple(rows[-1][CURSOR])
    assert sorted(seen) == sorted(set(seen)) and len(seen) == (60 if term is None else sum(1 for r in ROWS if r[2] == term))


def test_a_deep_page_skips_what_lies_before(spark):
    path = staging_path(spark, "t-pages")
    spark.range(100_000).select("id", (F.col("id") * 2).alias("v")).repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(path)
    df = spark.read.parquet(path)
    deep = page_after(df, [F.col("id")], (79_999,), 8)
    assert [r.id for r in deep.collect()] == list(range(80_000, 80_008))
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,79999)" in plan and "TakeOrderedAndProject(limit=8" in plan
    with pytest.raises(ValueError):
        page_after(df, [F.col("id")], (1, 2))

"""Aggregation building blocks shared by the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def flag_counts(
    df: DataFrame,
    group_cols: Sequence[str | Column],
    person: Column,
    flags: Mapping[str, Column],
    total: str | None = "total_num",
) -> DataFrame:
    """Distinct persons per group, overall and for each flag, in one scan.

    Replaces N self-joined ``COUNT(DISTINCT person) ... WHERE flag_i``
    subqueries. Phase 1 groups by (group, person) and keeps ``max(flag_i)``;
    phase 2 sums the flags per group. Phase 1 shuffles on the pair, so a
    municipality holding a third of all rows is spread over many tasks, and
    both phases combine map-side. Spark's own plan for several distinct
    aggregates would ``Expand`` every row once per aggregate instead.

    A NULL person is not a person (``COUNT(DISTINCT NULL)`` is 0); it is
    dropped before phase 1. Each flag column holds the number of persons with
    at least one flagged row; ``total`` (if given) all persons of the group.
    """
    group_cols = [F.col(c) if isinstance(c, str) else c for c in group_cols]
    keyed = df.select(*group_cols, person.alias("_person"), *[
        F.coalesce(cond, F.lit(False)).cast("int").alias(name) for name, cond in flags.items()
    ]).where(F.col("_person").isNotNull())
    names = [c for c in keyed.columns if c not in ("_person", *flags)]
    per_person = keyed.groupBy(*names, "_person").agg(*[F.max(n).alias(n) for n in flags])
    aggs = [F.sum(n).cast("long").alias(n) for n in flags]
    if total:
        aggs.append(F.count(F.lit(1)).alias(total))
    return per_person.groupBy(*names).agg(*aggs)


def with_total_row(
    df: DataFrame,
    key: Column,
    key_out: str,
    aggs: Sequence[Column],
    label: str = "all",
) -> DataFrame:
    """Groups plus one total row, as a single ``ROLLUP``.

    The key comes out as text, ``label`` on the total row; ``_is_total`` tells
    the total from a group whose key is NULL. The total is computed from the
    rows, not summed from the groups, so distinct counts stay right.

    A rollup over no rows has no total row, while the reference's total query
    always returns one; a one-row fallback is folded into the (small) rollup
    output so the total row exists, with NULL aggregates, even then.
    """
    keyed = df.withColumn("_k", key)
    r = keyed.rollup("_k").agg(*aggs, F.grouping("_k").alias("_g"))
    names = [c for c in r.columns if c not in ("_k", "_g")]
    types = dict((f.name, f.dataType) for f in r.schema.fields)
    fallback = df.sparkSession.range(1).select(
        *[F.lit(None).cast(types[n]).alias(n) for n in names],
        F.lit(None).cast(types["_k"]).alias("_k"), F.lit(1).cast(types["_g"]).alias("_g"),
    )
    merged = r.unionByName(fallback).groupBy("_g", "_k").agg(*[F.max(n).alias(n) for n in names])
    return merged.select(
        *names,
        F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col("_k").cast("string")).alias(key_out),
        F.col("_g").cast("boolean").alias("_is_total"),
        F.col("_k").alias("_order"),
    )


def sums_with_total_row(df: DataFrame, key: Column, key_out: str, value: str, agg, name: str) -> DataFrame:
    """Sums of ``value`` by ``key`` and in total, as :func:`with_total_row` gives them.

    The rows are summed by key first; only that small result is rolled up,
    exactly, and ``agg`` (which may cut places) sees the sum."""
    sums = df.groupBy(key.alias("_y")).agg(F.sum(value).alias("_s"))
    return with_total_row(sums, F.col("_y"), key_out, [agg(F.sum("_s")).alias(name)])


def collect_scalars(parts: Sequence[DataFrame]) -> DataFrame:
    """Put several one-row results side by side without a cross join.

    Each part is a global aggregate with its own columns; they are stacked
    with ``unionByName`` and folded to one row by a global aggregate.
    """
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    cols = []
    for p in parts:
        cols += p.columns
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


def _bucket_of(c: Column, bounds: Sequence) -> Column:
    """Index of the first bound greater than ``c`` (0..len(bounds)), as a
    balanced tree of comparisons: about log2(len(bounds)) tests per row."""

    def rec(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < F.lit(bounds[mid]), rec(lo, mid)).otherwise(rec(mid + 1, hi))

    return rec(0, len(bounds))


def number_rows(
    df: DataFrame,
    order_col: str,
    out: str = "row_number",
    buckets: int = 256,
    rel_error: float | None = None,
    salt: int = 64,
    ordered: bool = False,
) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order_col)`` without a one-partition window.

    1. approximate quantiles of ``order_col`` give at most ``buckets - 1``
       bounds (a bounded list on the driver);
    2. each row's bucket is a pure function of its value, so a recomputed
       task puts it in the same bucket;
    3. rows are numbered within their bucket (a window partitioned by
       bucket), and the bucket's offset is the running total of the bucket
       counts: at most ``buckets * (salt + 1)`` rows, numbered on one task
       and broadcast.

    A value that fills more than one quantile step (it repeats in the bound
    list, e.g. one value holding a third of the rows) is spread over
    ``salt`` sub-buckets by a hash of the whole row. Equal values may be
    numbered in any order, so the result is still a row numbering by
    ``order_col``; the hot value's rows come first in its bucket, as it is
    the bucket's lower bound. NULLs come first, as in an ascending SQL sort,
    and are spread the same way. With a unique ``order_col`` (the reference
    numbers by ``id``) the numbers are deterministic. ``ordered=True``
    returns the rows in number order.
    """
    if rel_error is None:
        rel_error = 1.0 / (4 * buckets)
    probs = [i / buckets for i in range(1, buckets)]
    raw = df.approxQuantile(order_col, probs, rel_error) if buckets > 1 else []
    dtype = dict(df.dtypes)[order_col]
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        raw = [int(b) for b in raw]
    bounds = sorted(set(raw))
    hot = sorted({b for b in raw if raw.count(b) > 1})
    value = F.col(order_col)
    # NULLs sort first (bucket -1) and, like a hot value, are spread by a row hash
    keyed = df.withColumn("_bucket", F.when(value.isNull(), F.lit(-1)).otherwise(_bucket_of(value, bounds)))
    spread = value.isNull() | value.isin(*hot) if hot else value.isNull()
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns])
    keyed = keyed.withColumn("_sub", F.when(spread, F.pmod(row_hash, F.lit(salt))).otherwise(F.lit(salt)).cast("int"))
    counts = keyed.groupBy("_bucket", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_bucket", "_sub",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_bucket", "_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    local = F.row_number().over(Window.partitionBy("_bucket", "_sub").orderBy(value))
    # range-partitioned on the bucket key, so partitions come out in number order and a
    # final sort by number needs no further exchange
    numbered = keyed.repartitionByRange("_bucket", "_sub").withColumn("_local", local)
    result = (
        numbered.join(F.broadcast(offsets), ["_bucket", "_sub"], "inner")  # <= buckets * (salt + 1) rows
        .withColumn(out, (F.col("_offset") + F.col("_local")).cast("long"))
    )
    if ordered:
        result = result.orderBy("_bucket", "_sub", order_col)
    return result.drop("_bucket", "_sub", "_offset", "_local")


def rank_small(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY ..)`` over an already aggregated result.

    Only for inputs with one row per dimension member (e.g. municipality):
    an unpartitioned window runs on one task.
    """
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))

"""Search and paging of result tables (the dashboard's table widgets)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, term: str | None, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows where every word of ``term`` occurs, ignoring case, in at
    least one of ``columns`` (all columns by default) shown as text."""
    if not term or not term.strip():
        return df
    cols = list(columns or df.columns)
    cond: Column | None = None
    for word in term.lower().split():
        hit = None
        for c in cols:
            h = F.coalesce(F.lower(F.col(c).cast("string")).contains(F.lit(word)), F.lit(False))
            hit = h if hit is None else hit | h
        cond = hit if cond is None else cond & hit
    return df.where(cond)


def page(df: DataFrame, order_by: Sequence[str | Column], number: int = 1, size: int = 8,
         term: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One page of a searched, sorted table: ``ORDER BY .. LIMIT size OFFSET
    (number - 1) * size``. The order must be total (end with a key) for pages
    to be stable. Spark plans this as a top-k, so only ``number * size`` rows
    per partition travel to the final sort."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    found = search(df, term, columns).orderBy(*order_by)
    return found.offset((number - 1) * size).limit(size) if number > 1 else found.limit(size)


#: The column of :func:`page_after` that holds a row's place in the order.
CURSOR = "_cursor"


def page_after(df: DataFrame, order_by: Sequence[Column], cursor: Sequence | None = None, size: int = 8,
               term: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The next ``size`` rows after ``cursor``, the ``_cursor`` of the last row seen (None: from the start).

    However deep, a page reads no row of an earlier one: the order's columns are compared with the
    cursor before anything is sorted, so the scan skips files and row groups that lie before it where the
    table is sorted by them, and each task sends at most ``size`` rows. ``order_by`` is ascending, NULLs
    first, and total (it ends with a key)."""
    if size < 1:
        raise ValueError("page size starts at 1")
    found = search(df, term, columns)
    if cursor is not None:
        later, same = None, F.lit(True)
        for c, v in zip(order_by, cursor, strict=True):
            here = same & (c.isNotNull() if v is None else c > F.lit(v))
            later = here if later is None else later | here
            same = same & (c.isNull() if v is None else c == F.lit(v))
        # the first column alone, too: a bound that reaches the scan
        first = F.lit(True) if cursor[0] is None else order_by[0] >= F.lit(cursor[0])
        found = found.where(first & later)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_by)]).alias(CURSOR)
    return found.select("*", key).orderBy(*order_by).limit(size)


def pages_after(df: DataFrame, order_by: Sequence[Column], number: int, size: int = 8, term: str | None = None,
                columns: Sequence[str] | None = None) -> DataFrame:
    """Page ``number`` by following the cursors of the pages before it, as a reader does who turns pages."""
    cursor = None
    for _ in range(number - 1):
        rows = page_after(df, order_by, cursor, size, term, columns).select(CURSOR).collect()  # one page
        if len(rows) < size:
            return df.limit(0)
        cursor = tuple(rows[-1][CURSOR])
    return page_after(df, order_by, cursor, size, term, columns).drop(CURSOR)

"""Column expressions that carry the reports' business rules.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- numbers

def trunc_dec(c: ColumnOrName, n: int, precision: int = 38) -> Column:
    """MySQL ``TRUNCATE(x, n)``: cut toward zero at ``n`` decimals.

    Works on exact decimals, so the result does not depend on the order in
    which partial sums were added. The result type is ``decimal(precision, n)``.
    """
    x = _c(c)
    cut = F.when(x >= 0, F.floor(x, F.lit(n))).otherwise(F.ceil(x, F.lit(n)))
    return cut.cast(f"decimal({precision},{n})")


def _idiv(a: Column, b: Column) -> Column:
    """Exact integer division of non-negative ``a`` by positive ``b``."""
    a = a.cast("decimal(38,0)")
    b = b.cast("decimal(38,0)")
    return (a - a % b) / b


def round_div(num: ColumnOrName, den: ColumnOrName, scale: int) -> Column:
    """``num / den`` for whole numbers, rounded half away from zero at ``scale``.

    Exact integer arithmetic, so no intermediate rounding; NULL when the
    denominator is zero or NULL. Result type ``decimal(38, scale)``.
    """
    num, den = _c(num), _c(den)
    a, b = F.abs(num).cast("decimal(38,0)"), F.abs(den).cast("decimal(38,0)")
    q = _idiv(a * (2 * 10**scale) + b, b * 2)
    signed = F.when((num < 0) != (den < 0), -q).otherwise(q).cast("decimal(38,0)")
    value = signed / F.lit(10**scale) if scale else signed
    return F.when(den.isNull() | (den == 0), F.lit(None)).otherwise(value).cast(f"decimal(38,{scale})")


def mysql_ratio_pct(num: ColumnOrName, den: ColumnOrName, n: int, div_scale: int | None = None) -> Column:
    """``TRUNCATE(num / den * 100, n)`` of whole numbers.

    The exact ratio is cut toward zero: 2 of 3 is 66.66. With ``div_scale``
    the quotient is first rounded half away from zero at that many places,
    as a displayed division would be (4 places: 0.6667 -> 66.67). A zero or
    NULL denominator gives NULL. Result type ``decimal(38, n)``.
    """
    num, den = _c(num), _c(den)
    if div_scale is None:
        a, b = F.abs(num).cast("decimal(38,0)"), F.abs(den).cast("decimal(38,0)")
        cut = _idiv(a * (100 * 10**n), b)
        signed = F.when((num < 0) != (den < 0), -cut).otherwise(cut).cast("decimal(38,0)")
        pct = signed / F.lit(10**n)
        pct = F.when(den.isNull() | (den == 0), F.lit(None)).otherwise(pct)
    else:
        pct = round_div(num, den, div_scale) * F.lit(100)
    return trunc_dec(pct, n)


def sum_flag(cond: Column) -> Column:
    """MySQL ``SUM(cond)``: NULL comparisons are skipped; no rows -> NULL."""
    return F.sum(cond.cast("long"))


def avg_exact(c: ColumnOrName, in_scale: int = 2, grow: int = 4) -> Column:
    """MySQL ``AVG`` of a decimal with ``in_scale`` places: the scale grows by
    ``grow`` and the last place is rounded half away from zero, exactly."""
    x = _c(c).cast(f"decimal(38,{in_scale})")
    units = F.sum(x) * F.lit(10**in_scale)
    q = round_div(units, F.count(x), in_scale + grow)
    return (q / F.lit(10**in_scale)).cast(f"decimal(38,{in_scale + grow})")


# ---------------------------------------------------------------- text keys

def person_key(first: ColumnOrName, middle: ColumnOrName, last: ColumnOrName, mode: str = "ws") -> Column:
    """The person key behind every distinct farmer count.

    ``strict`` is the dashboard's unseparated ``CONCAT`` (NULL if any part is
    NULL, and "AB"+"C" equals "A"+"BC"); ``ws`` is the service module's
    ``CONCAT_WS('|')``, which skips NULL parts and is never NULL.
    """
    parts = [_c(first), _c(middle), _c(last)]
    if mode == "strict":
        return F.concat(*parts)
    if mode == "ws":
        return F.concat_ws("|", *parts)
    raise ValueError(f"unknown person key mode {mode!r}")


def is_blank(c: ColumnOrName) -> Column:
    """``COALESCE(c, '') = ''``."""
    return F.coalesce(_c(c), F.lit("")) == ""


def id_sort_key(c: ColumnOrName) -> list[Column]:
    """``ORDER BY LENGTH(id), id``: ids held as text sort as numbers."""
    return [F.octet_length(_c(c)), _c(c)]


# ---------------------------------------------------------------- calendar

def year_of(c: ColumnOrName) -> Column:
    """``YEAR(d)`` as bigint (counts and years are bigint in every output)."""
    return F.year(_c(c)).cast("long")


def in_year(c: ColumnOrName, year: int) -> Column:
    """``YEAR(d) = year`` as a half-open range, so both bounds reach the scan."""
    return (_c(c) >= F.lit(dt.date(year, 1, 1))) & (_c(c) < F.lit(dt.date(year + 1, 1, 1)))


def since_year(c: ColumnOrName, year: int) -> Column:
    """``YEAR(d) >= year`` as a range."""
    return _c(c) >= F.lit(dt.date(year, 1, 1))


def in_years(c: ColumnOrName, first: int, last: int) -> Column:
    """``first <= YEAR(d) <= last`` as a range."""
    return (_c(c) >= F.lit(dt.date(first, 1, 1))) & (_c(c) < F.lit(dt.date(last + 1, 1, 1)))


def short_month(c: ColumnOrName) -> Column:
    """MySQL ``DATE_FORMAT(d, '%b')``: Jan, Feb, ..."""
    return F.date_format(_c(c), "MMM")


def long_month(c: ColumnOrName) -> Column:
    """MySQL ``MONTHNAME(d)``: January, February, ..."""
    return F.date_format(_c(c), "MMMM")


def age_at(birth: ColumnOrName, as_of: dt.date) -> Column:
    """Completed years at ``as_of``."""
    b = _c(birth)
    before_birthday = (F.month(b) > as_of.month) | ((F.month(b) == as_of.month) & (F.dayofmonth(b) > as_of.day))
    return (F.lit(as_of.year) - F.year(b) - before_birthday.cast("int")).cast("long")


# The age-band views are named after their upper edge
# (twenty_five ... eighty_five, and ninety_five in the male report).
AGE_BAND_EDGES = (25, 35, 45, 55, 65, 75, 85)
AGE_BAND_EDGES_MALE = (25, 35, 45, 55, 65, 75, 85, 95)


def band_labels(edges: Sequence[int]) -> list[str]:
    """``<=25``, ``26-35``, ... for the given upper edges."""
    out = [f"<={edges[0]}"]
    out += [f"{lo + 1}-{hi}" for lo, hi in zip(edges, edges[1:])]
    return out


def age_band(age: ColumnOrName, edges: Sequence[int]) -> Column:
    """The band label of an age; NULL above the last edge."""
    a = _c(age)
    labels = band_labels(edges)
    expr = F.when(a <= edges[0], F.lit(labels[0]))
    for hi, label in zip(edges[1:], labels[1:]):
        expr = expr.when(a <= hi, F.lit(label))
    return expr


# ---------------------------------------------------------------- display helpers

# Fixed value: the thousands-separator pattern of the currency helper.
THOUSANDS_PATTERN = r"(\d)(?=(\d\d\d)+(?!\d))"


def format_currency(c: ColumnOrName) -> Column:
    """Thousands separators on the value's text form: 1234567 -> 1,234,567."""
    return F.regexp_replace(_c(c).cast("string"), THOUSANDS_PATTERN, "$1,")


def change_direction(c: ColumnOrName) -> Column:
    """``down`` when the change is <= 0 (a missing change counts as 0), else ``up``."""
    return F.when(F.coalesce(_c(c).cast("double"), F.lit(0.0)) <= 0, F.lit("down")).otherwise(F.lit("up"))


def change_status(v1: ColumnOrName, v2: ColumnOrName, as_text: bool = False) -> Column:
    """``Decreased`` when v1 < v2, else ``Increased`` (so equal is Increased).

    The page receives the sums as text, so its comparison is by characters
    ("9" > "10"); ``as_text=True`` keeps that, the default compares numbers.
    """
    a, b = _c(v1), _c(v2)
    if as_text:
        a, b = a.cast("string"), b.cast("string")
    less = F.coalesce(a < b, F.lit(False)) if as_text else (
        F.coalesce(a.cast("decimal(38,4)"), F.lit(0)) < F.coalesce(b.cast("decimal(38,4)"), F.lit(0))
    )
    return F.when(less, F.lit("Decreased")).otherwise(F.lit("Increased"))

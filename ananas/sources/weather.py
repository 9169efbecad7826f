"""S2: rainfall calendar sheets -> ``weather_data`` rows.

A sheet is one CSV per year: its header row holds the year (a number, in
any column), a label column, then one column per month; each following row
is a day. The upload form reads the year and month from the header, the day
from the row's position, skips blank cells, and writes ``(date, amount,
'N/A')`` per cell.

Spark plan: read the sheets without a header (each file's header differs),
number each file's rows with a window partitioned by file (a sheet has at
most 32 rows, so every window is tiny and the job scales with the number of
files), carry the header cells to every row of the same file within that
same window, then explode the month cells. Bad cells go to a rejects table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Month-name prefixes in calendar order.
MONTH_PREFIXES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


# A comma with an even number of quotes after it ends a cell.
CELL_END = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_sheets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of the sheets as arrays of all their cells, however many there are."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    cells = F.split(F.regexp_replace("value", "^\ufeff|\r$", ""), CELL_END, -1)
    bare = F.transform(cells, lambda c: F.replace(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    return raw.select(F.transform(bare, lambda c: F.when(c != "", c)).alias("cells"),
                      F.col("_metadata.file_path").alias("_source"),
                      F.monotonically_increasing_id().alias("_pos"))


def parse_sheets(sheets: DataFrame, day_from: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(rows ``date, rain_amount, note``, rejects ``_source, ordinal, header, cell, _reject``).

    ``day_from="ordinal"`` takes the day from the row's position (the upload
    form's rule, so a sheet missing a row shifts its days); ``"label"`` from
    the label column's own value.
    """
    w = Window.partitionBy("_source").orderBy("_pos")
    per_file = Window.partitionBy("_source")
    rows = sheets.withColumn("ordinal", F.row_number().over(w) - 1).withColumn(
        "header", F.max(F.when(F.col("ordinal") == 0, F.col("cells"))).over(per_file)
    ).where(F.col("ordinal") > 0)
    is_num = lambda x: F.coalesce(F.trim(x).rlike("^[0-9]+$"), F.lit(False))
    with_pos = F.transform(F.col("header"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    text_cols = F.filter(with_pos, lambda s: ~is_num(s["h"]) & s["h"].isNotNull())
    rows = rows.select(
        "_source", "ordinal", "cells", "header",
        F.trim(F.try_element_at(F.filter(F.col("header"), is_num), F.lit(1))).alias("_year_text"),
        F.try_element_at(text_cols, F.lit(1))["i"].alias("_label_pos"),
        F.slice(text_cols, F.lit(2), F.size(text_cols)).alias("_months"),
    )
    cells = rows.select(
        "_source", "ordinal", "header", "_year_text", "cells",
        F.try_element_at("cells", F.col("_label_pos") + 1).alias("_label"),
        F.explode("_months").alias("m"),
    ).select(
        "_source", "ordinal", "header", "_year_text", "_label",
        F.col("m.h").alias("_month_text"),
        F.try_element_at("cells", F.col("m.i") + 1).alias("cell"),
    )
    cells = cells.where(F.col("cell").isNotNull() & (F.trim("cell") != ""))
    month_of = F.create_map(*[x for i, p in enumerate(MONTH_PREFIXES) for x in (F.lit(p), F.lit(i + 1))])
    month = month_of[F.lower(F.substring(F.trim("_month_text"), 1, 3))]
    year = F.col("_year_text").try_cast("int")
    day = F.col("ordinal").cast("int") if day_from == "ordinal" else F.trim("_label").try_cast("int")
    first = F.make_date(year, month, F.lit(1))
    sane = year.between(1, 9999) & month.isNotNull() & day.isNotNull()
    valid = F.coalesce(sane & (day >= 1) & (day <= F.dayofmonth(F.last_day(F.when(sane, first)))), F.lit(False))
    date = F.when(valid, F.make_date(year, month, day))
    amount = F.trim("cell").try_cast("decimal(10,2)")
    reason = F.when(~valid, F.lit("date")).when(amount.isNull(), F.lit("amount"))
    parsed = cells.select("_source", "ordinal", "header", "cell", date.alias("date"), amount.alias("rain_amount"),
                          reason.alias("_reject"))
    good = parsed.where(F.col("_reject").isNull()).select("date", "rain_amount", F.lit("N/A").alias("note"), "_source")
    bad = parsed.where(F.col("_reject").isNotNull()).select("_source", "ordinal", "header", "cell", "_reject")
    return good, bad


def ingest_weather(spark: SparkSession, path: str | list[str], day_from: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    return parse_sheets(read_sheets(spark, path), day_from)


def write_sheets(daily: DataFrame, path: str) -> None:
    """Lay daily totals ``(date, rain_amount)`` out as one calendar sheet per
    year: header ``<year>,Day,Jan..Dec``, then rows 1..31 with blank cells for
    missing or impossible days. The inverse of :func:`ingest_weather`.

    All rows of a year go to one task (at most 32 lines per year) and are
    written in order into that year's folder."""
    y = F.year("date")
    cells = daily.select(y.alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"),
                         F.col("rain_amount").cast("string").alias("v"))
    grid = cells.groupBy("year", "day").agg(
        *[F.max(F.when(F.col("month") == m + 1, F.col("v"))).alias(f"m{m + 1}") for m in range(12)]
    )
    days = F.sequence(F.lit(1), F.lit(31))
    years = cells.select("year").distinct()
    full = years.select("year", F.explode(days).alias("day")).join(grid, ["year", "day"], "left")
    body = full.select("year", F.col("day").alias("ordinal"), F.concat_ws(",", F.col("day").cast("string"), F.col("day").cast("string"), *[
        F.coalesce(F.col(f"m{m + 1}"), F.lit("")) for m in range(12)
    ]).alias("line"))
    # the first cell of a data row is under the year column and is ignored by the reader
    names = ",".join(p.capitalize() for p in MONTH_PREFIXES)
    head = years.select("year", F.lit(0).alias("ordinal"), F.concat(F.col("year").cast("string"), F.lit(f",Day,{names}")).alias("line"))
    lines = body.unionByName(head)
    (lines.repartition("year").sortWithinPartitions("year", "ordinal").select("year", "line")
     .write.mode("overwrite").partitionBy("year").text(path))

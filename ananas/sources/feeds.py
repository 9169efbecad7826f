"""CSV feeds -> curated tables (S1, S3-S7, S9), with a rejects side table.

Every feed is read as text by the names in its header (S1), the names are mapped
to curated columns, each typed column is parsed with a ``try_*`` function,
and a row whose non-blank cell fails to parse goes to the rejects table with
the reason instead of raising. Text cells stay text, a blank cell is ``''``
(as the upload forms read it); a blank typed cell is NULL.

The parse is a pure DataFrame -> DataFrame function, shared by the batch
jobs here and the drop-folder stream in :mod:`ananas.streaming.ingest`.
"""

from __future__ import annotations

import csv
import functools
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ananas.operators.sync import sync_barangay_id, sync_farmer_id, sync_municipality_id
from ananas.session import shuffles_dropped
from ananas.sources import schemas

# A day or month may have one digit or two, as MySQL reads dates.
DEFAULT_DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d")
CORRUPT = "_corrupt_record"
MISSING = "_missing"


def csv_options(multi_line: bool = True) -> dict[str, str]:
    """Reader options of the feeds: doubled quotes, quoted line breaks, the raw
    line of a row with too few or too many cells. Quoted line breaks need a
    whole file in one task; ``multi_line=False`` splits large files instead."""
    return {
        "header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"',
        "multiLine": str(multi_line).lower(), "columnPruning": "false",
    }


@dataclass(frozen=True)
class Feed:
    """One CSV feed: header -> column map and the type of each typed column."""

    name: str
    headers: Mapping[str, str]
    types: Mapping[str, str]  # column -> "date" | "date:<fmt>" | a Spark SQL type


SURVEY = Feed(
    "survey", schemas.SURVEY_HEADERS,
    {
        "raw_bdate": "date", "raw_area": "decimal(18,4)", "raw_population": "bigint",
        "raw_dgathered": "date", "raw_dharvest": "date",
    },
)
SOIL = Feed(
    "soil", schemas.SOIL_HEADERS,
    {"area": "decimal(18,4)", "sampled": "date:d-M-yyyy", "ph": "decimal(10,4)", "n": "decimal(10,4)",
     "p": "decimal(10,4)", "k": "decimal(10,4)"},
)
PRICE = Feed("price", schemas.PRICE_HEADERS, {"date": "date", "med_price": "decimal(18,2)", "lg_price": "decimal(18,2)"})
HARVEST = Feed("harvest", schemas.HARVEST_HEADERS, {"Production": "decimal(18,4)", "year_gathered": "date"})
PESTS = Feed("pests", schemas.PEST_HEADERS, {"report_count": "bigint"})

FEEDS = {f.name: f for f in (SURVEY, SOIL, PRICE, HARVEST, PESTS)}


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``file``: every file under ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("_metadata.file_path").alias("file")
    )


def scan_files(spark: SparkSession, files: list[str]) -> list[tuple[str, str, str]]:
    """(file, header, digest) of files with a line, in one pass over them that splits large files.

    ``digest`` stands for the file's content: how many lines it has, their bytes, and two sums
    over the lines' hashes. A file under another name, or with its lines in another order, has
    the same one. Lines are summed as numbers alone, so no line is sorted or kept; the header of each
    layout is read from one of its files."""
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("pos"), F.octet_length("value").alias("bytes"),
        F.xxhash64("value").alias("h1"), F.xxhash64("value", F.lit("second")).alias("h2"),
    )
    low = (1 << 21) - 1  # three parts of a hash: their sums fit a long for 2^41 lines
    parts = lambda h: (F.shiftright(h, 42), F.shiftright(h, 21).bitwiseAND(low), F.col(h).bitwiseAND(low))
    found = lines.groupBy("file").agg(
        F.min_by("h1", F.when(F.col("at") == 0, F.col("pos"))).alias("first"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
        *[F.sum(c).alias(f"{h}_{i}") for h in ("h1", "h2") for i, c in enumerate(parts(h))],
    ).collect()  # a row a file
    one_of = {r["first"]: r["file"] for r in found}  # a few layouts
    headers = {first: _first_line(spark, f) for first, f in one_of.items()}
    total = lambda r, h: (r[f"{h}_0"] << 42) + (r[f"{h}_1"] << 21) + r[f"{h}_2"]
    return [(r["file"], headers[r["first"]], f"{r['n']}-{r['bytes']}-{total(r, 'h1')}-{total(r, 'h2')}") for r in found]


def _first_line(spark: SparkSession, file: str) -> str:
    return spark.read.text(file).where(F.col("_metadata.file_block_start") == 0).first()["value"]


def grouped(headers: Mapping[str, str], files: list[str]) -> dict[str, list[str]]:
    """Files with a line by their header; a few layouts."""
    out: dict[str, list[str]] = {}
    for f in files:
        if f in headers:
            out.setdefault(headers[f], []).append(f)
    return out


def layouts(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Files by their header line (a few layouts; the file names are the reader's own list)."""
    headers = {f: header for f, header, _ in scan_files(spark, files)} if files else {}
    return grouped(headers, sorted(headers))


def read_files(spark: SparkSession, files: list[str], feed: Feed, multi_line: bool = True,
               headers: Mapping[str, str] | None = None) -> DataFrame:
    """S1: CSV files with a header row, every field as trimmed text.

    Cells are found by the name in each file's header, as the upload form
    finds them: the order of columns does not matter, others are ignored (of
    two with one name the last counts), and a column that the feed needs but
    the file lacks is named in ``_missing``. A blank cell is ``''``.
    ``_source`` is the file each row came from."""
    parts = []
    by_header = layouts(spark, files) if headers is None else grouped(headers, files)
    for header, own in by_header.items():
        names = [n.strip() for n in next(csv.reader([header.lstrip("\ufeff")]), [])]
        at = {n: i for i, n in enumerate(names)}
        fields = [T.StructField(f"c{i}", T.StringType(), True) for i in range(max(1, len(names)))]
        schema = T.StructType(fields + [T.StructField(CORRUPT, T.StringType(), True)])
        raw = spark.read.schema(schema).options(**csv_options(multi_line)).csv(own)
        missing = ";".join(h for h in feed.headers if h not in at)
        cells = [F.trim(F.coalesce(F.col(f"c{at[h]}"), F.lit(""))) if h in at else F.lit("") for h in feed.headers]
        parts.append(raw.select(
            *[c.alias(h) for c, h in zip(cells, feed.headers)], CORRUPT,
            F.lit(missing or None).cast("string").alias(MISSING), F.col("_metadata.file_path").alias("_source"),
        ))
    if not parts:
        text = [T.StructField(n, T.StringType(), True) for n in (*feed.headers, CORRUPT, MISSING, "_source")]
        return spark.createDataFrame([], T.StructType(text))
    return functools.reduce(DataFrame.unionByName, parts)


def read_text(spark: SparkSession, path: str, feed: Feed) -> DataFrame:
    """S1 over every file under ``path``."""
    return read_files(spark, [r["file"] for r in list_files(spark, path).collect()], feed)


def _parse(cell: Column, kind: str, date_formats) -> Column:
    if kind.startswith("date"):
        fmts = [kind.split(":", 1)[1]] if ":" in kind else list(date_formats)
        tried = [F.try_to_date(cell, f) for f in fmts]
        if fmts[0] == "yyyy-M-d":  # a date that is written as Spark writes it needs no formatter
            cast = cell.try_cast("date")
            tried.insert(0, F.when(F.length(cell) == 10, F.when(cast.cast("string") == cell, cast)))
        return F.coalesce(*tried)
    return cell.try_cast(kind)


def parse(text: DataFrame, feed: Feed, date_formats=DEFAULT_DATE_FORMATS) -> DataFrame:
    """Typed columns plus ``_reject``: NULL when the row is good, else
    ``malformed`` (too few or too many cells), ``header`` with the columns the
    file lacks, ``empty`` (every cell blank) or the names of the cells that
    failed to parse."""
    cells, out, problems, failed = [], [], [], []
    if CORRUPT in text.columns:
        problems.append(F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed")))
    if MISSING in text.columns:
        problems.append(F.concat(F.lit("header:"), F.col(MISSING)))
    all_blank = None
    for header, name in feed.headers.items():
        cell = F.trim(F.col(f"`{header}`"))
        blank = cell.isNull() | (cell == "")
        all_blank = blank if all_blank is None else all_blank & blank
        if name in feed.types:
            cells += [F.when(~blank, _parse(cell, feed.types[name], date_formats)).alias(name), (~blank).alias(f"_{name}_given")]
            failed.append(F.when(F.col(f"_{name}_given") & F.col(name).isNull(), F.lit(name)))
        else:
            cells.append(F.coalesce(F.col(f"`{header}`"), F.lit("")).alias(name))
        out.append(name)
    problems.append(F.when(all_blank, F.lit("empty")))
    # a generated row: a cell is parsed once for its value and its check, whatever is filtered later
    parsed = text.select(*cells, "_source", F.concat_ws(",", *problems).alias("_row_problems"))
    reject = F.concat_ws(",", F.nullif("_row_problems", F.lit("")), *failed)
    return parsed.select(F.inline(F.array(F.struct(*out, "_source", F.when(reject != "", reject).alias("_reject")))))


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejects with the reason)."""
    good = parsed.where(F.col("_reject").isNull()).drop("_reject")
    bad = parsed.where(F.col("_reject").isNotNull())
    return good, bad


def ingest(spark: SparkSession, path: str, feed: Feed, date_formats=DEFAULT_DATE_FORMATS) -> tuple[DataFrame, DataFrame]:
    """S3-S7: read, parse and split one feed."""
    return split(parse(read_text(spark, path, feed), feed, date_formats))


def curate_survey(good: DataFrame, tbl_muni: DataFrame, farmer_demo: DataFrame | None = None,
                  tbl_barangay: DataFrame | None = None) -> DataFrame:
    """S3 + N2, then N1 and N3 where their tables are given: survey rows in the curated shape.

    The feed carries place *names*; ``raw_municipality`` becomes the
    municipality id where the name is known (N2) and keeps the name
    otherwise, the name stays in ``raw_municipality_name``. ``f_id`` is the
    registered farmer of that name (N1), the barangay name becomes its id
    within the municipality (N3). New rows are marked ``is_synced`` rather
    than with a magic ``f_id``."""
    rows = good.withColumn("raw_municipality", F.col("raw_municipality_name")).withColumn(
        "raw_barangay", F.col("raw_barangay_name")
    ).withColumn("f_id", F.lit(None).cast("string")).withColumn("is_synced", F.lit(False))
    rows = sync_municipality_id(rows, tbl_muni)
    if farmer_demo is not None:
        rows = sync_farmer_id(rows, farmer_demo)
    return sync_barangay_id(rows, tbl_barangay) if tbl_barangay is not None else rows


def pest_catalogue(loaded: DataFrame) -> DataFrame:
    """S7 as the reports read it: each entry's share of its category's reports
    in percent, and its rank there (entries with equal counts share one).

    Ranks come from the distinct report counts of a category, so no category
    is sorted as a whole."""
    tally = loaded.groupBy("category", "report_count").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("category")
    above = by.orderBy(F.col("report_count").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.select(
        F.col("category").alias("_c"), F.col("report_count").alias("_r"),
        (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("int").alias("rank"),
        (F.col("report_count") * 100.0 / F.sum(F.col("report_count") * F.col("_n")).over(by)).alias("percent"),
    )
    same = loaded["category"].eqNullSafe(F.col("_c")) & loaded["report_count"].eqNullSafe(F.col("_r"))
    return loaded.join(tally, same, "left").select(*loaded.columns, "percent", "rank")


# ------------------------------------------------------------------ loads

# A table is a folder: rows/load_id=.., rejects/load_id=.. and the ledger, which
# names each file with the load that holds it. A load exists once the ledger has it.
# ``digest`` is the file's content: a copy under another name is noted without rows.
# ``replaces`` names the load whose rows a load rewrites (its rejects still hold);
# ``load_id`` begins with the position of the load.
LEDGER = "file string, load_id string, accepted long, rejected long, last_key long, digest string, replaces string"

# Staged rows are curated, and loads rewritten, in batches of their files, so that what the joins shuffle lies
# on disk for one batch at a time: at most BATCHES, of so many bytes or more. Staged files have so many rows at most.
BATCHES = 8
BATCH_BYTES = 256 << 20
STAGED_ROWS = 2_000_000


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has staged."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder that this library has staged."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"{path} could not be renamed")


def ledger(spark: SparkSession, target: str) -> DataFrame:
    if not path_exists(spark, f"{target}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{target}/ledger")


def position(load_id: Column | str) -> Column:
    """The place of a load among all loads of its table, from 0 on."""
    return F.substring_index(load_id, "-", 1).cast("long")


def loads(spark: SparkSession, target: str, upto: int | None = None) -> list[str]:
    """Loads whose rows the table has, after its first ``upto`` loads (all by default)."""
    entries = ledger(spark, target)
    if upto is not None:
        entries = entries.where(position("load_id") < upto)
    gone = entries.select(F.col("replaces").alias("load_id")).where("load_id is not null")
    live = entries.where("load_id is not null").select("load_id").distinct().join(gone, "load_id", "left_anti")
    return [r["load_id"] for r in live.orderBy("load_id").collect()]


def _published(spark: SparkSession, target: str, part: str, upto: int | None) -> DataFrame | None:
    if part == "rejects":  # a rewritten load keeps the rejects of its first writing
        entries = ledger(spark, target).where("replaces is null")
        entries = entries if upto is None else entries.where(position("load_id") < upto)
        found = [r["load_id"] for r in entries.select("load_id").distinct().orderBy("load_id").collect()]
    else:
        found = loads(spark, target, upto)
    return _rows_of(spark, target, part, found)


def _rows_of(spark: SparkSession, target: str, part: str, found: list[str]) -> DataFrame | None:
    paths = [p for p in (f"{target}/{part}/load_id={x}" for x in found) if path_exists(spark, p)]
    return spark.read.option("basePath", f"{target}/{part}").parquet(*paths) if paths else None


def read_loaded(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame:
    """The rows of all published loads of a table; with ``upto``, as the table was after so many loads."""
    rows = _published(spark, target, "rows", upto)
    if rows is None:
        raise ValueError(f"nothing is loaded in {target}")
    return rows


def read_rejects(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame:
    """The rejects of all published loads of a table, with their reasons."""
    bad = _published(spark, target, "rejects", upto)
    if bad is None:
        raise ValueError(f"nothing is loaded in {target}")
    return bad


def _task_local(row: str) -> tuple[Column, Column]:
    """(task, place in it) of a written ``monotonically_increasing_id``."""
    return F.shiftright(row, 33), F.col(row).bitwiseAND((1 << 33) - 1)


def task_starts(df: DataFrame, row: str = "_row") -> DataFrame:
    """How many rows the tasks before each have (``_task``, ``_before``): a row a task."""
    task, local = _task_local(row)
    ends = df.groupBy(task.alias("_task")).agg((F.max(local) + 1).alias("_width"))
    before = F.sum("_width").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    return ends.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))


def with_keys(df: DataFrame, first: int, row: str = "_row", starts: DataFrame | None = None) -> DataFrame:
    """``df`` with ``key`` from ``first`` on, increasing and unique: each task's rows follow the
    last of the task before. ``row`` is a written ``monotonically_increasing_id``. Where ``df`` is a
    part of the rows, ``starts`` are the :func:`task_starts` of all."""
    task, local = _task_local(row)
    keyed = df.withColumn("_task", task).join(task_starts(df, row) if starts is None else starts, "_task")
    return keyed.withColumn("key", (F.lit(first) + F.col("_before") + local).cast("long")).drop("_task", "_before")


def batches(spark: SparkSession, folder: str) -> list[list[str]]:
    """The files of a folder of rows in order of their names, cut into at most ``BATCHES`` lists of
    ``BATCH_BYTES`` or more each (the last may have fewer). Contents are not read."""
    sizes = sorted(map(tuple, spark.read.format("binaryFile").load(folder).select("path", "length").collect()))
    enough = max(BATCH_BYTES, -(-sum(size for _, size in sizes) // BATCHES))
    out: list[list[str]] = []
    room = 0
    for f, size in sizes:
        if room <= 0:
            out.append([])
            room = enough
        out[-1].append(f)
        room -= size
    return out


def load_files(spark: SparkSession, files: DataFrame, target: str, read, transform=None, key: str | None = None) -> tuple[int, int]:
    """Load those of ``files`` (``file``) that the ledger doesn't have; returns the table's (accepted, rejected) counts.

    ``read(spark, paths)`` gives (good rows, rejects), and is handed the first line of
    each path too if it has ``takes_headers``; its ``parsed`` gives both in one, told apart by ``_reject``; ``transform`` curates the good ones. Only new files are read. A file whose content the table already has
    under another name, or that another new file has too, is noted in the ledger
    and not loaded. Rows and rejects are written to folders of this load, and one
    ledger file publishes both: a load that died before that is not seen, and its
    files are loaded again. ``key`` names a column that numbers the table's rows.
    Rows are curated in :func:`batches` of their staged files, each dropped when its rows are written.
    One loader writes to a table at a time.
    """
    with shuffles_dropped(spark):
        return _load_files(spark, files, target, read, transform, key)


def _load_files(spark: SparkSession, files: DataFrame, target: str, read, transform, key: str | None) -> tuple[int, int]:
    known = ledger(spark, target)
    new = [r["file"] for r in files.join(known, "file", "left_anti").distinct().orderBy("file").collect()]
    if new:
        load_id, last_key = _next_load(known)
        scanned = scan_files(spark, new)
        headers, found = {f: header for f, header, _ in scanned}, {f: digest for f, _, digest in scanned}
        digests = spark.createDataFrame(sorted(found.items()), "file string, digest string")
        held = {r["digest"] for r in digests.join(known.where("replaces is null").select("digest"), "digest", "left_semi").collect()}
        first: dict[str, str] = {}
        for f in new:
            if found.get(f) not in held:
                first.setdefault(found.get(f, f), f)  # a file without a line is of its own
        fresh = sorted(first.values())
        rows, rejects, staged = f"{target}/rows/load_id={load_id}", f"{target}/rejects/load_id={load_id}", f"{target}/staged/{load_id}"
        accepted, rejected = {}, {}
        if fresh:
            folder, good_of, bad = _stage(spark, read, fresh, headers, staged)
            _append(bad, rejects)
            every = spark.read.parquet(folder)
            if key:
                task_starts(good_of(every)).write.parquet(f"{staged}/starts")
                starts = spark.read.parquet(f"{staged}/starts")
            for part in batches(spark, folder):
                good = good_of(spark.read.schema(every.schema).parquet(*part))
                if key:
                    good = with_keys(good, last_key + 1, starts=starts).withColumnRenamed("key", key)
                good = good.drop("_row")
                _append(transform(good) if transform else good, rows)
                for f in part:
                    drop_path(spark, f)
            of_file = lambda path, *more: spark.read.parquet(path).groupBy("_source").agg(F.count(F.lit(1)).alias("n"), *more).collect()
            counted = of_file(rows, (F.max(key) if key else F.lit(None)).alias("last"))  # a row a file
            accepted, rejected = ({r["_source"]: r["n"] for r in x} for x in (counted, of_file(rejects)))
            last_key = max((r["last"] for r in counted if r["last"] is not None), default=last_key)
        else:
            load_id = None  # only copies: files without a load
        entries = [(f, load_id, accepted.get(f, 0), rejected.get(f, 0), last_key, found.get(f), None) for f in new]
        _publish(spark.createDataFrame(entries, LEDGER), target)
        drop_path(spark, staged)
    total = ledger(spark, target).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).first()
    return total["a"] or 0, total["r"] or 0


def _append(df: DataFrame, path: str, **options) -> None:
    df.write.mode("append").options(compression="zstd", **options).parquet(path)


def _stage(spark: SparkSession, read, paths: list[str], headers: Mapping[str, str], staged: str):
    """(folder under ``staged`` with the rows that ``read`` gives, which of them are good, rejects); good rows are
    numbered by ``_row``.

    A ``read`` with ``parsed`` reads and parses its files once for both."""
    numbered = F.monotonically_increasing_id()
    if whole := getattr(read, "parsed", None):
        good = F.col("_reject").isNull()  # only good rows are counted
        _append(whole(spark, paths, headers).withColumn("_row", F.when(good, numbered)), f"{staged}/all", maxRecordsPerFile=STAGED_ROWS)
        return f"{staged}/all", lambda df: df.where(good).drop("_reject"), spark.read.parquet(f"{staged}/all").where(~good).drop("_row")
    good, bad = read(spark, paths, headers) if getattr(read, "takes_headers", False) else read(spark, paths)
    _append(good.withColumn("_row", numbered), f"{staged}/good", maxRecordsPerFile=STAGED_ROWS)
    return f"{staged}/good", lambda df: df, bad


def _next_load(known: DataFrame) -> tuple[str, int]:
    """(id of the next load, last key given)."""
    r = known.agg(F.coalesce(F.max("last_key"), F.lit(0)).alias("k"), F.coalesce(F.max(position("load_id")) + 1, F.lit(0)).alias("n")).first()
    return f"{r['n']:06d}-{uuid.uuid4().hex[:12]}", r["k"]


def _publish(entries: DataFrame, target: str) -> None:
    entries.coalesce(1).write.mode("append").parquet(f"{target}/ledger")


# ------------------------------------------------------------------ resync

# Dimension -> the columns kept of it, those it is found by, and the rows' columns that find it
# (joined without a separator, as N1 does).
_DIMENSIONS = {
    "farmers": (("f_name", "m_name", "l_name", "f_id"), ("f_name", "m_name", "l_name"), ("raw_fname", "raw_mname", "raw_lname")),
    "municipalities": (("muni_name", "muni_id"), ("muni_name",), ("raw_municipality_name",)),
    "barangays": (("brgy_name", "muni_id", "brgy_id"), ("brgy_name",), ("raw_barangay_name",)),
}


def resync(spark: SparkSession, target: str, tbl_muni: DataFrame, farmer_demo: DataFrame, tbl_barangay: DataFrame) -> list[str]:
    """N1-N3 for rows already loaded: rewrite the loads that a changed dimension row can touch; returns the loads replaced.

    The dimensions as of the last call are kept beside the table; rows of theirs that are new,
    changed or gone since are met with the names in the loaded rows (a semi-join that reads the name
    columns alone), and only loads with such a row are read in full and written anew, from the names
    they came with. One ledger file publishes all of them; the other loads stay as they are. The first
    call meets all names. Ids of a row whose name has gone from a dimension become its name again (no
    farmer: NULL). Rows keep their keys, and rejects stay. A large load is rewritten in :func:`batches` of its files.
    """
    with shuffles_dropped(spark):
        return _resync(spark, target, tbl_muni, farmer_demo, tbl_barangay)


def _resync(spark: SparkSession, target: str, tbl_muni: DataFrame, farmer_demo: DataFrame, tbl_barangay: DataFrame) -> list[str]:
    known = ledger(spark, target)
    position_ = int(_next_load(known)[0].split("-")[0])
    live = loads(spark, target)
    if not live:
        return []
    now = {"municipalities": tbl_muni, "barangays": tbl_barangay, "farmers": farmer_demo}
    kept = f"{target}/dimensions"
    before = _last_folder(spark, kept)
    place = f"{kept}/{position_:06d}-{uuid.uuid4().hex[:12]}"
    replaced: list[str] = []
    for name in now:  # the largest last: a load that an earlier one touches is met with no other
        columns, own, names = _DIMENSIONS[name]
        now[name].select(*columns).distinct().write.parquet(f"{place}/{name}")
        changed = new = spark.read.parquet(f"{place}/{name}")
        if before:
            old = spark.read.schema(new.schema).parquet(f"{before}/{name}")
            changed = new.exceptAll(old).unionByName(old.exceptAll(new))
        found = changed.select(F.concat(*own).alias("_found")).distinct()
        left = [x for x in live if x not in replaced]
        if left and not found.isEmpty():
            rows = _rows_of(spark, target, "rows", left).select("load_id", F.concat(*names).alias("_found"))
            hit = rows.join(found, "_found", "left_semi").select("load_id").distinct().collect()  # loads, not rows
            replaced += [r["load_id"] for r in hit]
    replaced.sort()
    entries = []
    for old_id in replaced:
        new_id = f"{position_:06d}-{uuid.uuid4().hex[:12]}"
        folder = f"{target}/rows/load_id={old_id}"
        own = spark.read.parquet(folder)
        for part in batches(spark, folder):
            rows = spark.read.schema(own.schema).parquet(*part)
            _append(curate_survey(rows, tbl_muni, farmer_demo, tbl_barangay).select(*own.columns), f"{target}/rows/load_id={new_id}")
        entries.append((None, new_id, 0, 0, None, None, old_id))
    if entries:
        _publish(spark.createDataFrame(entries, LEDGER), target)
    spark.createDataFrame([(place.rsplit("/", 1)[1],)], "folder string").coalesce(1).write.mode("append").parquet(f"{kept}/done")
    return replaced


def _last_folder(spark: SparkSession, path: str) -> str | None:
    """The newest complete folder under ``path``: those that ``done`` names."""
    if not path_exists(spark, f"{path}/done"):
        return None
    last = spark.read.schema("folder string").parquet(f"{path}/done").agg(F.max("folder")).first()[0]
    return f"{path}/{last}"


def feed_reader(feed: Feed, date_formats=DEFAULT_DATE_FORMATS, multi_line: bool = True):
    """``read`` of :func:`load_files` for a CSV feed."""
    def parsed(spark: SparkSession, paths: list[str], headers: Mapping[str, str] | None = None) -> DataFrame:
        return parse(read_files(spark, paths, feed, multi_line, headers), feed, date_formats)

    def read(spark: SparkSession, paths: list[str], headers: Mapping[str, str] | None = None):
        return split(parsed(spark, paths, headers))

    read.takes_headers, read.parsed = True, parsed
    return read


#: The column that numbers the rows of a feed's table.
KEYS = {"survey": "logs", "pests": "id"}


def load_feed(spark: SparkSession, source: str, feed: Feed, target: str, transform=None,
              date_formats=DEFAULT_DATE_FORMATS) -> tuple[int, int]:
    """S3-S7 + S9 as one job: load every file under ``source`` that ``target`` doesn't have yet."""
    return load_files(spark, list_files(spark, source), target, feed_reader(feed, date_formats), transform, KEYS.get(feed.name))


def load_weather(spark: SparkSession, source: str, target: str, day_from: str = "ordinal") -> tuple[int, int]:
    """S2 + S9: load every calendar sheet under ``source`` that ``target`` doesn't have yet."""
    from ananas.sources import weather

    return load_files(spark, list_files(spark, source), target, lambda s, paths: weather.ingest_weather(s, paths, day_from))


def write_result(df: DataFrame, path: str) -> None:
    """S10: a report as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """S8: a curated table; column pruning and filter pushdown are Spark's."""
    return spark.read.parquet(path)

"""Ingest, sync and streaming jobs over feeds derived from the curated tables.

The driver's data has no CSV feeds, so each job first lays the matching
domain table out as the feed the upload form expects (written by Spark to
the shared folder of ``spark.checkpoint.dir``), then runs the real ingest on
it. Each result is the curated table the ingest produces, so it can be
compared with the domain table it came from: a full round trip through CSV
text, header mapping, parsing and id sync.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.functions.exprs import trunc_dec, year_of
from ananas.operators import distinct_state
from ananas.operators.sync import sync_barangay_id, sync_farmer_id, sync_municipality_id
from ananas.plans import area, figures, market
from ananas.session import input_bytes, shuffles_dropped, staging_path
from ananas.sources import feeds, weather
from ananas.sources.tables import Tables
from ananas.streaming import ingest as stream

# The survey is laid out as its feed in at most so many passes, of so many bytes of the tables' files or
# more, so that what the tables' joins shuffle lies on disk for one pass at a time.
PASSES = 8
PASS_BYTES = 2 << 30

# Files per micro-batch, so a large drop is processed in bounded batches.
STREAM_FILES_PER_BATCH = 1000

SURVEY_OUT = (
    "raw_municipality", "raw_barangay", "raw_fname", "raw_mname", "raw_lname", "raw_gender", "raw_bdate",
    "raw_area", "raw_population", "raw_dgathered", "raw_dharvest", "RBSBA", "tenurial",
)


def _write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def _text(c: str):
    return F.col(c).cast("string")


# ------------------------------------------------------------------ feeds from tables

def survey_feed(t: Tables, *more) -> DataFrame:
    """``qp_farmer_raw`` as the survey upload: place names, not ids; and ``more`` of its columns."""
    q = t.qp_farmer_raw
    m = t.muni.select(F.col("muni_id").alias("_mid"), F.col("muni_name").alias("_mname"))
    j = q.join(m, F.col("raw_municipality") == F.col("_mid"), "left")
    return j.select(
        F.coalesce("_mname", "raw_municipality").alias("Municipalities"),
        F.col("raw_barangay").alias("Barangay"),
        F.col("raw_fname").alias("First Name"), F.col("raw_mname").alias("Middle Initial"),
        F.col("raw_lname").alias("Last Name"), F.col("raw_gender").alias("Gender"),
        _text("raw_bdate").alias("Birthdate"), _text("raw_area").alias("Area (Ha)"),
        _text("raw_population").alias("Population"), _text("raw_dgathered").alias("Date Data Gathered"),
        F.lit("").alias("Stage of Crops"), _text("raw_dharvest").alias("Date of Harvest"), F.lit("").alias("Status"),
        F.col("RBSBA"), F.lit("").alias("Contact Number"), F.col("tenurial").alias("Tenurial"), *more,
    )


def _write_survey(t: Tables, path: str, *more, by: str | None = None) -> str:
    """The survey feed as compressed CSV files under ``path``, in folders by the column ``by`` of ``more`` where it is given."""
    passes = max(1, min(PASSES, -(-input_bytes(t.qp_farmer_raw) // PASS_BYTES)))
    near = F.xxhash64(F.shiftright("logs", 10))  # neighbours by key, often alike, stay together: such text packs better
    with shuffles_dropped(t.spark):
        for k in range(passes):
            own = t.qp_farmer_raw.where(F.pmod(near, F.lit(passes)) == k) if passes > 1 else t.qp_farmer_raw
            out = survey_feed(dataclasses.replace(t, qp_farmer_raw=own), *more).write.mode("append")
            out = out.option("header", True).option("compression", "gzip")
            (out.partitionBy(by) if by else out).csv(path)
    return path


def price_feed(t: Tables) -> DataFrame:
    p = t.qp_price
    return p.select(_text("date").alias("DATE"), _text("med_price").alias("Medium"), _text("lg_price").alias("Large"),
                    F.coalesce("buyer_seller", F.lit("")).alias("BUYER/SELLER"))


def harvest_feed(t: Tables) -> DataFrame:
    h = t.harvest_data
    return h.select("Municipality", "Barangay", _text("Production").alias("Production"), _text("year_gathered").alias("Date"))


def pest_feed(t: Tables) -> DataFrame:
    p = t.pests
    return p.select(F.col("category").alias("Category"), F.col("name").alias("Name"),
                    F.col("description").alias("Description"), F.lit("").alias("Damage"),
                    F.lit("").alias("Management"), _text("rank").alias("Report Count"))


def soil_feed(t: Tables) -> DataFrame:
    """Soil samples, one per registered farmer (the reference keeps this
    table but never reports on it)."""
    f = t.farmer_demo.select("f_id", "f_name", "l_name", "f_municipality", "f_birthdate")
    j = f.join(t.muni, F.col("f_municipality") == F.col("muni_id"), "inner")
    k = F.col("f_id").cast("long")
    return j.select(
        F.col("f_name").alias("First Name"), F.col("l_name").alias("Last Name"), F.col("muni_name").alias("Municipality"),
        (k % 50).cast("string").alias("Area(ha)"),
        F.date_format("f_birthdate", "d-M-yyyy").alias("Date Sampled(D-M-Y)"),
        (k % 14).cast("string").alias("pH"), (k % 100).cast("string").alias("N"),
        (k % 60).cast("string").alias("P"), (k % 40).cast("string").alias("K"),
    )


# ------------------------------------------------------------------ jobs

def ingest_farmer_survey(t: Tables) -> DataFrame:
    """S3 + N2: survey CSV -> curated rows with municipality ids."""
    path = _write_csv(survey_feed(t), staging_path(t.spark, "survey"))
    good, _ = feeds.ingest(t.spark, path, feeds.SURVEY)
    return feeds.curate_survey(good, t.tbl_muni).select(*SURVEY_OUT)


def ingest_price(t: Tables) -> DataFrame:
    """S5."""
    path = _write_csv(price_feed(t), staging_path(t.spark, "price"))
    good, _ = feeds.ingest(t.spark, path, feeds.PRICE)
    return good.drop("_source")


def ingest_harvest(t: Tables) -> DataFrame:
    """S6."""
    path = _write_csv(harvest_feed(t), staging_path(t.spark, "harvest"))
    good, _ = feeds.ingest(t.spark, path, feeds.HARVEST)
    return good.drop("_source")


def ingest_pest_catalogue(t: Tables) -> DataFrame:
    """S7."""
    path = _write_csv(pest_feed(t), staging_path(t.spark, "pests"))
    good, _ = feeds.ingest(t.spark, path, feeds.PESTS)
    return good.drop("_source")


def ingest_soil_test(t: Tables) -> DataFrame:
    """S4: the sample date is day-month-year."""
    path = _write_csv(soil_feed(t), staging_path(t.spark, "soil"))
    good, _ = feeds.ingest(t.spark, path, feeds.SOIL)
    return good.drop("_source")


def daily_rain(t: Tables) -> DataFrame:
    w = t.weather_data
    return w.groupBy("date").agg(F.sum("rain_amount").cast("decimal(10,2)").alias("rain_amount"))


def ingest_weather(t: Tables) -> DataFrame:
    """S2: daily rainfall laid out as yearly calendar sheets, read back."""
    path = staging_path(t.spark, "weather")
    weather.write_sheets(daily_rain(t), path)
    good, _ = weather.ingest_weather(t.spark, path)
    return good.select("date", "rain_amount")


def stream_ingest_price(t: Tables) -> DataFrame:
    """ST1: the price feed dropped into a folder watched by a stream (one file
    per partition of the table, micro-batches of many files); the accepted
    table after the stream has caught up."""
    src = _write_csv(price_feed(t), staging_path(t.spark, "price-drop"))
    base = staging_path(t.spark, "price-stream")
    paths = stream.StreamPaths(source=src, output=f"{base}/out", checkpoint=f"{base}/checkpoint")
    stream.run_once(t.spark, feeds.PRICE, paths, max_files_per_trigger=STREAM_FILES_PER_BATCH)
    return stream.read_accepted(t.spark, paths).drop("_source", "load_id")


def stream_ingest_survey(t: Tables) -> DataFrame:
    """ST1 + N2: the survey feed through the drop-folder stream; each
    micro-batch replaces municipality names by ids (a stream-static join
    with the municipality list)."""
    src = _write_csv(survey_feed(t), staging_path(t.spark, "survey-drop"))
    base = staging_path(t.spark, "survey-stream")
    paths = stream.StreamPaths(source=src, output=f"{base}/out", checkpoint=f"{base}/checkpoint")
    muni = t.tbl_muni
    stream.run_once(t.spark, feeds.SURVEY, paths, transform=lambda good: feeds.curate_survey(good, muni),
                    max_files_per_trigger=STREAM_FILES_PER_BATCH)
    return stream.read_accepted(t.spark, paths).select(*SURVEY_OUT)


def csv_source(t: Tables) -> DataFrame:
    """S1: the price feed read back as text, every field a string."""
    path = _write_csv(price_feed(t), staging_path(t.spark, "csv-source"))
    return feeds.read_text(t.spark, path, feeds.PRICE).drop("_source", feeds.CORRUPT, feeds.MISSING)


def table_scan(t: Tables) -> DataFrame:
    """S8: a curated table written as parquet and scanned back."""
    path = staging_path(t.spark, "table-scan")
    t.qp_price.write.mode("overwrite").parquet(path)
    return feeds.read_table(t.spark, path)


def append_sink(t: Tables) -> DataFrame:
    """S9: the price feed loaded twice into an empty table with ``load_feed``;
    the second load adds nothing, so the table equals the feed."""
    src = _write_csv(price_feed(t), staging_path(t.spark, "append-src"))
    target = staging_path(t.spark, "append-out")
    for _ in range(2):
        feeds.load_feed(t.spark, src, feeds.PRICE, target)
    return feeds.read_loaded(t.spark, target).select("date", "med_price", "lg_price", "buyer_seller")


def result_sink(t: Tables) -> DataFrame:
    """S10: a report (AR5) written as JSON lines and read back with its schema."""
    report = area.area_ranking(t)
    path = staging_path(t.spark, "result-sink")
    feeds.write_result(report, path)
    return t.spark.read.schema(report.schema).json(path)


def sync_farmer_id_job(t: Tables) -> DataFrame:
    """N1 on survey rows uploaded unsynced (``f_id = '1'``)."""
    q = t.qp_farmer_raw.withColumn("f_id", F.lit("1"))
    return sync_farmer_id(q, t.farmer_demo).select("logs", "raw_fname", "raw_mname", "raw_lname", "f_id")


def sync_municipality_id_job(t: Tables) -> DataFrame:
    """N2 on survey rows whose municipality arrived as a name."""
    m = t.muni.select(F.col("muni_id").alias("_mid"), F.col("muni_name").alias("_mname"))
    q = t.qp_farmer_raw.join(m, F.col("raw_municipality") == F.col("_mid"), "left").select(
        "logs", F.coalesce("_mname", "raw_municipality").alias("raw_municipality"), "raw_barangay",
        F.lit(False).alias("is_synced"),
    )
    return sync_municipality_id(q, t.tbl_muni).select("logs", "raw_municipality", "raw_barangay")


def sync_barangay_id_job(t: Tables) -> DataFrame:
    """N3 on survey rows whose barangay arrived as a name: matched on (name,
    municipality), so a village named in another municipality keeps its name."""
    b = t.barangay.select(F.col("brgy_id").alias("_bid"), F.col("brgy_name").alias("_bname"))
    q = t.qp_farmer_raw.join(b, F.col("raw_barangay") == F.col("_bid"), "left").select(
        "logs", "raw_municipality", F.coalesce("_bname", "raw_barangay").alias("raw_barangay")
    )
    return sync_barangay_id(q, t.tbl_barangay)


def load_to_area_ranking(t: Tables) -> DataFrame:
    """S3 + N2, N1, N3 + S9, then AR5: survey CSV files loaded into a table that the report reads."""
    src = _write_survey(t, staging_path(t.spark, "survey-load"))
    target = staging_path(t.spark, "survey-table")
    _load_survey(t, src, target)
    feeds.drop_path(t.spark, src)  # the report reads the table
    return area.area_ranking(t.with_loaded(survey=target))


def load_to_common_pest(t: Tables) -> DataFrame:
    """S7 + S9, then PE2 over the loaded catalogue."""
    src = _write_csv(pest_feed(t), staging_path(t.spark, "pest-load"))
    target = staging_path(t.spark, "pest-table")
    feeds.load_feed(t.spark, src, feeds.PESTS, target)
    return market.common_pest(t.with_loaded(pests=target))


def load_to_rain_by_year(t: Tables) -> DataFrame:
    """S2 + S9, then WE1 over the loaded sheets."""
    src, target = staging_path(t.spark, "weather-load"), staging_path(t.spark, "weather-table")
    weather.write_sheets(daily_rain(t), src)
    feeds.load_weather(t.spark, src, target)
    return market.rain_by_year(t.with_loaded(weather=target))


def _logs(t: Tables, parts: int, part: int) -> Tables:
    """``t`` with one of ``parts`` shares of the survey, by the row's key."""
    return dataclasses.replace(t, qp_farmer_raw=t.qp_farmer_raw.where(F.pmod("logs", F.lit(parts)) == part))


def _survey_drops(t: Tables, parts: int, drop: str):
    """Drop one of ``parts`` shares of the survey feed after the other into folders of ``drop``; the
    tables are joined for all shares at once."""
    laid = staging_path(t.spark, "shares")
    _write_survey(t, laid, F.pmod("logs", F.lit(parts)).alias("_share"), by="_share")
    for k in range(parts):
        if feeds.path_exists(t.spark, f"{laid}/_share={k}"):
            feeds.move_path(t.spark, f"{laid}/_share={k}", f"{drop}/{k}")
        else:  # a share without a row is a header alone
            _write_csv(survey_feed(_logs(t, parts, k)), f"{drop}/{k}")
        yield k
    feeds.drop_path(t.spark, laid)


def stream_area_by_year(t: Tables) -> DataFrame:
    """ST1: AR2 kept by a stream over survey files: two drops, a restart after each, and a late file."""
    drop, base = staging_path(t.spark, "area-drop"), staging_path(t.spark, "area-stream")
    paths = stream.StreamPaths(source=drop, output=f"{base}/out", checkpoint=f"{base}/checkpoint")
    for _ in _survey_drops(t, 3, drop):
        stream.run_totals_once(t.spark, feeds.SURVEY, paths, year_of("raw_dgathered"), "raw_area", STREAM_FILES_PER_BATCH)
    sums = stream.read_totals(t.spark, paths)
    return sums.select(trunc_dec("total", 2).alias("Area_count"), F.col("key").alias("year_"))


def farmer_counts_from_state(t: Tables) -> DataFrame:
    """FA6 and RG4 (long rows, as in DB2) from bitmaps of farmers that two loads have left behind."""
    path = staging_path(t.spark, "farmer-state")
    for k in range(2):
        distinct_state.add_load(_logs(t, 2, k).qp_farmer_raw, path)
    series = figures.long_rows(distinct_state.farmer_count_series(t.spark, path), "farmer_count", ["count_farmer"], period="year_")
    table = distinct_state.rbsba_table(t.spark, path, t.muni)
    return series.unionByName(figures.long_rows(table, "rbsba_table", table.columns[:5], place="muni_name"))


def farmer_counts_sketched(t: Tables) -> DataFrame:
    """FA6 estimated from stored sketches of two loads (relative standard error of ``SKETCH_ERROR``)."""
    path = staging_path(t.spark, "farmer-sketches")
    for k in range(2):
        distinct_state.add_load(_logs(t, 2, k).qp_farmer_raw, path)
    return distinct_state.farmer_count_series_sketched(t.spark, path)


def _load_survey(t: Tables, src: str, target: str) -> None:
    feeds.load_feed(t.spark, src, feeds.SURVEY, target,
                    lambda good: feeds.curate_survey(good, t.tbl_muni, t.farmer_demo, t.tbl_barangay))


def load_renamed_once(t: Tables) -> DataFrame:
    """S9: a folder loaded, renamed and loaded again: the files are known by their content, so nothing is added."""
    src, again = _write_csv(price_feed(t), staging_path(t.spark, "named")), staging_path(t.spark, "renamed")
    target = staging_path(t.spark, "named-table")
    feeds.load_feed(t.spark, src, feeds.PRICE, target)
    feeds.move_path(t.spark, src, again)
    feeds.load_feed(t.spark, again, feeds.PRICE, target)
    return feeds.read_loaded(t.spark, target).select("date", "med_price", "lg_price", "buyer_seller")


def area_ranking_as_of_load(t: Tables) -> DataFrame:
    """S8: AR5 over a table of two loads, as it was after the first."""
    drop, target = staging_path(t.spark, "as-of"), staging_path(t.spark, "as-of-table")
    for _ in _survey_drops(t, 2, drop):
        _load_survey(t, drop, target)
    return area.area_ranking(t.with_loaded(survey=target, upto=1))


def resync_survey(t: Tables) -> DataFrame:
    """N1-N3 as a job: survey rows loaded while half of the farmers and municipalities were unknown, then
    synced with all of them, and once more with nothing new."""
    drop, target = staging_path(t.spark, "resync"), staging_path(t.spark, "resync-table")
    half = lambda df, c: df.where(F.pmod(F.col(c).cast("long"), F.lit(2)) == 0)
    early = dataclasses.replace(t, farmer_demo=half(t.farmer_demo, "f_id"), tbl_muni=half(t.tbl_muni, "muni_id"))
    for _ in _survey_drops(t, 2, drop):
        _load_survey(early, drop, target)
    feeds.drop_path(t.spark, drop)  # from here on the table alone is read
    for _ in range(2):
        feeds.resync(t.spark, target, t.tbl_muni, t.farmer_demo, t.tbl_barangay)
    return feeds.read_loaded(t.spark, target).select("f_id", *SURVEY_OUT)


JOBS = {
    "stream_area_by_year": stream_area_by_year,
    "farmer_counts_from_state": farmer_counts_from_state,
    "farmer_counts_sketched": farmer_counts_sketched,
    "load_renamed_once": load_renamed_once,
    "area_ranking_as_of_load": area_ranking_as_of_load,
    "resync_survey": resync_survey,
    "load_to_area_ranking": load_to_area_ranking,
    "load_to_common_pest": load_to_common_pest,
    "load_to_rain_by_year": load_to_rain_by_year,
    "csv_source": csv_source,
    "table_scan": table_scan,
    "append_sink": append_sink,
    "result_sink": result_sink,
    "stream_ingest": stream_ingest_price,
    "stream_ingest_survey": stream_ingest_survey,
    "ingest_farmer_survey": ingest_farmer_survey,
    "ingest_price": ingest_price,
    "ingest_harvest": ingest_harvest,
    "ingest_pest_catalogue": ingest_pest_catalogue,
    "ingest_soil_test": ingest_soil_test,
    "ingest_weather": ingest_weather,
    "stream_ingest_price": stream_ingest_price,
    "sync_farmer_id": sync_farmer_id_job,
    "sync_municipality_id": sync_municipality_id_job,
    "sync_barangay_id": sync_barangay_id_job,
}

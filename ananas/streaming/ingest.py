"""ST1: drop-folder ingest with Structured Streaming.

Each feed has a folder. The stream finds new files (their contents are not
read by it), and each micro-batch hands its files to the same loader as the
batch jobs: one parse, one table, one ledger. A batch replayed after a
failure finds its files in the ledger and adds nothing, so every file is
loaded exactly once, by whichever of stream and batch job comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ananas.sources import feeds


@dataclass(frozen=True)
class StreamPaths:
    source: str
    output: str
    checkpoint: str


# Fixed value: the schema of Spark's binaryFile source.
FILES = "path string, modificationTime timestamp, length long, content binary"


def start_feed_stream(
    spark: SparkSession,
    feed: feeds.Feed,
    paths: StreamPaths,
    transform=None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    interval: str = "30 seconds",
) -> StreamingQuery:
    """Start the stream for one feed. ``transform`` runs on accepted rows
    (e.g. N2 for the survey feed, a stream-static join with the municipality
    list). With ``available_now`` the stream processes what is in the folder
    and stops; otherwise it looks for new files every ``interval``."""
    return start_stream(spark, paths, feeds.feed_reader(feed), transform, feeds.KEYS.get(feed.name),
                        available_now, max_files_per_trigger, interval)


def start_stream(spark: SparkSession, paths: StreamPaths, read, transform=None, key: str | None = None,
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 interval: str = "30 seconds") -> StreamingQuery:
    """The stream for any ``read`` of :func:`ananas.sources.feeds.load_files`."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = reader.load(paths.source).select(F.col("_metadata.file_path").alias("file"))

    def write(batch: DataFrame, batch_id: int) -> None:
        feeds.load_files(batch.sparkSession, batch, paths.output, read, transform, key)

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", paths.checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def _finish(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def run_once(spark: SparkSession, feed: feeds.Feed, paths: StreamPaths, transform=None,
             max_files_per_trigger: int | None = None) -> None:
    """Process every file now in the folder, then return."""
    _finish(start_feed_stream(spark, feed, paths, transform, available_now=True, max_files_per_trigger=max_files_per_trigger))


# ------------------------------------------------------------------ a report kept by a stream

def start_totals_stream(
    spark: SparkSession, feed: feeds.Feed, paths: StreamPaths, key, value: str, available_now: bool = True,
    max_files_per_trigger: int | None = None, interval: str = "30 seconds",
) -> StreamingQuery:
    """Sums of ``value`` by ``key`` (a Column over the parsed rows) over all files dropped so far, kept by a
    stateful aggregate; see :func:`read_totals`.

    Files have the feed's columns in its own order (another header is an error). The state is a row for
    each key, however many rows come, so none is ever evicted and there is no watermark that would
    drop late rows: a file that comes late changes the sum of its old year. After a restart the
    aggregate goes on from the checkpoint. Each batch writes all sums to a folder of its own number, so
    a batch that is run again writes the same folder.
    """
    schema = T.StructType([T.StructField(h, T.StringType(), True) for h in feed.headers])
    options = {"header": "true", "enforceSchema": "false", "escape": '"', "recursiveFileLookup": "true"}
    reader = spark.readStream.schema(schema).options(**options)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    text = reader.csv(paths.source).withColumn("_source", F.col("_metadata.file_path"))
    good, _ = feeds.split(feeds.parse(text, feed))
    sums = good.groupBy(key.alias("key")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.repartition(1).write.mode("overwrite").parquet(f"{paths.output}/batch={batch_id}")
        feeds.drop_path(batch.sparkSession, f"{paths.output}/batch={batch_id - 2}")  # readers may still be on the last

    writer = sums.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", paths.checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def run_totals_once(spark: SparkSession, feed: feeds.Feed, paths: StreamPaths, key, value: str,
                    max_files_per_trigger: int | None = None) -> None:
    """Add every file now in the folder to the sums, then return."""
    _finish(start_totals_stream(spark, feed, paths, key, value, True, max_files_per_trigger))


def read_totals(spark: SparkSession, paths: StreamPaths) -> DataFrame:
    """(key, total, n) as the last finished batch left them."""
    last = spark.read.parquet(paths.output).agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{paths.output}/batch={last}")


def read_accepted(spark: SparkSession, paths: StreamPaths) -> DataFrame:
    return feeds.read_loaded(spark, paths.output)

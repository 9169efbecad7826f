"""Helpers of the training-data operators: shared tables, size checks, words, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest table, in bytes as measured by ``measured_bytes``, that is broadcast.
BROADCAST_BYTES = 32 << 20

#: Bytes of text that a worker turns into Python objects at a time.
SLICE_BYTES = 2_000_000

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the session has it.

    Unset on a local master (tests), a temporary folder takes its place; unset on a cluster,
    this raises, as a machine's own folder would lose rows there.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _ROOTS[app] = tempfile.mkdtemp(prefix="ananas-llm-")
        spark.sparkContext.setCheckpointDir(_ROOTS[app])
    return _ROOTS[app]


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder (in folders of a column ``by``) and read it back: lineage ends there.

    Ids made by ``monotonically_increasing_id`` are fixed from here on. The folder stays until
    ``forget`` drops it, or else the owner of ``spark.checkpoint.dir``, as a lazy result may still read it.
    """
    path = f"{shared_root(df.sparkSession)}/ananas-llm/{uuid.uuid4().hex}/{name}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Drop the files of tables that ``written`` made and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "written_path", None):
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches, text: int, most: int = SLICE_BYTES):
    """``batches`` cut into runs of rows of about ``most`` bytes in column ``text``, so that a worker
    holds no more than one run as Python objects, however many rows a batch has."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes, dtype=np.int64) // most
        cuts = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(run)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many ``_`` before it as set it apart from every column of ``df``, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def measured_bytes(df: DataFrame) -> int:
    """Size of ``df`` in memory, from its own values: texts by their bytes, the rest by 16 a cell."""
    width: Column = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            width = width + F.coalesce(F.octet_length(F.col(f.name).cast("string")) + 24 * F.size(f.name), F.lit(0))
    return df.agg(F.sum(width).alias("n")).first()["n"] or 0


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it measures at most ``limit`` bytes; else as it is, to be shuffled.

    ``df`` should be a written table, as it is read once more for the measure.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else; plain ``lower`` does it for texts of ASCII alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def split_words(col: Column, gaps: str) -> Column:
    """Non-empty pieces of ``col`` between matches of ``gaps``; null has none."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), gaps), "")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (id, component), component the smallest id.

    Alternating large-star and small-star steps: each edge list is cut by ``checkpoint()`` and
    holds at most as many rows as the first. A star's centre is never gathered in one task: its
    minimum is pre-aggregated, and the join that hands it out is one that Spark splits by size.
    Only nodes that have an edge are returned.
    """
    spark = edges.sparkSession
    shared_root(spark)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()

    def signature(x: DataFrame):
        r = x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    before = signature(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u hang on the least of u's neighbourhood
        e = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours of u, and u itself, hang on the least of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        tied = e.join(low, "u")
        e = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = e.filter("u <> v").distinct().checkpoint()
        after = signature(e)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

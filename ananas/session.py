"""Session and shared-storage helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ananas") -> SparkSession:
    """A local session for tests, benches and the command line.

    On a cluster the session comes from the launcher; nothing in the library
    depends on these settings beyond a UTC clock for date casts.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


#: Scratch folders of local applications whose session names none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts and staged files.

    Read from ``spark.checkpoint.dir``; only when the session has none and
    runs in local mode (as in tests) is a fresh scratch folder created and
    kept for the application. On a cluster a machine-local folder would not
    be shared, so an unset directory is an error there.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        conf = _LOCAL.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="ananas-ckpt-")
        _LOCAL[sc.applicationId] = conf
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf)
    return conf.rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries begun within give their shuffle files back when they end; else these stay until the
    driver happens to collect garbage, and the shuffles of a job's steps add up on disk."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is read from, as its plan has them; no job runs. What isn't files counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 62)  # an unknown size is Spark's default, the largest long


def staging_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared folder."""
    return f"{shared_dir(spark)}/ananas-staging/{name}-{uuid.uuid4().hex[:12]}"

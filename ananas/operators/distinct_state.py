"""Distinct farmers kept as state that merges: exact bitmaps, or sketches of a fixed size.

A distinct count cannot be added up over loads, years or places, so the reports count from the
survey rows. Here a load leaves behind, for each (year, municipality, flag), the set of its
farmers: as bits of dense farmer numbers (exact), or as a HyperLogLog sketch. Any total is the
union of such sets, and asking for one reads the state alone: no (group, farmer) pair is shuffled.

State is a folder: ``ids`` (farmer -> number), ``sets`` and ``loads``, which names the loads that
are complete; a load that dies before its row there is written is not seen. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ananas.functions.exprs import is_blank, mysql_ratio_pct, person_key, year_of
from ananas.sources.feeds import drop_path, path_exists, with_keys

#: Sketches have 2^LG_K cells: relative standard error of a union about 0.8 / sqrt(2^LG_K), 0.6 %.
LG_K = 14
SKETCH_ERROR = 0.8 / 2 ** (LG_K / 2)

IDS = "kind string, person string, pid long"
SETS = "kind string, y long, muni string, flag string, bucket long, bits binary, sketch binary"
LOADS = "load_id string, last_pid long"


def farmer_rows(survey: DataFrame) -> DataFrame:
    """(kind, person, y, muni, reg, unreg): each farmer of each year and place once, by both name
    keys; 1 where any row is registered, or isn't. ``strict`` is NULL for names with a NULL part:
    nobody, but the year and place are there."""
    name = ("raw_fname", "raw_mname", "raw_lname")
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), person_key(*name, k).alias("person")) for k in ("strict", "ws")])
    q = survey.select(
        F.explode(keys).alias("k"), year_of("raw_dgathered").alias("y"), F.col("raw_municipality").alias("muni"),
        (~is_blank("RBSBA")).cast("int").alias("reg"), is_blank("RBSBA").cast("int").alias("unreg"),
    )
    return q.groupBy("k.kind", "k.person", "y", "muni").agg(F.max("reg").alias("reg"), F.max("unreg").alias("unreg"))


def _read(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    if not path_exists(spark, f"{path}/loads"):
        return spark.createDataFrame([], schema)
    loads = [r["load_id"] for r in spark.read.schema(LOADS).parquet(f"{path}/loads").select("load_id").orderBy("load_id").collect()]
    return spark.read.schema(schema).parquet(*[f"{path}/{part}/{x}" for x in loads])


def add_load(survey: DataFrame, path: str) -> None:
    """Add the farmers of ``survey`` rows to the state at ``path``; rows that are there already change nothing.

    New farmers are numbered on from the last, in order of place, so the bits of a place lie in few
    buckets. The one shuffle of farmers is here, of each (year, place, farmer) once.
    """
    spark = survey.sparkSession
    load_id = uuid.uuid4().hex
    staged = f"{path}/staged/{load_id}"
    farmer_rows(survey).write.parquet(f"{staged}/rows")
    rows = spark.read.parquet(f"{staged}/rows")
    last = 0
    if path_exists(spark, f"{path}/loads"):
        last = spark.read.schema(LOADS).parquet(f"{path}/loads").agg(F.max("last_pid")).first()[0] or 0
    people = rows.where("person is not null").groupBy("kind", "person").agg(F.min("muni").alias("place"))
    new = people.join(_read(spark, path, "ids", IDS), ["kind", "person"], "left_anti")
    new = new.repartitionByRange("kind", "place", "person").sortWithinPartitions("kind", "place", "person")
    new.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{staged}/new")
    numbered = with_keys(spark.read.parquet(f"{staged}/new"), last + 1)
    numbered.select("kind", "person", F.col("key").alias("pid")).write.parquet(f"{path}/ids/{load_id}")
    added = spark.read.schema(IDS).parquet(f"{path}/ids/{load_id}")
    ids = _read(spark, path, "ids", IDS).unionByName(added)
    flags = F.array(F.lit("any"), F.when(F.col("reg") == 1, F.lit("reg")), F.when(F.col("unreg") == 1, F.lit("unreg")))
    marked = rows.join(ids, ["kind", "person"], "left").select("kind", "y", "muni", "pid", "person", F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("flag"))
    sets = marked.groupBy("kind", "y", "muni", "flag", F.bitmap_bucket_number("pid").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("pid")).alias("bits"), F.hll_sketch_agg("person", LG_K).alias("sketch")
    )
    sets.write.parquet(f"{path}/sets/{load_id}")
    top = added.agg(F.coalesce(F.max("pid"), F.lit(last)).alias("k")).first()["k"]
    spark.createDataFrame([(load_id, top)], LOADS).coalesce(1).write.mode("append").parquet(f"{path}/loads")
    drop_path(spark, staged)


def _sets(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return _read(spark, path, "sets", SETS).where(F.col("kind") == kind)


def exact_counts(spark: SparkSession, path: str, kind: str, by: Sequence[str | Column], out: str = "farmers") -> DataFrame:
    """Farmers of each group ``by`` (of y, muni, flag): bits of a bucket are united, then counted."""
    by = [F.col(c) if isinstance(c, str) else c for c in by]
    united = _sets(spark, path, kind).groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    names = [c for c in united.columns if c not in ("bucket", "bits")]
    return united.groupBy(*names).agg(F.sum(F.bitmap_count("bits")).cast("long").alias(out))


def sketched_counts(spark: SparkSession, path: str, kind: str, by: Sequence[str | Column], out: str = "farmers") -> DataFrame:
    """As :func:`exact_counts`, from the sketches: a few KB a group whatever the number of farmers,
    with a relative standard error of ``SKETCH_ERROR``."""
    by = [F.col(c) if isinstance(c, str) else c for c in by]
    s = _sets(spark, path, kind)
    return s.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(out))


def _series(count, spark: SparkSession, path: str) -> DataFrame:
    one = lambda by: count(spark, path, "strict", by, "count_farmer")
    total = one(["flag"]).where("flag = 'any'").agg(F.coalesce(F.max("count_farmer"), F.lit(0)).alias("count_farmer"))
    years = one(["flag", "y"]).where("flag = 'any'")
    return total.select("count_farmer", F.lit("all").alias("year_")).unionByName(years.select("count_farmer", F.col("y").cast("string").alias("year_")))


def farmer_count_series(spark: SparkSession, path: str) -> DataFrame:
    """FA6 from the state."""
    return _series(exact_counts, spark, path)


def farmer_count_series_sketched(spark: SparkSession, path: str) -> DataFrame:
    """FA6 from the sketches."""
    return _series(sketched_counts, spark, path)


def rbsba_table(spark: SparkSession, path: str, muni: DataFrame) -> DataFrame:
    """RG4 from the state."""
    c = exact_counts(spark, path, "ws", ["muni", "flag"]).groupBy("muni").agg(*[
        F.coalesce(F.max(F.when(F.col("flag") == f, F.col("farmers"))), F.lit(0)).alias(name)
        for f, name in (("reg", "rbsba_registered"), ("unreg", "rbsba_unregistered"), ("any", "total_num"))
    ])
    c = c.where("rbsba_registered > 0 and rbsba_unregistered > 0").join(muni, F.col("muni") == F.col("muni_id"), "inner")
    share = lambda n, out: mysql_ratio_pct(n, "total_num", 2).alias(out)
    return c.select("rbsba_registered", "rbsba_unregistered", "total_num", share("rbsba_registered", "registred_percentage"),
                    share("rbsba_unregistered", "unregistred_percentage"), "muni_name").orderBy("muni_name")

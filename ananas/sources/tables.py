"""The curated tables every report reads, and where they come from."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CURATED = (
    "qp_farmer_raw", "farmer_demo", "tbl_muni", "tbl_barangay",
    "harvest_data", "qp_price", "weather_data", "pests",
)


@dataclass
class Tables:
    """The domain tables as DataFrames.

    Joins carry no hints: Spark broadcasts a dimension below
    ``spark.sql.autoBroadcastJoinThreshold`` bytes and shuffles a larger one,
    and no job runs while a plan is built. Dimension ids are unique
    (``tbl_muni.muni_id``, ``tbl_barangay.brgy_id``); the sync jobs
    (:mod:`ananas.operators.sync`) make their match keys unique themselves.
    """

    qp_farmer_raw: DataFrame
    farmer_demo: DataFrame
    tbl_muni: DataFrame
    tbl_barangay: DataFrame
    harvest_data: DataFrame
    qp_price: DataFrame
    weather_data: DataFrame
    pests: DataFrame
    soil_test_kit: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.qp_farmer_raw.sparkSession

    @property
    def muni(self) -> DataFrame:
        return self.tbl_muni

    @property
    def barangay(self) -> DataFrame:
        return self.tbl_barangay

    # ------------------------------------------------------------ loaders

    @classmethod
    def from_synthetic(cls, spark: SparkSession, sf_dir: str, **kw) -> "Tables":
        """Domain views over the driver's synthetic star schema (see FIXTURES.md)."""
        from ananas.sources import adapters

        raw = functools.partial(_read, spark, sf_dir)
        return cls(**adapters.domain_tables(raw), **kw)

    @classmethod
    def from_curated(cls, spark: SparkSession, path: str, validate: bool = True, **kw) -> "Tables":
        """Curated parquet tables written by :meth:`write` (or by any job that
        follows :mod:`ananas.sources.schemas`); checked with :meth:`validate`."""
        dfs = {name: spark.read.parquet(f"{path}/{name}") for name in CURATED}
        t = cls(**dfs, **kw)
        return t.validate() if validate else t

    def with_loaded(self, survey: str | None = None, harvest: str | None = None, price: str | None = None,
                    weather: str | None = None, pests: str | None = None, upto: int | None = None) -> "Tables":
        """These tables with those of the named folders of :func:`ananas.sources.feeds.load_feed`
        (and ``load_weather``) in place of their own, checked with :meth:`validate`; with ``upto``, as
        they were after so many loads."""
        import dataclasses

        from ananas.sources import feeds

        loaded = {"qp_farmer_raw": survey, "harvest_data": harvest, "qp_price": price, "weather_data": weather}
        new = {name: feeds.read_loaded(self.spark, path, upto) for name, path in loaded.items() if path}
        if pests:
            new["pests"] = feeds.pest_catalogue(feeds.read_loaded(self.spark, pests, upto))
        return dataclasses.replace(self, **new).validate()

    def validate(self) -> "Tables":
        """Check every table has the columns of its curated schema with a
        compatible type (same type family; decimals of any precision, text of
        any collation). Extra columns are allowed. Only schemas are read."""
        from ananas.sources import schemas

        expected = {
            "qp_farmer_raw": schemas.QP_FARMER_RAW, "farmer_demo": schemas.FARMER_DEMO,
            "tbl_muni": schemas.TBL_MUNI, "tbl_barangay": schemas.TBL_BARANGAY,
            "harvest_data": schemas.HARVEST_DATA, "qp_price": schemas.QP_PRICE,
            "weather_data": schemas.WEATHER_DATA, "pests": schemas.PESTS,
        }

        def family(t) -> str:
            name = t.typeName()
            if name in ("byte", "short", "integer", "long"):
                return "integral"
            return name

        problems = []
        for name, schema in expected.items():
            have = {f.name: f.dataType for f in getattr(self, name).schema.fields}
            for f in schema.fields:
                if f.name not in have:
                    problems.append(f"{name}.{f.name} is missing")
                elif family(have[f.name]) != family(f.dataType):
                    problems.append(f"{name}.{f.name} is {have[f.name].simpleString()}, expected {f.dataType.simpleString()}")
        if problems:
            raise ValueError("curated tables do not match their schemas: " + "; ".join(problems))
        return self

    def write(self, path: str, files: int | None = None, max_records_per_file: int = 20_000_000,
              parallel: int = 4) -> "Tables":
        """Write every table as parquet; return Tables reading them back.

        Facts are range-partitioned by their date into ``files`` files
        (default ``spark.sql.shuffle.partitions``, which a cluster sizes to
        its data) and sorted within each, so a date-range filter skips whole
        files and row groups by their min/max statistics, and every scan has
        as many splits as files. The range key is (date, hash of the row): a
        date holding a third of all rows is cut across many files instead of
        landing in one task. ``max_records_per_file`` caps file size.
        Dimensions are written as they are. The tables are independent, so
        up to ``parallel`` writes run as concurrent Spark jobs.
        """
        from concurrent.futures import ThreadPoolExecutor

        spark = self.spark
        n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        sort_keys = {
            "qp_farmer_raw": "raw_dgathered", "harvest_data": "year_gathered",
            "qp_price": "date", "weather_data": "date", "pests": "id",
        }

        def write_one(name: str) -> None:
            df = getattr(self, name)
            if name in sort_keys:
                key = sort_keys[name]
                spread = F.xxhash64(*[F.col(c) for c in df.columns])
                df = (df.withColumn("_spread", spread).repartitionByRange(n, key, "_spread")
                      .sortWithinPartitions(key).drop("_spread"))
            df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).parquet(f"{path}/{name}")

        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            list(pool.map(write_one, CURATED))
        return Tables.from_curated(spark, path)

    def with_collation(self, collation: str = "UTF8_LCASE") -> "Tables":
        """Tables whose text columns compare, group and count under
        ``collation`` (MySQL's default collation ignores case, and accents;
        Spark's ``UTF8_LCASE`` / ``UNICODE_CI_AI`` do the same), so 'Ana' and
        'ANA' are one farmer and a municipality name matches in any case.
        Values are unchanged; the default stays binary."""
        from pyspark.sql import types as T

        def collate(df: DataFrame) -> DataFrame:
            return df.select(*[
                F.collate(F.col(f"`{f.name}`"), collation).alias(f.name) if isinstance(f.dataType, T.StringType)
                else F.col(f"`{f.name}`") for f in df.schema.fields
            ])

        dfs = {name: collate(getattr(self, name)) for name in CURATED}
        return Tables(**dfs)

    def cache(self, names=("qp_farmer_raw",)) -> "Tables":
        for name in names:
            setattr(self, name, getattr(self, name).cache())
        return self


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

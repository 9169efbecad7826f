import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ananas.sources import schemas  # noqa: E402
from ananas.sources.tables import Tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("ananas-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def synthetic(spark):
    return Tables.from_synthetic(spark, SF_SMALL)


def D(s):
    return Decimal(s)


def day(s):
    return dt.date.fromisoformat(s)


SCHEMAS = {
    "qp_farmer_raw": schemas.QP_FARMER_RAW,
    "farmer_demo": schemas.FARMER_DEMO,
    "tbl_muni": schemas.TBL_MUNI,
    "tbl_barangay": schemas.TBL_BARANGAY,
    "harvest_data": schemas.HARVEST_DATA,
    "qp_price": schemas.QP_PRICE,
    "weather_data": schemas.WEATHER_DATA,
    "pests": schemas.PESTS,
}

DEFAULT_MUNI = [("1", "Alpha"), ("2", "Beta"), ("9", "Nine"), ("10", "Ten")]


def survey_row(fname="A", mname="M", lname="Z", muni="1", brgy="b1", gender="M", area="1.0000", pop=10,
               gathered="2000-03-01", harvest="2001-02-01", rbsba="R1", tenurial="", logs=1, f_id="1"):
    return (logs, f_id, muni, brgy, fname, mname, lname, gender, day("1980-01-01"),
            None if area is None else D(area), pop, None if gathered is None else day(gathered),
            None if harvest is None else day(harvest), rbsba, tenurial)


@pytest.fixture
def make_tables(spark):
    """Tables from hand rows; unspecified tables are empty (muni has 4 rows)."""

    def build(**rows):
        rows.setdefault("tbl_muni", DEFAULT_MUNI)
        dfs = {name: spark.createDataFrame(rows.get(name, []), SCHEMAS[name]) for name in SCHEMAS}
        return Tables(**dfs)

    return build

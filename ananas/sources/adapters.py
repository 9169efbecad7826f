"""Synthetic star schema -> domain tables.

The driver's test data is a TPC-H-like schema. These functions give its
tables the roles of the reporting database (FIXTURES.md section 3 has the
same mapping as SQL; the oracle uses that text). Every value below is a
deterministic function of the source row, so Spark and the SQL oracle agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Reader = Callable[[str], DataFrame]


def _s(c: Column) -> Column:
    return c.cast("string")


def tbl_muni(read: Reader) -> DataFrame:
    n = read("nation")
    return n.select(_s(F.col("n_nationkey")).alias("muni_id"), F.col("n_name").alias("muni_name"))


def tbl_barangay(read: Reader) -> DataFrame:
    s = read("supplier")
    return s.select(
        _s(F.col("s_suppkey")).alias("brgy_id"), F.col("s_name").alias("brgy_name"),
        _s(F.col("s_nationkey")).alias("muni_id"),
    )


def _farmer_cols(c: DataFrame) -> list[Column]:
    k = F.col("c_custkey")
    return [
        _s(k).alias("f_id"),
        F.col("c_mktsegment").alias("f_name"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("X"), _s(k % 5))).alias("m_name"),
        F.col("c_name").alias("l_name"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("f_gender"),
        F.make_date((1910 + k % 95).cast("int"), (1 + k % 12).cast("int"), (1 + k % 28).cast("int")).alias("f_birthdate"),
        _s(F.col("c_nationkey")).alias("f_municipality"),
        _s(k % 10).alias("f_barangay"),
    ]


def farmer_demo(read: Reader) -> DataFrame:
    return read("customer").select(*_farmer_cols(read("customer")))


def qp_farmer_raw(read: Reader) -> DataFrame:
    """One survey row per line item, with its order's date and customer.

    Orders meet customers first and the result meets line items, so the
    largest table is shuffled once (on the order key) rather than twice.
    """
    cust = read("customer").select("c_custkey", *_farmer_cols(read("customer")))
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    order_farmer = orders.join(cust, orders.o_custkey == cust.c_custkey, "inner").drop("c_custkey")
    li = read("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate",
    )
    j = li.join(order_farmer, li.l_orderkey == order_farmer.o_orderkey, "inner")
    ck = F.col("o_custkey")
    fm, fid, flag = F.col("f_municipality"), F.col("f_id"), F.col("l_returnflag")
    null_s = F.lit(None).cast("string")
    rbsba = (
        F.when(fm == "5", fid).when(fm == "6", F.lit(""))
        .when(ck % 3 == 0, fid)
        .when((ck % 3 == 1) & (flag == "N"), null_s)
        .when(ck % 3 == 1, F.lit(""))
        .when(flag == "N", null_s)
        .when(flag == "R", F.lit(""))
        .otherwise(fid)
    )
    tenure = ck % 8
    tenurial = (
        F.when(tenure == 0, null_s).when(tenure == 1, F.lit("")).when(tenure == 2, F.lit("Tenant"))
        .when(tenure == 3, F.lit("Cultivator")).when(tenure == 4, F.lit("Owner")).when(tenure == 5, F.lit("Lesse"))
        .when(tenure == 6, F.lit("Renting")).otherwise(F.lit("Co-Owner"))
    )
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("logs"),
        fid.alias("f_id"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit("")).otherwise(fm).alias("raw_municipality"),
        _s(F.col("l_suppkey")).alias("raw_barangay"),
        F.col("f_name").alias("raw_fname"), F.col("m_name").alias("raw_mname"), F.col("l_name").alias("raw_lname"),
        F.col("f_gender").alias("raw_gender"), F.col("f_birthdate").alias("raw_bdate"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)"))
        .cast("decimal(18,4)").alias("raw_area"),
        F.col("l_quantity").cast("long").alias("raw_population"),
        F.col("o_orderdate").cast("date").alias("raw_dgathered"),
        F.col("l_shipdate").cast("date").alias("raw_dharvest"),
        rbsba.alias("RBSBA"),
        tenurial.alias("tenurial"),
    )


def harvest_data(read: Reader) -> DataFrame:
    nation = read("nation").select("n_nationkey", "n_name")
    supp = read("supplier").select("s_suppkey", "s_name", "s_nationkey")
    place = supp.join(nation, supp.s_nationkey == nation.n_nationkey, "inner")
    li = read("lineitem").select("l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    j = li.join(place, li.l_suppkey == place.s_suppkey, "inner")
    return j.select(
        F.col("n_name").alias("Municipality"),
        F.col("s_name").alias("Barangay"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount")).cast("decimal(4,2)"))
        .cast("decimal(18,4)").alias("Production"),
        F.col("l_shipdate").cast("date").alias("year_gathered"),
    )


def qp_price(read: Reader) -> DataFrame:
    o = read("orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return o.select(
        F.col("o_orderdate").cast("date").alias("date"),
        (price - 10).cast("decimal(18,2)").alias("med_price"),
        price.alias("lg_price"),
        F.lit(None).cast("string").alias("buyer_seller"),
    )


def weather_data(read: Reader) -> DataFrame:
    li = read("lineitem")
    return li.select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_tax").cast("decimal(10,2)").alias("rain_amount"),
        F.lit("N/A").alias("note"),
    )


def pests(read: Reader) -> DataFrame:
    p = read("part")
    t = F.col("p_type")
    category = (
        F.when(t.isin("ECONOMY", "PROMO"), F.lit("Pests"))
        .when(t.isin("LARGE", "MEDIUM"), F.lit("Diseases"))
        .otherwise(F.lit("Weeds"))
    )
    return p.select(
        F.col("p_partkey").cast("long").alias("id"), category.alias("category"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("description"),
        F.col("p_retailprice").cast("double").alias("percent"), F.col("p_size").cast("int").alias("rank"),
    )


def domain_tables(read: Reader) -> dict[str, DataFrame]:
    return {
        "qp_farmer_raw": qp_farmer_raw(read),
        "farmer_demo": farmer_demo(read),
        "tbl_muni": tbl_muni(read),
        "tbl_barangay": tbl_barangay(read),
        "harvest_data": harvest_data(read),
        "qp_price": qp_price(read),
        "weather_data": weather_data(read),
        "pests": pests(read),
    }

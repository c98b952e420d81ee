"""Loan snapshots made from trade tables, so that the analytics can run where no loan data is at hand.

A deal is a customer's nation, a loan a customer, a period a year of orders, a property one brand among the year's items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import ADVANCES

BEFORE, AFTER = 1999, 2000
_AMOUNT = "decimal(20,8)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, years: tuple[int, ...] | None) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    if years:
        o = o.filter(
            (F.col("o_orderdate") >= F.lit(f"{min(years)}-01-01").cast("timestamp")) & (
                F.col("o_orderdate") < F.lit(f"{max(years) + 1}-01-01").cast("timestamp")
            )
        )
    return o.withColumn("y", F.year("o_orderdate"))


def snapshots(
    spark: SparkSession, sf_dir: str, years: tuple[int, ...] | None = None, properties: bool = False
) -> DataFrame:
    o = _orders(spark, sf_dir, years)
    cents = lambda c: F.col(c).cast("decimal(18,2)")
    snap = o.groupBy("o_custkey", "y").agg(
        F.max("o_orderdate").cast("date").alias("paid_through_date"), F.sum(cents("o_totalprice")).alias("actual"), F.max(cents("o_totalprice")).alias("top"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"),
    )
    items = table(spark, sf_dir, "lineitem")
    line = o.select("o_orderkey", "o_custkey", "y").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    sched = line.groupBy("o_custkey", "y").agg(
        F.sum(cents("l_extendedprice")).alias("scheduled"), F.sum(cents("l_discount")).alias("advances")
    )
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lpad(F.col("c_nationkey").cast("string"), 10, "0").alias("cik")
    )
    out = snap.join(sched, ["o_custkey", "y"], "left").join(c, F.col("o_custkey") == F.col("c_custkey"))
    if properties:
        p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
        s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("state"))
        by_brand = line.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("o_custkey", "y", "p_brand").agg(
            F.min("p_type").alias("kind"), F.min("state").alias("state"), F.sum(cents("l_extendedprice")).alias("value"), F.sum(
                F.when(F.col("l_returnflag") == "N", cents("l_extendedprice"))
            ).alias("noi"),
        )
        one = F.struct(
            F.col("p_brand").alias("property_name"), F.col("kind").alias("property_type_code"), "state",
            F.struct(F.col("value").cast(_AMOUNT).alias("valuation_amount")).alias("at_securitization"),
            F.when(
                F.col("noi").isNotNull(), F.struct(F.col("noi").cast(_AMOUNT).alias("net_operating_income_amount"))
            ).alias("most_recent"),
        )
        # a year's brands of one customer are few and bounded by the number of brands
        arrays = by_brand.select("o_custkey", "y", one.alias("p")).groupBy("o_custkey", "y").agg(
            F.array_sort(F.collect_list("p")).alias("properties")
        )
        out = out.join(arrays, ["o_custkey", "y"], "left")
    else:
        out = out.withColumn("properties", F.lit(None).cast("array<struct<property_name:string>>"))
    return out.select(
        "cik", F.concat_ws("-", "cik", "y").alias("accession_number"), F.col("o_custkey").alias("doc_position"), F.col("o_custkey").cast("string").alias("asset_number"), F.col("y").alias("period_year"),
        F.make_date("y", F.lit(1), F.lit(1)).alias("period_beginning_date"), F.make_date("y", F.lit(12), F.lit(31)).alias("period_ending_date"), "paid_through_date",
        (F.col("actual") + F.col("top")).cast(_AMOUNT).alias("original_loan_amount"), F.col("actual").cast(_AMOUNT).alias("actual_balance_amount"), F.col("scheduled").cast(_AMOUNT).alias("scheduled_balance_amount"),
        F.when(F.col("last_status") == "F", "0").when(F.col("last_status") == "O", "B").alias("payment_status_code"), F.coalesce("properties", F.array()).alias("properties"),
        F.when(
            F.col("advances").isNotNull(), F.create_map(F.lit(ADVANCES), F.col("advances").cast("string"))
        ).otherwise(F.create_map().cast("map<string,string>")).alias("raw_fields"),
    )


def period(spark: SparkSession, sf_dir: str, year: int, properties: bool = False) -> DataFrame:
    return snapshots(spark, sf_dir, (year,), properties)


def sql(properties: bool = False) -> str:
    """The same snapshots as common table expressions: loans, and props where properties are asked for."""
    out = f"""WITH o AS (SELECT *, year(o_orderdate) AS y FROM orders),
snap AS (SELECT o_custkey, y, cast(max(o_orderdate) AS date) AS paid, sum(cast(o_totalprice AS decimal(18,2))) AS actual, max(cast(o_totalprice AS decimal(18,2))) AS top, arg_max(o_orderstatus, o_orderkey) AS last_status FROM o GROUP BY o_custkey, y),
sched AS (SELECT o_custkey, y, sum(cast(l_extendedprice AS decimal(18,2))) AS scheduled, sum(cast(l_discount AS decimal(18,2))) AS advances FROM o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, y),
loans AS (SELECT lpad(cast(c_nationkey AS varchar), 10, '0') AS cik, cast(s.o_custkey AS varchar) AS asset, s.y, paid, actual, actual + top AS original, scheduled, advances,
 CASE last_status WHEN 'F' THEN '0' WHEN 'O' THEN 'B' END AS status FROM snap s LEFT JOIN sched d ON d.o_custkey = s.o_custkey AND d.y = s.y JOIN customer ON c_custkey = s.o_custkey),
a AS (SELECT * FROM loans WHERE y = {BEFORE}), b AS (SELECT * FROM loans WHERE y = {AFTER})"""
    if properties:
        out += f""",
props AS (SELECT lpad(cast(c_nationkey AS varchar), 10, '0') AS cik, cast(o_custkey AS varchar) AS asset, y, p_brand AS name, min(p_type) AS kind, min(cast(s_nationkey AS varchar)) AS state,
 sum(cast(l_extendedprice AS decimal(18,2))) AS value, sum(CASE WHEN l_returnflag = 'N' THEN cast(l_extendedprice AS decimal(18,2)) END) AS noi
 FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey WHERE y IN ({BEFORE}, {AFTER}) GROUP BY c_nationkey, o_custkey, y, p_brand)"""
    return out + "\n"

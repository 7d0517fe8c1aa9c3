"""Transaction logs derived from the given test tables, for checks and tests.

Each view has the columns of the transaction log: customer_id, transaction_id,
timestamp, amount, merchant_category, device_id, location, failed_logins_24h,
is_fraud.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("customer_id"), F.col("event_id").alias("transaction_id"),
        F.col("ts").alias("timestamp"), F.col("value"),
        F.col("event_type").alias("merchant_category"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def episode_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events in which every eighth customer has four days of marked rows.

    All columns follow from the event: marked rows have a raised amount, mostly
    one of twenty devices that customers share, and half of them a place abroad.
    """
    k, customer = F.col("k"), F.col("customer_id").cast("string")
    marked = (F.col("customer_id") % 8 == 0) & F.dayofmonth("timestamp").between(14, 17)
    own_device = F.concat(F.lit("DEV_"), customer, F.when(k < 85, "_A").otherwise("_B"))
    shared_device = F.concat(F.lit("SHARED_"), (F.col("transaction_id") % 20).cast("string"))
    home = F.concat(F.lit("CITY_"), (F.col("customer_id") % 10).cast("string"))
    abroad = F.concat(F.lit("ABROAD_"), (k % 5).cast("string"))
    return _events(spark, folder).select(
        "customer_id", "transaction_id", "timestamp",
        F.when(marked, F.round(F.col("value") * (k + 50) / 25, 2)).otherwise(F.col("value"))
        .alias("amount"),
        "merchant_category",
        F.when(marked & (k < 80), shared_device).otherwise(own_device).alias("device_id"),
        F.when(marked & (k % 2 == 0), abroad).otherwise(home).alias("location"),
        F.when(marked, 2 + k % 4).when(k % 10 == 0, 1).otherwise(0).cast("int")
        .alias("failed_logins_24h"),
        F.when(marked, 1).otherwise(0).alias("is_fraud"))


def hot_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events with few devices and locations, each shared by many customers."""
    k = F.col("k")
    fraud = (F.col("value") >= 120) & F.col("merchant_category").isin("error", "purchase")
    return _events(spark, folder).select(
        "customer_id", "transaction_id", "timestamp", F.col("value").alias("amount"),
        "merchant_category", F.concat(F.lit("DEV_"), k.cast("string")).alias("device_id"),
        F.concat(F.lit("LOC_"), (k % 15).cast("string")).alias("location"),
        F.lit(0).alias("failed_logins_24h"), F.when(fraud, 1).otherwise(0).alias("is_fraud"))


def skewed_log(spark: SparkSession, folder: str) -> DataFrame:
    """The hot log with a third of all customers merged into one, and so for devices."""
    log = hot_log(spark, folder)
    merged = F.col("customer_id") % 3 == 0
    return log.select(
        F.when(merged, 0).otherwise(F.col("customer_id")).cast("bigint").alias("customer_id"),
        *log.columns[1:])


def skewed_null_log(spark: SparkSession, folder: str) -> DataFrame:
    """The skewed log in which the merged customer is null."""
    log = skewed_log(spark, folder)
    return log.withColumn("customer_id", F.nullif("customer_id", F.lit(0)))


def orders_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as transactions: equal timestamps, short histories, null devices."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    supplier = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("s"))
    fraud = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 450000)
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(
            F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("transaction_id"),
            F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("amount"),
            F.col("o_orderpriority").alias("merchant_category"),
            F.concat(F.lit("SUP_"), F.col("s").cast("string")).alias("device_id"),
            F.col("n_name").alias("location"), F.col("r_name").alias("home_region"),
            F.lit(0).alias("failed_logins_24h"), F.when(fraud, 1).otherwise(0).alias("is_fraud"))
    )


def dirty_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A batch file with missing and out-of-range fields."""
    k, customer = F.col("k"), F.col("customer_id").cast("string")
    return _events(spark, folder).select(
        F.when(k == 7, None).otherwise(customer).alias("customer_id"),
        "transaction_id", "timestamp",
        F.when(k % 25 == 0, -F.col("value")).when(k % 25 == 1, None)
        .otherwise(F.col("value")).alias("amount"),
        "merchant_category",
        F.when(k % 3 == 0, None).when(k % 3 == 1, "")
        .otherwise(F.concat(F.lit("DEV_"), customer, F.lit("_A"))).alias("device_id"),
        F.when(k % 4 == 0, None).otherwise(F.concat(
            F.lit("CITY_"), (F.col("customer_id") % 10).cast("string"))).alias("location"),
        F.when(k % 5 == 0, None).when(k % 50 == 1, -1).otherwise(k % 3)
        .alias("failed_logins_24h"))


# Home test of each log, in place of the fixed list of home cities.

def episode_home():
    return F.col("location").startswith("CITY_")


def hot_home():
    return F.substring("location", 5, 10).cast("int") < 10


def orders_home():
    return F.col("home_region") == "ASIA"

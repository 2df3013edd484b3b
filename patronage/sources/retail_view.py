"""Canonical transactions derived from an order / line-item star schema.

Returned lines (``l_returnflag = 'R'``) become credit notes: a ``C`` invoice dated at shipment with
a negative quantity. Only the joins that the requested columns need are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def retail_transactions(
    spark: SparkSession, folder: str, country: bool = False, description: bool = False
) -> DataFrame:
    lines = _table(spark, folder, "lineitem")
    joined = lines.join(
        _table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    if country:
        customer = _table(spark, folder, "customer").select("c_custkey", "c_nationkey")
        nation = _table(spark, folder, "nation").select("n_nationkey", "n_name")
        joined = joined.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
            nation, F.col("c_nationkey") == F.col("n_nationkey")
        )
    if description:
        part = _table(spark, folder, "part").select("p_partkey", "p_name")
        joined = joined.join(part, F.col("l_partkey") == F.col("p_partkey"))

    returned = F.col("l_returnflag") == "R"
    unit_cents = F.expr(
        "(2 * cast(rint(l_extendedprice * 100) as bigint) + cast(l_quantity as bigint))"
        " div (2 * cast(l_quantity as bigint))"
    )
    columns = [
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.concat(F.when(returned, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias(
            "invoice_no"
        ),
        F.when(returned, F.col("l_shipdate")).otherwise(F.col("o_orderdate")).alias("invoice_date"),
        F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        (unit_cents / F.lit(100.0)).alias("unit_price"),
    ]
    if country:
        columns.append(F.col("n_name").alias("country"))
    if description:
        columns.append(F.col("p_name").alias("description"))
    return joined.select(*columns)


def purchase_events(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases of the event log as single-line invoices with intraday timestamps."""
    return (
        _table(spark, folder, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").cast("string").alias("customer_id"),
            F.col("event_id").cast("string").alias("invoice_no"),
            F.col("ts").alias("invoice_date"),
            F.lit(1.0).alias("quantity"),
            F.col("value").alias("unit_price"),
        )
    )

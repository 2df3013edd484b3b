"""Acquisition cohorts and monthly retention, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.functions.text import round_to
from patronage.schema import require_columns


def customer_activity(df: DataFrame) -> DataFrame:
    """One row per customer and active month: ``cohort_month`` and ``cohort_index``.

    A customer is reduced to the set of its active months before the shuffle, so a customer with
    very many transactions costs no more than one with a few per month.
    """
    require_columns(df, ["customer_id", "invoice_date"], "cohorts")
    month = F.trunc(F.col("invoice_date").cast("timestamp_ntz"), "MM")
    months = F.col("months")
    since = F.months_between("active_month", "cohort_month").cast("int")
    return (
        df.groupBy("customer_id")
        .agg(F.collect_set(month).alias("months"))
        .select(
            "customer_id",
            F.array_min(months).alias("cohort_month"),
            F.explode(months).alias("active_month"),
        )
        .withColumn("cohort_index", since)
    )


def cohort_matrix(df: DataFrame) -> DataFrame:
    """``cohort_month, cohort_index, customers, retention_pct`` for every index 0..max.

    Quiet months stay null: no customer was counted, which differs from a count of zero.
    """
    counts = (
        customer_activity(df)
        .groupBy("cohort_month", "cohort_index")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    # From here on there is one row per cohort and month.
    size = F.max(F.when(F.col("cohort_index") == 0, F.col("customers")))
    per_cohort = counts.groupBy("cohort_month").agg(
        size.alias("cohort_size"),
        F.max("cohort_index").alias("last_index"),
        F.map_from_entries(F.collect_list(F.struct("cohort_index", "customers"))).alias("by_index"),
    )
    width = F.max("last_index").over(W.partitionBy())
    cells = per_cohort.withColumn("width", width).select(
        "cohort_month",
        "cohort_size",
        "by_index",
        F.explode(F.sequence(F.lit(0), F.col("width"))).alias("cohort_index"),
    )
    customers = F.try_element_at("by_index", F.col("cohort_index"))
    return cells.select(
        F.date_format("cohort_month", "yyyy-MM").alias("cohort_month"),
        "cohort_index",
        customers.alias("customers"),
        round_to(customers / F.col("cohort_size") * 100, 1).alias("retention_pct"),
    )


def pivot_cohorts(matrix: DataFrame, value: str = "retention_pct") -> DataFrame:
    """Wide display form: one row per cohort, one column per month since acquisition."""
    return matrix.groupBy("cohort_month").pivot("cohort_index").agg(F.first(value))


def cohort_summary(matrix: DataFrame) -> DataFrame:
    """One row: number of cohorts and mean retention at months 1, 3 and 6."""

    def mean_at(month: int):
        value = F.avg(F.when(F.col("cohort_index") == month, F.col("retention_pct")))
        return F.coalesce(round_to(value, 1), F.lit(0.0)).alias(f"avg_m{month}_retention")

    cohorts = F.count(F.when(F.col("cohort_index") == 0, F.lit(1)))
    return matrix.agg(cohorts.alias("total_cohorts"), *[mean_at(m) for m in (1, 3, 6)])

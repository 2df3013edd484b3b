"""Out-of-time validation: windows, transitions, forward value, migration."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.functions.text import exact_sum, round_to
from patronage.operators.rfm import (
    _as_datetime,
    _midnight_after,
    _timestamp,
    customer_totals,
    invoiced_lines,
    rfm_from_totals,
)
from patronage.schema import require_columns

CHURNED = "Churned (Inactive)"
MIN_SPAN_DAYS = 7


def _check_cutoff(cutoff: datetime, first: datetime | None, last: datetime | None) -> None:
    if first is None:
        raise ValueError("The table is empty or without dates, so it cannot be split.")
    if not first <= cutoff < last:
        raise ValueError(
            f"A cutoff of {cutoff:%Y-%m-%d} leaves one side empty: rows run from {first:%Y-%m-%d} to {last:%Y-%m-%d}."
        )


def _bounds(df: DataFrame, first: str, last: str):
    return df.agg(
        F.min(first).cast("timestamp_ntz").alias("first"),
        F.max(last).cast("timestamp_ntz").alias("last"),
    ).first()


def split_windows(df: DataFrame, cutoff: datetime | date | str) -> tuple[DataFrame, DataFrame]:
    """Transactions up to ``cutoff`` (inclusive) and after it."""
    require_columns(df, ["invoice_date"], "window split")
    cutoff = _as_datetime(cutoff)
    _check_cutoff(cutoff, *_bounds(df, "invoice_date", "invoice_date"))
    at = _timestamp(cutoff)
    return df.where(F.col("invoice_date") <= at), df.where(F.col("invoice_date") > at)


def windowed_rfm(df: DataFrame, cutoff: datetime | date | str) -> tuple[DataFrame, DataFrame]:
    """RFM of both windows: the first as of ``cutoff``, the second as of its own last day.

    One aggregation by customer and window reads the transactions once for both.
    """
    cutoff = _as_datetime(cutoff)
    later = F.col("invoice_date") > _timestamp(cutoff)
    lines = invoiced_lines(df).where(F.col("invoice_date").isNotNull()).withColumn("_later", later)
    totals = customer_totals(lines, "_later")
    first, last = _bounds(totals, "first_purchase", "last_purchase")
    _check_cutoff(cutoff, first, last)
    return tuple(
        rfm_from_totals(totals.where(side).drop("_later"), lines.where(side), snapshot)
        for side, snapshot in ((~F.col("_later"), cutoff), (F.col("_later"), _midnight_after(last)))
    )


def default_cutoff(df: DataFrame) -> DataFrame:
    """One row: first and last day, span, and the middle day if the span allows a split."""
    days = df.agg(
        F.min(F.col("invoice_date").cast("date")).alias("min_date"),
        F.max(F.col("invoice_date").cast("date")).alias("max_date"),
    )
    span = F.date_diff("max_date", "min_date")
    middle = F.date_add("min_date", F.floor(span / 2).cast("int"))
    return days.select(
        "min_date",
        "max_date",
        span.alias("total_days"),
        (span >= MIN_SPAN_DAYS).alias("long_enough"),
        F.when(span >= MIN_SPAN_DAYS, middle).alias("cutoff_date"),
    )


def _one_per_customer(labeled: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(labeled, columns, "backtest")
    return labeled.select(*columns).dropDuplicates(["customer_id"])


def transition_pairs(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """Customers per (T1 segment, T2 segment); null stands for absence from a window.

    The one full join all transition figures derive from; its result has at most
    (segments + 1) squared rows.
    """
    left = _one_per_customer(t1, ["customer_id", "segment"]).withColumnRenamed("segment", "segment_t1")
    right = _one_per_customer(t2, ["customer_id", "segment"]).withColumnRenamed("segment", "segment_t2")
    left, right = left.withColumn("in_t1", F.lit(True)), right.withColumn("in_t2", F.lit(True))
    return (
        left.join(right, "customer_id", "full")
        .groupBy(
            "segment_t1",
            "segment_t2",
            F.coalesce("in_t1", F.lit(False)).alias("in_t1"),
            F.coalesce("in_t2", F.lit(False)).alias("in_t2"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def transition_matrix(t1: DataFrame, t2: DataFrame, churn_label: str = CHURNED) -> DataFrame:
    """``segment_t1, segment_t2, n, prob`` for every T1 segment and T2 segment or churn."""
    pairs = transition_pairs(t1, t2)
    everything = W.partitionBy()
    columns = F.array_union(
        F.collect_set(F.when(F.col("in_t2"), F.col("segment_t2"))).over(everything),
        F.array(F.lit(churn_label)),
    )
    target = F.coalesce("segment_t2", F.lit(churn_label))
    rows = (
        pairs.withColumn("columns", columns)
        .where("in_t1")
        # A real segment may bear the churn label: one sum for each target first.
        .groupBy("segment_t1", "columns", target.alias("target"))
        .agg(F.sum("n").alias("n"))
        .groupBy("segment_t1", "columns")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("target", "n"))).alias("by_target"),
            F.sum("n").alias("row_total"),
        )
    )
    cells = rows.select("*", F.explode("columns").alias("segment_t2"))
    n = F.coalesce(F.try_element_at("by_target", F.col("segment_t2")), F.lit(0))
    return cells.select(
        "segment_t1",
        "segment_t2",
        n.alias("n"),
        F.coalesce(F.try_divide(n, F.col("row_total")), F.lit(0.0)).alias("prob"),
    )


def retention_summary(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """One row: retained, churned and new customers with their rates."""

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    in_t1, in_t2 = F.col("in_t1"), F.col("in_t2")
    sums = transition_pairs(t1, t2).agg(
        total(in_t1).alias("total_t1_customers"),
        total(in_t1 & in_t2).alias("retained_count"),
        total(in_t1 & ~in_t2).alias("churned_count"),
        total(in_t2 & ~in_t1).alias("new_customers_count"),
    )

    def rate(part: str):
        return round_to(F.coalesce(F.try_divide(part, "total_t1_customers"), F.lit(0.0)), 4)

    return sums.select(
        "*", rate("retained_count").alias("retention_rate"), rate("churned_count").alias("churn_rate")
    )


def forward_value(t1: DataFrame, t2_rfm: DataFrame) -> DataFrame:
    """Per T1 segment: who came back in T2 and what they spent."""
    customers = _one_per_customer(t1, ["customer_id", "segment"])
    outcome = _one_per_customer(t2_rfm, ["customer_id", "frequency", "monetary"])
    joined = customers.join(outcome, "customer_id", "left")
    active = F.col("frequency").isNotNull()
    spend = F.coalesce(F.col("monetary"), F.lit(0.0))
    count, active_count = F.count(F.lit(1)), F.count(F.when(active, F.lit(1)))
    total = exact_sum(spend)

    def per(whole):
        return round_to(F.coalesce(F.try_divide(total, whole), F.lit(0.0)), 2)

    return joined.groupBy("segment").agg(
        count.alias("customer_count"),
        active_count.alias("forward_active_count"),
        round_to(total, 2).alias("total_forward_spend"),
        per(count).alias("avg_forward_spend"),
        round_to(F.avg(F.coalesce("frequency", F.lit(0))), 2).alias("avg_forward_orders"),
        round_to(active_count / count * 100, 2).alias("forward_retention_pct"),
        per(active_count).alias("avg_spend_active_buyers"),
    )


def migration_details(t1: DataFrame, t2: DataFrame, churn_label: str = CHURNED) -> DataFrame:
    """Per T1 customer: segment and spend before and after, and what became of it."""
    columns = ["customer_id", "segment", "monetary"]
    require_columns(t1, columns, "migration")
    require_columns(t2, columns, "migration")
    before = t1.select("customer_id", F.col("segment").alias("t1_segment"), F.col("monetary").alias("t1_spend"))
    after = t2.select("customer_id", F.col("segment").alias("t2_segment"), F.col("monetary").alias("t2_spend"))
    joined = before.join(after, "customer_id", "left").withColumns(
        {
            "t2_segment": F.coalesce("t2_segment", F.lit(churn_label)),
            "t2_spend": F.coalesce("t2_spend", F.lit(0.0)),
        }
    )
    status = (
        F.when(F.col("t2_segment") == churn_label, "Churned")
        .when(F.col("t1_segment") == F.col("t2_segment"), "Retained (Stable)")
        .otherwise("Migrated")
    )
    return joined.withColumn("migration_status", status)


def filter_migration(
    details: DataFrame, t1_segment: str | None = None, status: str | None = None
) -> DataFrame:
    if t1_segment is not None:
        details = details.where(F.col("t1_segment") == t1_segment)
    return details if status is None else details.where(F.col("migration_status") == status)

"""Recency, frequency and monetary metrics, their summary, scores and correlations."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.order_stats import SLICE_ROWS, exact_percentiles, keys_at_ranks, unpivot_metrics
from patronage.functions.text import exact_mean, exact_sum, is_missing, round_to
from patronage.schema import (
    MISSING_INVOICE_TEXT,
    REQUIRED_COLUMNS,
    RFM_FEATURES,
    require_columns,
)
from patronage.session import as_stored, materialize


def snapshot_frame(df: DataFrame) -> DataFrame:
    """One row: the midnight after the latest transaction."""
    last_day = F.max("invoice_date").cast("date")
    return df.agg(F.date_add(last_day, 1).cast("timestamp_ntz").alias("snapshot_date"))


def default_snapshot_date(df: DataFrame) -> datetime:
    require_columns(df, ["invoice_date"], "snapshot date")
    snapshot = snapshot_frame(df).first()["snapshot_date"]
    if snapshot is None:
        raise ValueError("The table has no dates to take a snapshot from.")
    return snapshot


def _midnight_after(moment: datetime) -> datetime:
    return datetime.combine(moment.date(), time()) + timedelta(days=1)


def _as_datetime(moment: datetime | date | str) -> datetime:
    """Wall-clock time; a zone, if any, is dropped and a bare date means midnight."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if not isinstance(moment, datetime):
        moment = datetime.combine(moment, time())
    return moment.replace(tzinfo=None)


def _timestamp(moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def calculate_rfm(
    df: DataFrame,
    snapshot_date: datetime | date | str | None = None,
    lookback_days: int | None = None,
    use_average_monetary: bool = False,
) -> DataFrame:
    """One row per customer: recency, frequency, monetary, first/last purchase and main country.

    The transactions are read once: they are aggregated per customer (partial sums are formed before
    the shuffle) and stored at that grain, and the snapshot follows from the stored table. Only a
    lookback needs an extra look at the dates first.
    """
    lines, bought_on = invoiced_lines(df), F.col("invoice_date")
    snapshot = None if snapshot_date is None else _as_datetime(snapshot_date)
    if lookback_days:
        latest = lines.agg(F.max(bought_on).cast("timestamp_ntz").alias("last")).first()
        snapshot = _checked_snapshot(latest["last"], snapshot)
        start = snapshot - timedelta(days=lookback_days)
        lines = lines.where(bought_on.between(_timestamp(start), _timestamp(snapshot)))

    table = customer_totals(lines)
    found = table.agg(F.max("last_purchase").cast("timestamp_ntz").alias("last")).first()
    if lookback_days and found["last"] is None:
        raise ValueError(
            f"The {lookback_days} days before the snapshot (the lookback) hold no rows."
        )
    if not lookback_days:
        snapshot = _checked_snapshot(found["last"], snapshot)
    return rfm_from_totals(table, lines, snapshot, use_average_monetary)


def invoiced_lines(df: DataFrame) -> DataFrame:
    """Rows with a real invoice number."""
    require_columns(df, REQUIRED_COLUMNS, "RFM calculation")
    invoice_type = df.schema["invoice_no"].dataType
    return df.where(~is_missing(F.col("invoice_no"), invoice_type, MISSING_INVOICE_TEXT))


def customer_totals(lines: DataFrame, within: str | None = None) -> DataFrame:
    """Stored totals per customer, and per value of the column ``within`` if given."""
    bought_on, quantity = F.col("invoice_date"), F.col("quantity")
    purchase = quantity > 0
    measures = [
        F.min(bought_on).alias("first_purchase"),
        F.max(bought_on).alias("last_purchase"),
        F.max(F.when(purchase, bought_on)).alias("last_bought"),
        F.countDistinct(F.when(purchase, F.col("invoice_no"))).alias("orders"),
        exact_sum(quantity * F.col("unit_price")).alias("spend"),
    ]
    if "country" in lines.columns:
        measures.append(F.coalesce(F.mode("country", True), F.lit("Unknown")).alias("country"))
    keys = [F.col("customer_id").cast("string").alias("customer_id")]
    keys += [F.col(within)] if within else []
    return materialize(lines.groupBy(*keys).agg(*measures))


def rfm_from_totals(
    table: DataFrame, lines: DataFrame, snapshot: datetime, use_average_monetary: bool = False
) -> DataFrame:
    """Metrics as of ``snapshot`` from the totals of ``lines``."""
    if table.where("last_bought is not null").isEmpty():
        # Without a single purchase in the whole table, orders are counted over all rows.
        customer = F.col("customer_id").cast("string").alias("customer_id")
        invoices = lines.groupBy(customer).agg(F.countDistinct("invoice_no").alias("orders"))
        table = materialize(table.drop("orders").join(invoices, "customer_id"))
    # Whole 24-hour periods of wall-clock time, whatever the session time zone.
    last = F.coalesce("last_bought", "last_purchase")
    age = F.extract(F.lit("DAY"), _timestamp(snapshot) - last)
    orders = F.greatest(F.col("orders"), F.lit(1))
    monetary = F.greatest(round_to(F.coalesce("spend", F.lit(0.0)), 2), F.lit(0.0))
    if use_average_monetary:
        monetary = round_to(monetary / orders, 2)
    columns = [
        "customer_id",
        F.greatest(age, F.lit(0)).cast("bigint").alias("recency"),
        orders.cast("bigint").alias("frequency"),
        monetary.alias("monetary"),
        "first_purchase",
        "last_purchase",
    ]
    return as_stored(table.select(*columns, *[c for c in ["country"] if c in table.columns]))


def _checked_snapshot(last: datetime | None, snapshot: datetime | None) -> datetime:
    """The given snapshot, or the midnight after the ``last`` transaction."""
    if last is None:
        raise ValueError("The table is empty: nothing to compute metrics from.")
    if snapshot is None:
        return _midnight_after(last)
    if snapshot < last:
        raise ValueError(
            f"Rows up to {last:%Y-%m-%d} lie after the snapshot of {snapshot:%Y-%m-%d}."
        )
    return snapshot


def rfm_summary(rfm: DataFrame) -> DataFrame:
    """Mean, sample deviation, extremes and quartiles per metric, two digits each."""
    metrics = [m for m in RFM_FEATURES if m in rfm.columns]
    long = unpivot_metrics(rfm, [], metrics)
    quartiles = exact_percentiles(long, ["metric"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    moments = long.groupBy("metric").agg(
        exact_mean(F.col("value")).alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    figures = ["mean", "std", "min", "p25", "median", "p75", "max"]
    return moments.join(quartiles, "metric").select(
        "metric", *[round_to(F.col(f), 2).alias(f) for f in figures]
    )


def _score_orders() -> dict[str, Column]:
    """Total orders behind the scores, worst customer first; ties go by spend, then by id."""
    customer = F.col("customer_id").alias("tie")

    def order(first: Column, second: Column) -> Column:
        return F.struct(
            first.cast("double").alias("first"), second.cast("double").alias("second"), customer
        )

    recency, frequency, monetary = (F.col(c) for c in RFM_FEATURES)
    return {
        "r": order(-recency, -monetary),
        "f": order(frequency, -monetary),
        "m": order(monetary, F.lit(0.0)),
    }


def compute_rfm_quintiles(rfm: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add 1-5 scores ``r_score, f_score, m_score``, their text and their sum.

    The bin of a customer follows from its position among all customers. Instead of sorting
    everyone three times, the keys at the four bin borders are located per metric and each row is
    compared with them, so scoring itself needs no shuffle.
    """
    require_columns(rfm, RFM_FEATURES, "RFM scores")
    table = materialize(rfm)
    n = table.count()
    bins = min(5, n)
    if bins < 2:
        scores = {s: F.lit(5) for s in "rfm"}
    else:
        # Position p (from 1) lies in bin ceil((p - 1) * bins / (n - 1)), at least 1.
        borders = [s * (n - 1) // bins + 1 for s in range(1, bins)]
        orders = _score_orders()
        keys = keys_at_ranks(table, orders, {s: borders for s in orders}, n, slice_rows)
        scores = {}
        for name, key in orders.items():
            above = [(key > keys[name][b]).cast("int") for b in borders]
            scores[name] = sum(above, F.lit(1))
    scored = table.select("*", *[scores[s].cast("int").alias(f"{s}_score") for s in "rfm"])
    return as_stored(
        scored.withColumns(
            {
                "rfm_score": F.concat(*[F.col(f"{s}_score").cast("string") for s in "rfm"]),
                "rfm_total": F.col("r_score") + F.col("f_score") + F.col("m_score"),
            }
        )
    )


def rfm_collinearity(rfm: DataFrame) -> DataFrame:
    """One row of Pearson correlations, 0 where undefined."""

    def pearson(x: str, y: str) -> Column:
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        r = F.try_divide(F.covar_pop(x, y), spread)
        return round_to(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)), 4)

    return rfm.agg(
        pearson("recency", "frequency").alias("r_f_corr"),
        pearson("frequency", "monetary").alias("f_m_corr"),
        pearson("recency", "monetary").alias("r_m_corr"),
    )

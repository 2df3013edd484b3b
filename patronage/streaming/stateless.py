"""Operators applied to streams of transactions or of customer metrics.

Cleaning, pseudonymization, formula escaping and scoring look at one row at a time, so they run on
a streaming DataFrame as they do on a static one; copies are dropped within a stated bound of event time. Only
what needs all rows (reports, scores by rank) is left out.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.cleaning import CleaningPolicy, kept_transactions
from patronage.sources.conform import select_canonical


def clean_stream(
    df: DataFrame,
    mapping: dict[str, str | None] | None = None,
    policy: CleaningPolicy = CleaningPolicy(),
    watermark: str | None = None,
) -> DataFrame:
    """Clean transactions of a stream.

    ``policy.remove_duplicates`` needs ``watermark``, such as ``"2 days"``: of equal cleaned rows one stays as long as its
    copies come before the latest date seen has passed theirs by that much. Rows later than that are dropped, and the
    rows remembered are those of the last ``watermark``, whatever the length of the stream.
    """
    if not policy.remove_duplicates:
        return kept_transactions(select_canonical(df, mapping), policy)
    if watermark is None:
        raise ValueError("Duplicates cannot be removed from an unbounded stream without a bound.")
    kept = kept_transactions(select_canonical(df, mapping), replace(policy, remove_duplicates=False))
    # Watermarks need an instant; the wall-clock time stands for one in UTC.
    instant = F.to_timestamp(F.concat(F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    timed = kept.withColumn("_instant", instant).withWatermark("_instant", watermark)
    return timed.dropDuplicatesWithinWatermark(kept.columns).drop("_instant")

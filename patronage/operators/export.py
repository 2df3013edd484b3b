"""Audience files: formula-safe text, readable headers, CRM payload with a control group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.hashing import sha256_percentile
from patronage.functions.text import round_to

# Export headers in output order; the monetary header carries the currency symbol.
EXPORT_HEADERS = {
    "customer_id": "Customer ID",
    "recency": "Recency (Days)",
    "frequency": "Frequency (Orders)",
    "monetary": "Monetary ({currency})",
    "cluster": "Cluster ID",
    "segment": "Customer Segment",
    "first_purchase": "First Purchase Date",
    "last_purchase": "Last Purchase Date",
    "country": "Country",
}
DATE_COLUMNS = ["first_purchase", "last_purchase"]


def escape_formulas(df: DataFrame) -> DataFrame:
    """Put ``'`` before text that a spreadsheet would run as a formula."""

    def safe(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.StringType):
            return value
        risky = value.rlike(r"^[=+\-@\t\r]")
        return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value).alias(field.name)

    return df.select(*[safe(f) for f in df.schema])


def export_table(
    labeled: DataFrame,
    include_dates: bool = True,
    currency_symbol: str = "$",
    sanitize_formulas: bool = True,
) -> DataFrame:
    """Labeled customers under human-readable headers, dates as ``yyyy-MM-dd``."""
    columns = []
    for name, header in EXPORT_HEADERS.items():
        if name not in labeled.columns or (name in DATE_COLUMNS and not include_dates):
            continue
        value = F.date_format(name, "yyyy-MM-dd") if name in DATE_COLUMNS else F.col(name)
        columns.append(value.alias(header.format(currency=currency_symbol)))
    table = labeled.select(*columns)
    return escape_formulas(table) if sanitize_formulas else table


def crm_payload(
    labeled: DataFrame, campaign_salt: str, holdout_percentage: int = 10
) -> DataFrame:
    """CRM schema with a hash-based control group; absent columns take their defaults.

    The control group depends only on customer id and ``campaign_salt``, so it is stable across
    runs; to reproduce an existing split, pass the salt it was made with.
    """
    present = labeled.columns

    def first_present(names: list[str], default):
        return next((F.col(f"`{n}`") for n in names if n in present), F.lit(default))

    if "churn_probability" in present:
        churn = round_to(F.col("churn_probability").cast("double") * 100, 1)
    elif "p_alive" in present:
        churn = round_to((1.0 - F.col("p_alive").cast("double")) * 100, 1)
    else:
        churn = F.lit(0.0)
    customer = F.col("customer_id").cast("string")
    bucket = sha256_percentile(F.concat(customer, F.lit("_" + campaign_salt)))
    return labeled.select(
        customer.alias("customer_id"),
        F.rint(first_present(["recency"], 0).cast("double")).cast("bigint").alias("recency_days"),
        F.rint(first_present(["frequency"], 1).cast("double")).cast("bigint").alias(
            "frequency_orders"
        ),
        round_to(first_present(["monetary"], 0.0).cast("double"), 2).alias("monetary_spend"),
        first_present(["segment", "Customer Segment"], "Unassigned").cast("string").alias(
            "segment_name"
        ),
        first_present(["cluster", "Cluster ID"], 0).cast("int").alias("cluster_id"),
        round_to(first_present(["predicted_clv_6m"], 0.0).cast("double"), 2).alias(
            "predicted_clv_6m"
        ),
        churn.alias("churn_risk_pct"),
        (bucket < holdout_percentage).alias("control_holdout"),
    )

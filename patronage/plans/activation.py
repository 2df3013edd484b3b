"""Lifetime value of labeled customers and the CRM audience made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from patronage.operators.clv import clv_summary, customer_clv, fit_bgnbd, fit_gamma_gamma
from patronage.operators.export import crm_payload
from patronage.session import materialize


def customer_values(transactions: DataFrame, horizon_days: float = 180.0) -> DataFrame:
    """Fit both models on the transactions and score every customer."""
    summary = materialize(clv_summary(transactions))
    return customer_clv(summary, fit_bgnbd(summary), fit_gamma_gamma(summary), horizon_days)


def crm_audience(
    labeled: DataFrame, values: DataFrame, campaign_salt: str, holdout_percentage: int = 10
) -> DataFrame:
    return crm_payload(labeled.join(values, "customer_id", "left"), campaign_salt, holdout_percentage)

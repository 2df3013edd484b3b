"""Raw transactions to labeled customers, cohorts and quality figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.cleaning import CleaningPolicy, clean_transactions
from patronage.operators.clusters import (
    STARTS,
    best_k,
    evaluate_clusters,
    label_by_centers,
    preprocess_rfm,
    run_kmeans,
    z,
)
from patronage.operators.cohorts import cohort_matrix
from patronage.operators.personas import label_segments
from patronage.operators.rfm import calculate_rfm, compute_rfm_quintiles
from patronage.schema import RFM_FEATURES
from patronage.session import materialize


@dataclass(frozen=True)
class Segmentation:
    clean: DataFrame
    report: DataFrame
    evaluation: DataFrame
    best: DataFrame
    labeled: DataFrame
    mapping: DataFrame
    cohorts: DataFrame


def segment_customers(
    raw: DataFrame,
    mapping: dict[str, str | None] | None = None,
    policy: CleaningPolicy | None = None,
    k: int | None = None,
    k_values: list[int] | None = None,
    scaler_type: str = "standard",
    starts: int = STARTS,
    **rfm_options,
) -> Segmentation:
    """The whole analysis; ``k`` defaults to the best silhouette over ``k_values``."""
    clean, report = clean_transactions(raw, mapping, policy=policy)
    clean = materialize(clean)
    rfm = materialize(calculate_rfm(clean, **rfm_options))
    scaled, _ = preprocess_rfm(rfm, scaler_type=scaler_type)
    evaluation = materialize(evaluate_clusters(scaled, k_values, starts=starts))
    best = best_k(evaluation)
    chosen = k or best.first()["best_k"]
    fitted = evaluation.where(F.col("k") == chosen).select("centers").first()
    if fitted is not None and fitted["centers"] is not None:
        clustered = label_by_centers(scaled, [z(f) for f in RFM_FEATURES], fitted["centers"])
    else:
        clustered, _ = run_kmeans(scaled, chosen, starts=starts)
    labeled, personas = label_segments(clustered.drop(*[z(f) for f in RFM_FEATURES]))
    scored = compute_rfm_quintiles(labeled)
    return Segmentation(clean, report, evaluation, best, scored, personas, cohort_matrix(clean))

"""Out-of-time test of a segmentation: fit on the past, judge on what came after."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame

from patronage.operators.backtest import (
    forward_value,
    migration_details,
    retention_summary,
    transition_matrix,
    windowed_rfm,
)
from patronage.operators.clusters import SEED, STARTS, SegmentModel, fit_scaler, run_kmeans, segment_model, z
from patronage.operators.personas import label_segments
from patronage.operators.scoring import score_customers
from patronage.schema import RFM_FEATURES
from patronage.session import materialize

OTHER = "Other"


@dataclass(frozen=True)
class Backtest:
    t1: DataFrame
    t2: DataFrame
    mapping: DataFrame
    model: SegmentModel
    centers: list[list[float]]
    transitions: DataFrame
    retention: DataFrame
    forward: DataFrame
    migration: DataFrame


def backtest_segments(
    df: DataFrame,
    cutoff: datetime | date | str,
    k: int = 4,
    seed: int = SEED,
    starts: int = STARTS,
    centers: list[list[float]] | None = None,
) -> Backtest:
    """Fit on the first window, project that model unchanged onto the second, compare.

    ``centers`` (in the scaled space of the first window) are judged instead of a fit if given."""
    t1_rfm, t2_rfm = (materialize(t) for t in windowed_rfm(df, cutoff))
    scaler = fit_scaler(t1_rfm)
    if centers is None:
        k = min(k, max(2, t1_rfm.count() - 1))
        _, kmeans = run_kmeans(scaler.transform(t1_rfm), k, seed=seed, starts=starts)
        centers = [[float(v) for v in c] for c in kmeans.clusterCenters()]
    model = segment_model(scaler, centers)
    clustered = model.transform(t1_rfm).drop(*[z(f) for f in RFM_FEATURES])
    t1, mapping = label_segments(clustered)
    t1 = materialize(t1)
    t2 = materialize(score_customers(model, mapping, t2_rfm, unknown=OTHER))
    return Backtest(
        t1,
        t2,
        mapping,
        model,
        centers,
        transition_matrix(t1, t2),
        retention_summary(t1, t2),
        forward_value(t1, t2_rfm),
        migration_details(t1, t2),
    )

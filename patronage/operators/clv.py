"""Customer lifetime value: BG/NBD purchase model and Gamma-Gamma spend model."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.order_stats import exact_percentiles
from patronage.functions.special import digamma, ln_gamma, trigamma
from patronage.functions.text import exact, round_to
from patronage.operators.rfm import _as_datetime, _timestamp
from patronage.schema import REQUIRED_COLUMNS, require_columns
from patronage.session import as_stored, materialize

# Start points and bounds of both fits, and the stand-in for too few repeat buyers.
BGNBD_START = (1.0, 10.0, 1.0, 1.0)
BGNBD_BOUNDS = ((1e-4, 50.0), (1e-4, 1000.0), (1e-4, 50.0), (1e-4, 50.0))
GAMMA_GAMMA_START = (1.0, 1.0, 10.0)
GAMMA_GAMMA_BOUNDS = ((1e-3, 50.0), (1e-3, 50.0), (1e-3, 5000.0))
MIN_REPEAT_BUYERS = 10
FEW_BUYERS_P, FEW_BUYERS_Q = 1.5, 3.0
# Slope per customer, by logarithms of the parameters, below which a fit counts as converged.
TOLERANCE = 1e-9


@dataclass(frozen=True)
class BGNBDParameters:
    r: float
    alpha: float
    a: float
    b: float


@dataclass(frozen=True)
class GammaGammaParameters:
    p: float
    q: float
    v: float


def _orders(transactions: DataFrame) -> DataFrame:
    require_columns(transactions, REQUIRED_COLUMNS, "lifetime value")
    return transactions.groupBy(
        F.col("customer_id").cast("string").alias("customer_id"), "invoice_no"
    ).agg(
        F.min("invoice_date").alias("order_date"),
        F.sum(exact(F.col("quantity") * F.col("unit_price"))).alias("_spend"),
    )


def order_rollup(transactions: DataFrame) -> DataFrame:
    """One row per customer and invoice: first date and spend."""
    return _orders(transactions).select(
        "customer_id", "invoice_no", "order_date", F.col("_spend").cast("double").alias("order_spend")
    )


def clv_summary(
    transactions: DataFrame, snapshot_date: datetime | date | str | None = None
) -> DataFrame:
    """Repeat orders, recency and tenure in days, mean repeat spend per customer.

    The snapshot defaults to exactly one day after the last order. The first order is the earliest,
    then the smallest invoice number.
    """
    n, first_value = F.col("total_orders"), F.col("first_spend").cast("double")

    def whole_days(later: Column, earlier: Column) -> Column:
        return F.extract(F.lit("DAY"), later - earlier).cast("double")

    # Stored per customer, so that the last order of all costs no second pass over the orders.
    orders = _orders(transactions).groupBy("customer_id")
    per_customer = orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.min("order_date").alias("first"),
        F.max("order_date").alias("last"),
        F.sum("_spend").alias("all_spend"),
        F.min_by("_spend", F.struct("order_date", "invoice_no")).alias("first_spend"),
    )
    if snapshot_date is None:
        per_customer = materialize(per_customer)
        last = per_customer.agg(F.max("last").cast("timestamp_ntz").alias("d")).first()["d"]
        if last is None:
            raise ValueError("The table is empty: no orders to summarize.")
        snapshot = _timestamp(last) + F.expr("interval 1 day")
    else:
        snapshot = _timestamp(_as_datetime(snapshot_date))
    repeat_spend = (F.col("all_spend") - F.col("first_spend")).cast("double")
    repeat_mean = F.try_divide(repeat_spend, n - 1)
    summary = per_customer.select(
        "customer_id",
        (n - 1).cast("int").alias("frequency_repeat"),
        F.greatest(whole_days(F.col("last"), F.col("first")), F.lit(0.0)).alias("recency_days"),
        F.greatest(whole_days(snapshot, F.col("first")), F.lit(1.0)).alias("tenure_days"),
        F.greatest(F.coalesce(repeat_mean, first_value), F.lit(0.01)).alias("monetary_avg"),
        F.greatest(first_value, F.lit(0.01)).alias("first_order_value"),
        n.cast("int").alias("total_orders"),
    )
    return as_stored(summary) if snapshot_date is None else summary


#: Per row and point: log-likelihood, its slope by each parameter, and its curvature by each pair of them.
Terms = Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _maximize(table: DataFrame, terms: Terms, start: tuple, bounds: tuple, rounds: int = 60) -> np.ndarray | None:
    """Bounded Newton ascent in log parameters with exact slopes and curvatures, one Spark job a round.

    A round scores steps of several dampings and lengths from the point before; the best of them comes with the slopes
    that the next round starts from. None if it does not converge.
    """
    low, high = np.log(np.array(bounds)).T
    at, size = np.log(np.array(start)), len(start)
    (n, value), (slope,), (bend,) = _sums(table, terms, np.exp(at)[None])
    for _ in range(rounds):
        # By logarithms: d/dln(p) = p d/dp.
        scale = np.exp(at)
        gradient, curvature = slope * scale, bend * np.outer(scale, scale) + np.diag(slope * scale)
        free = ~(((at <= low) & (gradient < 0)) | ((at >= high) & (gradient > 0)))
        if not free.any() or np.abs(gradient[free]).max() <= TOLERANCE * n:
            return np.exp(at)
        eigen, basis = np.linalg.eigh(curvature[np.ix_(free, free)])
        largest = max(float(np.abs(eigen).max()), 1e-12)
        steps = []
        for damping in (0.0, 1e-4, 1e-2, 1.0):
            direction = basis @ ((basis.T @ gradient[free]) / (np.maximum(np.abs(eigen), 1e-12 * largest) + damping * largest))
            direction /= max(1.0, float(np.abs(direction).max()))
            for length in (0.3, 1.0, 2.5):
                step = np.zeros(size)
                step[free] = direction * length
                steps.append(np.clip(at + step, low, high))
        values, slopes, bends = _sums(table, terms, np.exp(np.array(steps)))
        scores = np.where(np.isfinite(values[1:]), values[1:], -np.inf)
        winner = int(np.argmax(scores))
        # No step gains more than the rounding of the sum itself.
        settled = not scores[winner] - value > 1e-14 * abs(value)
        if scores[winner] >= value:
            at, value, slope, bend = steps[winner], scores[winner], slopes[winner], bends[winner]
        if settled:
            return np.exp(at)
    return None


def _sums(table: DataFrame, terms: Terms, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over ``table`` weighted by ``w``, in one pass: the weights and the log-likelihood at each point; slopes; curvatures.

    Every task adds up its own rows, so one row per point and task is all that is shuffled.
    """
    many, size = points.shape
    width = 2 + size + size * size

    def add_up(batches):
        totals = np.zeros((many, width))
        for batch in batches:
            for begin in range(0, len(batch), 8192):
                rows = batch.iloc[begin : begin + 8192]
                w = rows["w"].to_numpy()
                with np.errstate(all="ignore"):
                    value, slope, bend = terms(rows, points)
                totals[:, 0] += w.sum()
                totals[:, 1] += w @ np.where(np.isnan(value), -1e6, value)
                totals[:, 2 : 2 + size] += np.einsum("n,nps->ps", w, slope)
                totals[:, 2 + size :] += np.einsum("n,npst->pst", w, bend).reshape(many, -1)
        yield pd.DataFrame({"point": np.arange(many), "sums": list(totals)})

    each = table.mapInPandas(add_up, "point int, sums array<double>").select("point", F.posexplode("sums"))
    out = np.zeros((many, width))
    for row in each.groupBy("point", "pos").agg(F.sum("col").alias("total")).collect():
        out[row["point"], row["pos"]] = row["total"]
    return np.append(out[0, 0], out[:, 1]), out[:, 2 : 2 + size], out[:, 2 + size :].reshape(many, size, size)


def _likelihood(
    table: DataFrame, term: Callable[[pd.DataFrame, np.ndarray], np.ndarray]
) -> Callable[[np.ndarray], np.ndarray]:
    """Sum of ``w * term`` over ``table`` at each of several parameter points, in one pass.

    Every task adds up its own rows, so one number per point and task is all that is shuffled.
    """

    def evaluate(points: np.ndarray) -> np.ndarray:
        def add_up(batches):
            totals = np.zeros(len(points))
            for batch in batches:
                with np.errstate(all="ignore"):
                    value = term(batch, points)
                usable = np.where(np.isnan(value), -1e6, value)
                totals += batch["w"].to_numpy() @ usable
            yield pd.DataFrame({"point": np.arange(len(points)), "total": totals})

        partial = table.mapInPandas(add_up, "point int, total double")
        rows = partial.groupBy("point").agg(F.sum("total").alias("total")).collect()
        found = np.full(len(points), -np.inf)
        for row in rows:
            found[row["point"]] = row["total"]
        return found

    return evaluate


def bgnbd_terms(rows: pd.DataFrame, points: np.ndarray) -> np.ndarray:
    """Log-likelihood of customers (rows ``x, t_x, t``) at points (columns ``r, alpha, a, b``)."""
    x, t_x, t = (rows[c].to_numpy(dtype=float)[:, None] for c in ("x", "t_x", "t"))
    r, alpha, a, b = np.asarray(points, dtype=float).T
    orders = ln_gamma(r + x) - ln_gamma(r) - ln_gamma(x + 1)
    dropout = ln_gamma(b + x) + ln_gamma(a + b) - ln_gamma(a + b + x) - ln_gamma(b)
    timing = r * np.log(alpha / (alpha + t)) - x * np.log(alpha + t)
    ln_odds = np.log(a) - np.log(b + np.maximum(x - 1, 0)) + (r + x) * (np.log(alpha + t) - np.log(alpha + t_x))
    return orders + dropout + timing + np.where(x > 0, np.logaddexp(0.0, ln_odds), 0.0)


def bgnbd_slopes(rows: pd.DataFrame, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`bgnbd_terms` with their slopes and curvatures by ``r, alpha, a, b``."""
    x, t_x, t = (rows[c].to_numpy(dtype=float)[:, None] for c in ("x", "t_x", "t"))
    r, alpha, a, b = np.asarray(points, dtype=float).T
    late, early, before = 1 / (alpha + t), 1 / (alpha + t_x), b + np.maximum(x - 1, 0)
    gap = np.log(alpha + t) - np.log(alpha + t_x)
    slope, bend = np.zeros((*gap.shape, 4)), np.zeros((*gap.shape, 4, 4))
    slope[..., 0] = digamma(r + x) - digamma(r) + np.log(alpha) - np.log(alpha + t)
    slope[..., 1] = r / alpha - (r + x) * late
    slope[..., 2] = digamma(a + b) - digamma(a + b + x)
    slope[..., 3] = slope[..., 2] + digamma(b + x) - digamma(b)
    bend[..., 0, 0] = trigamma(r + x) - trigamma(r)
    bend[..., 0, 1] = bend[..., 1, 0] = 1 / alpha - late
    bend[..., 1, 1] = (r + x) * late**2 - r / alpha**2
    bend[..., 2, 2] = bend[..., 2, 3] = bend[..., 3, 2] = trigamma(a + b) - trigamma(a + b + x)
    bend[..., 3, 3] = bend[..., 2, 2] + trigamma(b + x) - trigamma(b)
    # Odds of having left: ln(1 + q) for buyers who came back, q a product of powers.
    ln_q = np.log(a) - np.log(before) + (r + x) * gap
    share = np.where(x > 0, 1 / (1 + np.exp(-ln_q)), 0.0)
    by = np.stack([gap, (r + x) * (late - early), np.broadcast_to(1 / a, gap.shape), -1 / before], axis=-1)
    twice = np.zeros_like(bend)
    twice[..., 0, 1] = twice[..., 1, 0] = late - early
    twice[..., 1, 1] = (r + x) * (early**2 - late**2)
    twice[..., 2, 2] = -1 / a**2
    twice[..., 3, 3] = 1 / before**2
    slope += share[..., None] * by
    bend += share[..., None, None] * twice + (share * (1 - share))[..., None, None] * by[..., :, None] * by[..., None, :]
    return bgnbd_terms(rows, points), slope, bend


def bgnbd_table(summary: DataFrame) -> DataFrame:
    """Distinct purchase histories with the number of customers that share them."""
    return summary.groupBy(
        F.col("frequency_repeat").cast("double").alias("x"),
        F.col("recency_days").alias("t_x"),
        F.col("tenure_days").alias("t"),
    ).agg(F.count(F.lit(1)).cast("double").alias("w"))


def bgnbd_log_likelihood(summary: DataFrame, points: list[tuple]) -> list[float]:
    """Log-likelihood of the customers at each parameter point ``(r, alpha, a, b)``."""
    return [float(v) for v in _likelihood(bgnbd_table(summary), bgnbd_terms)(np.array(points))]


def _settled(found: np.ndarray | None, start: tuple) -> list[float]:
    if found is None:
        warnings.warn("The fit did not converge; the start values are used.", stacklevel=3)
    return [round(float(v), 4) for v in (start if found is None else found)]


def fit_bgnbd(summary: DataFrame, start: tuple = BGNBD_START) -> BGNBDParameters:
    """Maximum likelihood; the start values if it does not converge."""
    table = materialize(bgnbd_table(summary))
    found = _maximize(table, bgnbd_slopes, start, BGNBD_BOUNDS)
    return BGNBDParameters(*_settled(found, start))


def gamma_gamma_terms(rows: pd.DataFrame, points: np.ndarray) -> np.ndarray:
    """Log-likelihood of repeat buyers (rows ``x, m``) at points (columns ``p, q, v``)."""
    x, m = (rows[c].to_numpy(dtype=float)[:, None] for c in ("x", "m"))
    p, q, v = np.asarray(points, dtype=float).T
    shape = p * x
    return (
        ln_gamma(shape + q) - ln_gamma(shape) - ln_gamma(q)
        + q * np.log(v) + (shape - 1) * np.log(m) + shape * np.log(x)
        - (shape + q) * np.log(x * m + v)
    )


def gamma_gamma_slopes(rows: pd.DataFrame, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`gamma_gamma_terms` with their slopes and curvatures by ``p, q, v``."""
    x, m = (rows[c].to_numpy(dtype=float)[:, None] for c in ("x", "m"))
    p, q, v = np.asarray(points, dtype=float).T
    shape, whole = p * x, 1 / (x * m + v)
    slope, bend = np.zeros((*shape.shape, 3)), np.zeros((*shape.shape, 3, 3))
    slope[..., 0] = x * (digamma(shape + q) - digamma(shape) + np.log(m) + np.log(x) + np.log(whole))
    slope[..., 1] = digamma(shape + q) - digamma(q) + np.log(v) + np.log(whole)
    slope[..., 2] = q / v - (shape + q) * whole
    bend[..., 0, 0] = x**2 * (trigamma(shape + q) - trigamma(shape))
    bend[..., 0, 1] = bend[..., 1, 0] = x * trigamma(shape + q)
    bend[..., 0, 2] = bend[..., 2, 0] = -x * whole
    bend[..., 1, 1] = trigamma(shape + q) - trigamma(q)
    bend[..., 1, 2] = bend[..., 2, 1] = 1 / v - whole
    bend[..., 2, 2] = (shape + q) * whole**2 - q / v**2
    return gamma_gamma_terms(rows, points), slope, bend


def gamma_gamma_table(summary: DataFrame) -> DataFrame:
    """Distinct (repeat orders, mean spend) of repeat buyers with their number."""
    buyers = summary.where(F.col("frequency_repeat") >= 1)
    return buyers.groupBy(
        F.col("frequency_repeat").cast("double").alias("x"), F.col("monetary_avg").alias("m")
    ).agg(F.count(F.lit(1)).cast("double").alias("w"))


def gamma_gamma_log_likelihood(summary: DataFrame, points: list[tuple]) -> list[float]:
    """Log-likelihood of the repeat buyers at each parameter point ``(p, q, v)``."""
    evaluate = _likelihood(gamma_gamma_table(summary), gamma_gamma_terms)
    return [float(v) for v in evaluate(np.array(points))]


def fit_gamma_gamma(summary: DataFrame, start: tuple = GAMMA_GAMMA_START) -> GammaGammaParameters:
    """Maximum likelihood over repeat buyers; fixed shape values if there are too few of them."""
    table = materialize(gamma_gamma_table(summary))
    if (table.agg(F.sum("w").alias("n")).first()["n"] or 0) < MIN_REPEAT_BUYERS:
        mean = summary.agg(F.avg("monetary_avg").alias("m")).first()["m"]
        return GammaGammaParameters(FEW_BUYERS_P, FEW_BUYERS_Q, mean)
    found = _maximize(table, gamma_gamma_slopes, start, GAMMA_GAMMA_BOUNDS)
    return GammaGammaParameters(*_settled(found, start))


def p_alive(params: BGNBDParameters) -> Column:
    """Probability that a customer is still active."""
    x = F.col("frequency_repeat").cast("double")
    growth = (params.alpha + F.col("tenure_days")) / (params.alpha + F.col("recency_days"))
    odds = params.a / (params.b + x) * F.pow(growth, params.r + x)
    alive = F.coalesce(F.nanvl(1.0 / (1.0 + odds), F.lit(0.5)), F.lit(0.5))
    return F.least(F.greatest(alive, F.lit(0.0)), F.lit(1.0))


def expected_orders(params: BGNBDParameters, days: float = 180.0) -> Column:
    """Expected number of orders over the next ``days``."""
    rate = (params.r + F.col("frequency_repeat")) / (params.alpha + F.col("tenure_days"))
    orders = rate * p_alive(params) * days
    return F.greatest(F.coalesce(F.nanvl(orders, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def median_spend(summary: DataFrame) -> float:
    return exact_percentiles(summary, [], "monetary_avg", {"m": 0.5}).first()["m"]


def expected_spend(params: GammaGammaParameters, median: float, kappa: float = 1.0) -> Column:
    """Expected value of the next order; one-time buyers are drawn to the population median."""
    x, m = F.col("frequency_repeat").cast("double"), F.col("monetary_avg")
    p, q, v = params.p, params.q, params.v
    weight = p * x + (q - 1.0)
    divisor = F.when(weight > 0, weight).otherwise(1.0)
    prior = p * v / (q - 1.0 if q > 1.0 else 1.0)
    repeat = (q - 1.0) / divisor * prior + p * x / divisor * m
    once = (m + kappa * median) / (1.0 + kappa)
    spend = F.when(x == 0, once).otherwise(repeat)
    return F.greatest(F.coalesce(F.nanvl(spend, F.lit(median)), F.lit(median)), F.lit(0.01))


def customer_clv(
    summary: DataFrame,
    bgnbd: BGNBDParameters,
    gamma_gamma: GammaGammaParameters,
    horizon_days: float = 180.0,
) -> DataFrame:
    """Activity, churn, expected orders, expected spend and their product per customer."""
    alive = p_alive(bgnbd)
    orders = expected_orders(bgnbd, horizon_days)
    spend = expected_spend(gamma_gamma, median_spend(summary))
    return summary.select(
        "customer_id",
        round_to(alive, 4).alias("p_alive"),
        round_to(1.0 - alive, 4).alias("churn_probability"),
        round_to(orders, 2).alias("expected_transactions_6m"),
        round_to(spend, 2).alias("expected_avg_spend"),
        round_to(orders * spend, 2).alias("predicted_clv_6m"),
    )

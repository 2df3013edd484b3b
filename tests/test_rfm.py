from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from patronage.functions.order_stats import exact_percentiles, value_ranks
from patronage.operators.rfm import (
    calculate_rfm,
    compute_rfm_quintiles,
    default_snapshot_date,
    rfm_collinearity,
    rfm_summary,
)
from tests.conftest import by, one

RFM = "customer_id string, recency bigint, frequency bigint, monetary double"


@pytest.fixture(scope="module")
def clean(transactions):
    return transactions(
        [
            ("A", "101", "2023-01-10", 2, 10, "UK"),
            ("A", "101", "2023-01-10", 1, 5, "UK"),
            ("A", "102", "2023-03-15", 3, 20, "UK"),
            ("B", "103", "2023-01-05", 1, 100, "Germany"),
            ("C", "104", "2023-02-01", 5, 20, "France"),
            ("C", "105", "2023-02-20", 5, 20, "France"),
            ("C", "106", "2023-03-10", 5, 20, "France"),
        ],
        ", country string",
    )


def metrics(rfm):
    return {r["customer_id"]: (r["recency"], r["frequency"], r["monetary"]) for r in rfm.collect()}


def test_metrics(clean):
    assert default_snapshot_date(clean) == dt.datetime(2023, 3, 16)
    expected = {"A": (1, 2, 85.0), "B": (70, 1, 100.0), "C": (6, 3, 300.0)}
    assert metrics(calculate_rfm(clean, "2023-03-16")) == metrics(calculate_rfm(clean)) == expected
    a = by(calculate_rfm(clean), "customer_id")["A"]
    assert (a["first_purchase"], a["last_purchase"], a["country"]) == (
        dt.datetime(2023, 1, 10), dt.datetime(2023, 3, 15), "UK")


def test_days_are_whole_24_hour_periods(transactions):
    rows = [("A", "1", "2023-01-01T14:30:00", 1, 1), ("B", "2", "2023-01-01T00:00:00", 1, 1)]
    assert {k: v[0] for k, v in metrics(calculate_rfm(transactions(rows))).items()} == {"A": 0, "B": 1}


def test_days_do_not_depend_on_the_session_time_zone(spark, transactions):
    rows = [("A", "1", "2023-03-25T12:00:00", 1, 1), ("B", "2", "2023-03-27T00:00:00", 1, 1)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        found = metrics(calculate_rfm(transactions(rows), "2023-03-27 12:00:00"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found["A"][0] == 2


def test_snapshot_before_the_last_date_is_refused(clean):
    with pytest.raises(ValueError, match="after the snapshot"):
        calculate_rfm(clean, "2023-03-01")


def test_lookback_is_inclusive(clean):
    found = metrics(calculate_rfm(clean, "2023-03-16", lookback_days=24))
    assert found == {"A": (1, 1, 60.0), "C": (6, 2, 200.0)}
    with pytest.raises(ValueError, match="lookback"):
        calculate_rfm(clean, "2024-03-16", lookback_days=10)


def test_placeholder_invoices_do_not_count(transactions):
    rows = [("A", "1", "2023-01-01", 1, 50), ("A", "None", "2023-01-02", 1, 9), ("A", "0", "2023-01-02", 1, 9)]
    assert metrics(calculate_rfm(transactions(rows)))["A"][1:] == (1, 50.0)


def test_refunds(transactions):
    rows = [("C1", "101", "2023-01-01", 2, 50), ("C1", "C102", "2023-01-10", -1, 30),
            ("C2", "103", "2023-01-05", 1, 20), ("C2", "C104", "2023-01-06", -1, 50)]
    found = metrics(calculate_rfm(transactions(rows), "2023-01-15"))
    assert found == {"C1": (14, 1, 70.0), "C2": (10, 1, 0.0)}


def test_only_refunds_anywhere_counts_all_invoices(transactions):
    rows = [("A", "C1", "2023-01-01", -1, 5), ("A", "C2", "2023-01-02", -1, 5)]
    assert metrics(calculate_rfm(transactions(rows)))["A"] == (1, 2, 0.0)


def test_refund_only_customer_next_to_buyers_has_frequency_one(transactions):
    rows = [("A", "C1", "2023-01-01", -1, 5), ("A", "C2", "2023-01-02", -1, 5), ("B", "3", "2023-01-02", 1, 5)]
    assert metrics(calculate_rfm(transactions(rows)))["A"][1] == 1


def test_average_spend(transactions):
    rows = [("C1", "1", "2023-01-01", 2, 10), ("C1", "2", "2023-01-02", 3, 20)]
    assert metrics(calculate_rfm(transactions(rows), use_average_monetary=True))["C1"][1:] == (2, 40.0)


def test_country_ties_and_gaps(transactions):
    rows = [("A", "1", "2023-01-01", 1, 1, "UK"), ("A", "2", "2023-01-01", 1, 1, "France"),
            ("B", "3", "2023-01-01", 1, 1, None)]
    found = by(calculate_rfm(transactions(rows, ", country string")), "customer_id")
    assert (found["A"]["country"], found["B"]["country"]) == ("France", "Unknown")


def test_errors(transactions):
    with pytest.raises(ValueError, match="empty"):
        calculate_rfm(transactions([]))
    with pytest.raises(ValueError, match="unit_price"):
        calculate_rfm(transactions([]).drop("unit_price"))


def test_summary(spark):
    rows = [("a", 1, 1, 10.0), ("b", 2, 1, 20.0), ("c", 3, 1, 30.0), ("d", 10, 1, 45.5)]
    found = by(rfm_summary(spark.createDataFrame(rows, RFM)), "metric")
    assert found["recency"] == {"metric": "recency", "mean": 4.0, "std": 4.08, "min": 1.0, "p25": 1.75,
                                "median": 2.5, "p75": 4.75, "max": 10.0}
    assert found["frequency"]["std"] == 0.0
    single = by(rfm_summary(spark.createDataFrame(rows[:1], RFM)), "metric")
    assert single["monetary"]["std"] == 0.0 and single["monetary"]["p75"] == 10.0


def test_quintiles(spark):
    rows = [(str(i), *v) for i, v in enumerate(
        [(2, 10, 1000.0), (10, 5, 500.0), (30, 3, 200.0), (60, 2, 100.0), (120, 1, 20.0)])]
    found = by(compute_rfm_quintiles(spark.createDataFrame(rows, RFM)), "customer_id")
    assert (found["0"]["rfm_score"], found["0"]["rfm_total"]) == ("555", 15)
    assert (found["4"]["rfm_score"], found["4"]["rfm_total"]) == ("111", 3)


def test_quintile_edge_sizes(spark):
    one_row = one(compute_rfm_quintiles(spark.createDataFrame([("a", 1, 1, 1.0)], RFM)))
    assert (one_row["rfm_score"], one_row["rfm_total"], one_row["r_score"]) == ("555", 15, 5)
    empty = compute_rfm_quintiles(spark.createDataFrame([], RFM))
    assert empty.count() == 0 and set(empty.columns) >= {"r_score", "f_score", "m_score", "rfm_score", "rfm_total"}
    with pytest.raises(ValueError, match="monetary"):
        compute_rfm_quintiles(spark.createDataFrame([("a", 1)], "customer_id string, recency bigint"))
    sizes = spark.createDataFrame([(str(i), i, 1, float(i)) for i in range(7)], RFM)
    groups = sorted(r["count"] for r in compute_rfm_quintiles(sizes).groupBy("m_score").count().collect())
    assert groups == [1, 1, 1, 2, 2]


def expected_scores(rows):
    """Rank in pandas-like first-come order over rows sorted by spend, then id; equal-width bins."""
    rows = sorted(rows, key=lambda r: (-r[3], r[0]))
    n, bins = len(rows), min(5, len(rows))

    def score(order):
        place = {row[0]: i for i, row in enumerate(order)}
        return {k: max(1, -(-p * bins // (n - 1))) for k, p in place.items()}

    r = score(sorted(rows, key=lambda x: -x[1]))
    f = score(sorted(rows, key=lambda x: x[2]))
    m = score(sorted(rows, key=lambda x: (x[3], x[0])))
    return {k: (r[k], f[k], m[k]) for k in r}


@pytest.mark.parametrize("n, slice_rows", [(2, 10), (13, 10**6), (400, 3), (1999, 40), (1999, 700)])
def test_scores_equal_ranking_with_and_without_pivots(spark, n, slice_rows):
    rng = random.Random(n)
    # A third of the customers share one value of everything.
    rows = [(f"{i:05d}", *((7, 1, 9.99) if i % 3 == 0 else
             (rng.randrange(30), rng.randrange(1, 4), rng.randrange(5000) / 100))) for i in range(n)]
    scored = compute_rfm_quintiles(spark.createDataFrame(rows, RFM), slice_rows)
    found = {r["customer_id"]: (r["r_score"], r["f_score"], r["m_score"]) for r in scored.collect()}
    assert found == expected_scores(rows)


def test_percentiles_equal_the_built_in(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), rng.choice([0.0, 1.0, rng.expovariate(0.001), -rng.random() * 50]))
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.995, "e": 1.0}
    ours = by(exact_percentiles(df, ["g"], "v", probs), "g")
    built_in = by(df.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()]), "g")
    for group, row in built_in.items():
        assert ours[group] == pytest.approx(row)


def test_value_ranks_count_below_and_up_to(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (2.0,), (None,)], "v double")
    found = {r["v"]: (r["n"], r["n_below"], r["n_upto"], r["total"]) for r in value_ranks(df, [], "v").collect()}
    assert found == {1.0: (2, 0, 2, 4), 2.0: (1, 2, 3, 4), 3.0: (1, 3, 4, 4)}


def test_collinearity(spark):
    rows = [("a", 1, 1, 10.0), ("b", 2, 2, 20.0), ("c", 3, 3, 30.0)]
    found = one(rfm_collinearity(spark.createDataFrame(rows, RFM)))
    assert found == {"r_f_corr": 1.0, "f_m_corr": 1.0, "r_m_corr": 1.0}
    flat = one(rfm_collinearity(spark.createDataFrame([("a", 1, 1, 1.0), ("b", 1, 2, 2.0)], RFM)))
    assert (flat["r_f_corr"], flat["f_m_corr"]) == (0.0, 1.0)


def test_better_customer_never_scores_lower(spark, sf):
    from catalog.inputs import scored

    table = scored(spark, sf).cache()
    worse = table.alias("a").join(
        table.alias("b"), F.expr("a.monetary > b.monetary and a.m_score < b.m_score"))
    assert worse.isEmpty()


@pytest.mark.parametrize("count", [1, 2, 7, 8, 255])
def test_edges_below_a_key_are_found_by_halving(spark, count):
    """F4, F5, F7, F8, F10, F11: the place among the cut points of a table, without a look at each of them."""
    from bisect import bisect_left

    from pyspark.sql import functions as F

    from patronage.functions.order_stats import _edges_below

    edges = [2 * i for i in range(count)]
    below = _edges_below(F.array(*map(F.lit, edges)), count, F.col("id").cast("int"))
    found = spark.range(-1, 2 * count + 2).select(F.col("id"), below.alias("n")).collect()
    assert [row["n"] for row in found] == [bisect_left(edges, row["id"]) for row in found]

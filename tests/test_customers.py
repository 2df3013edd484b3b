from __future__ import annotations

import hashlib
import hmac
import math
from dataclasses import astuple

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patronage.functions.special import ln_gamma
from patronage.operators import clv, cohorts, export, governance, reports
from patronage.schema import RFM_FEATURES
from tests.conftest import by, one

SUMMARY = "customer_id string, frequency_repeat int, recency_days double, tenure_days double, monetary_avg double"
PARAMS = clv.BGNBDParameters(0.8, 15.0, 0.5, 1.2)
SPEND = clv.GammaGammaParameters(2.0, 4.0, 100.0)


def visits(spark, rows):
    df = spark.createDataFrame(rows, "customer_id string, d string")
    return df.select("customer_id", F.col("d").cast("timestamp_ntz").alias("invoice_date"))


def test_cohorts(spark):
    df = visits(spark, [("C1", "2023-01-10"), ("C1", "2023-02-15"), ("C1", "2023-03-20"), ("C2", "2023-01-20"),
                        ("C2", "2023-02-10"), ("C3", "2023-02-05"), ("C3", "2023-03-01"), ("C4", "2023-02-18")])
    matrix = cohorts.cohort_matrix(df)
    cells = {(r["cohort_month"], r["cohort_index"]): (r["customers"], r["retention_pct"]) for r in matrix.collect()}
    assert cells == {
        ("2023-01", 0): (2, 100.0), ("2023-01", 1): (2, 100.0), ("2023-01", 2): (1, 50.0),
        ("2023-02", 0): (2, 100.0), ("2023-02", 1): (1, 50.0), ("2023-02", 2): (None, None),
    }
    assert one(cohorts.cohort_summary(matrix)) == {
        "total_cohorts": 2, "avg_m1_retention": 75.0, "avg_m3_retention": 0.0, "avg_m6_retention": 0.0}
    wide = by(cohorts.pivot_cohorts(matrix), "cohort_month")
    assert wide["2023-01"]["2"] == 50.0 and wide["2023-02"]["2"] is None


def test_quiet_months_are_null_not_zero(spark):
    matrix = cohorts.cohort_matrix(visits(spark, [("C1", "2023-01-10"), ("C1", "2023-04-15")]))
    assert [r["retention_pct"] for r in matrix.orderBy("cohort_index").collect()] == [100.0, None, None, 100.0]


def test_clv_summary(transactions):
    df = transactions([("C1", "INV1", "2026-01-01", 1, 50), ("C1", "INV2", "2026-01-31", 2, 50),
                       ("C2", "INV3", "2026-01-11", 1, 100)])
    found = by(clv.clv_summary(df), "customer_id")
    assert (found["C1"]["frequency_repeat"], found["C1"]["recency_days"], found["C1"]["tenure_days"]) == (1, 30.0, 31.0)
    assert (found["C1"]["monetary_avg"], found["C1"]["first_order_value"]) == (100.0, 50.0)
    assert (found["C2"]["frequency_repeat"], found["C2"]["recency_days"], found["C2"]["monetary_avg"]) == (0, 0.0, 100.0)
    later = by(clv.clv_summary(df, "2026-03-01"), "customer_id")
    assert later["C1"]["tenure_days"] == 59.0


def test_clv_floors(transactions):
    df = transactions([("C1", "1", "2026-01-01", -1, 50), ("C1", "2", "2026-01-01", -1, 50)])
    row = one(clv.clv_summary(df))
    assert (row["monetary_avg"], row["first_order_value"], row["tenure_days"], row["recency_days"]) == (0.01, 0.01, 1.0, 0.0)


def test_recent_buyers_are_more_alive(spark):
    df = spark.createDataFrame([("a", 5, 150.0, 160.0, 100.0), ("b", 5, 10.0, 160.0, 100.0)], SUMMARY)
    found = by(clv.customer_clv(df, PARAMS, SPEND), "customer_id")
    assert found["a"]["p_alive"] > found["b"]["p_alive"]
    assert found["a"]["expected_transactions_6m"] > found["b"]["expected_transactions_6m"]
    assert found["a"]["p_alive"] + found["a"]["churn_probability"] == pytest.approx(1.0)


def test_one_time_buyers_are_drawn_to_the_middle(spark):
    rows = [("x", 3, 50.0, 100.0, 200.0), ("y", 4, 60.0, 100.0, 220.0), ("low", 0, 0.0, 100.0, 10.0),
            ("high", 0, 0.0, 100.0, 1000.0)]
    df = spark.createDataFrame(rows, SUMMARY)
    spend = clv.expected_spend(SPEND, clv.median_spend(df))
    found = {r["customer_id"]: r["s"] for r in df.select("customer_id", spend.alias("s")).collect()}
    assert found["low"] == pytest.approx((10 + 210) / 2) and found["high"] == pytest.approx((1000 + 210) / 2)


def test_fixed_parameters_value_repeat_buyers(spark):
    df = spark.createDataFrame([("a", 2, 30.0, 60.0, 150.0), ("b", 0, 0.0, 60.0, 50.0)], SUMMARY)
    row = by(clv.customer_clv(df, PARAMS, SPEND), "customer_id")["a"]
    odds = 0.5 / 3.2 * ((15 + 60) / (15 + 30)) ** 2.8
    alive = 1 / (1 + odds)
    orders = 2.8 / 75 * alive * 180
    spend = 3 / 7 * (2 * 100 / 3) + 4 / 7 * 150
    assert row["p_alive"] == pytest.approx(alive, abs=1e-4)
    assert row["predicted_clv_6m"] == pytest.approx(orders * spend, abs=0.01)


def test_log_gamma():
    import numpy as np

    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 10.0, 171.3, 5e4])
    assert ln_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)


def simulated(spark, n=1500, seed=7):
    """Customers whose purchases follow the model, for parameters that are known."""
    import numpy as np

    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rate, p = rng.gamma(1.5, 1 / 30.0), rng.beta(1.2, 3.0)
        age, t, x, last = float(rng.integers(200, 400)), 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / rate)
            if t > age:
                break
            x, last = x + 1, t
            if rng.random() < p:
                break
        scale = rng.gamma(4.0, 1 / 100.0)
        mean = rng.gamma(3.0 * max(x, 1), 1 / scale) / max(x, 1)
        rows.append((str(i), x, float(math.floor(last)), age, float(mean)))
    return spark.createDataFrame(rows, SUMMARY)


def test_fits_beat_start_and_neighbours(spark):
    df = simulated(spark)
    fitted = clv.fit_bgnbd(df)
    at = (fitted.r, fitted.alpha, fitted.a, fitted.b)
    near = [tuple(v * (1.05 if j == i else 1) for j, v in enumerate(at)) for i in range(4)]
    near += [tuple(v * (0.95 if j == i else 1) for j, v in enumerate(at)) for i in range(4)]
    scores = clv.bgnbd_log_likelihood(df, [at, clv.BGNBD_START, *near])
    assert scores[0] > scores[1] and scores[0] >= max(scores[2:]) - 1e-3
    assert 0.8 < fitted.r < 2.5 and 15 < fitted.alpha < 60

    spend = clv.fit_gamma_gamma(df)
    at = (spend.p, spend.q, spend.v)
    near = [tuple(v * (s if j == i else 1) for j, v in enumerate(at)) for i in range(3) for s in (0.95, 1.05)]
    scores = clv.gamma_gamma_log_likelihood(df, [at, clv.GAMMA_GAMMA_START, *near])
    assert scores[0] > scores[1] and scores[0] >= max(scores[2:]) - 1e-3


def test_slopes_and_curvatures_are_derivatives():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, 40).astype(float)
    t_x = np.where(x > 0, rng.integers(0, 200, 40), 0).astype(float)
    rows = pd.DataFrame({"x": x, "t_x": t_x, "t": t_x + rng.integers(1, 100, 40)})
    spend = pd.DataFrame({"x": np.maximum(x, 1), "m": rng.gamma(3, 20, 40)})
    for table, terms, slopes, at in (
        (rows, clv.bgnbd_terms, clv.bgnbd_slopes, [[1.3, 20, 0.7, 2.5], [0.2, 5, 0.1, 0.3], [4, 900, 0.001, 40]]),
        (spend, clv.gamma_gamma_terms, clv.gamma_gamma_slopes, [[1.3, 2, 30.0], [5, 0.4, 3], [40, 2.2, 4000]]),
    ):
        at = np.array(at, float)
        value, slope, bend = slopes(table, at)
        assert np.array_equal(value, terms(table, at))
        for i in range(at.shape[1]):
            step = np.zeros_like(at)
            step[:, i] = 1e-5 * at[:, i]
            width = 2 * step[:, i][None, :]
            assert slope[..., i] == pytest.approx((terms(table, at + step) - terms(table, at - step)) / width, rel=1e-4, abs=2e-5)
            change = (slopes(table, at + step)[1] - slopes(table, at - step)[1]) / width[..., None]
            assert bend[..., i, :] == pytest.approx(change, rel=1e-4, abs=2e-5)


def test_fits_are_flat_at_the_top(spark):
    """Slopes at the fitted points vanish in every direction that is not held by a bound."""
    df = simulated(spark)
    for table, slopes, found, bounds in (
        (clv.bgnbd_table(df), clv.bgnbd_slopes, astuple(clv.fit_bgnbd(df)), clv.BGNBD_BOUNDS),
        (clv.gamma_gamma_table(df), clv.gamma_gamma_slopes, astuple(clv.fit_gamma_gamma(df)), clv.GAMMA_GAMMA_BOUNDS),
    ):
        rows = table.toPandas()
        at = np.array([found])
        slope = np.einsum("n,nps->s", rows["w"].to_numpy(), slopes(rows, at)[1]) * at[0] / rows["w"].sum()
        for value, (low, high), s in zip(found, bounds, slope):
            assert abs(s) < 1e-3 or (value == low and s < 0) or (value == high and s > 0)


def test_too_few_repeat_buyers(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0, 10.0), ("b", 0, 0.0, 2.0, 30.0)], SUMMARY)
    assert clv.fit_gamma_gamma(df) == clv.GammaGammaParameters(1.5, 3.0, 20.0)


def test_pseudonyms_equal_hmac(spark):
    for salt in ("salt", "long " * 30, "ü"):
        df = spark.createDataFrame([("12345",), (" 67890 ",), ("12345",), (None,), ("é",)], "customer_id string")
        found = [r["customer_id"] for r in governance.pseudonymize_customer_ids(df, salt).collect()]
        digest = lambda x: "usr_" + hmac.new(salt.encode(), x.encode(), hashlib.sha256).hexdigest()[:16]
        assert found == [digest("12345"), digest("67890"), digest("12345"), None, digest("é")]
    with pytest.raises(ValueError):
        governance.pseudonymize_customer_ids(df, "s", "other")


def clustered(spark):
    rows = [("C1", 10.0, 2.0, 100.0, 0), ("C2", 20.0, 4.0, 200.0, 0), ("C3", 30.0, 6.0, 300.0, 0), ("C4", 1.0, 1.0, 1.0, 1)]
    return spark.createDataFrame(rows, "customer_id string, recency double, frequency double, monetary double, cluster int")


def test_erasure(spark):
    df = clustered(spark)
    centers = df.groupBy("cluster").agg(*[F.avg(f).alias(f) for f in RFM_FEATURES])
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "customer_id string")
    rest, moved = governance.erase_customers(df, ids(" C3 "), centers)
    found = by(moved, "cluster")
    assert rest.count() == 3 and [found[0][f] for f in RFM_FEATURES] == [15.0, 3.0, 150.0]
    assert found[0]["affected"] and not found[1]["affected"] and found[1]["monetary"] == 1.0
    emptied = by(governance.erase_customers(df, ids("C4", "C1", "C2"), centers)[1], "cluster")
    assert [emptied[1][f] for f in RFM_FEATURES] == [0.0, 0.0, 0.0]
    assert [emptied[0][f] for f in RFM_FEATURES] == [30.0, 6.0, 300.0]
    with pytest.raises(KeyError, match="nobody"):
        governance.erase_customers(df, ids("nobody"), centers)


def test_formulas_are_escaped(spark):
    cells = ["=SUM(1,1)", "@AdminPersona", "+United States", "-1", "\tx", "\rx", "plain", "", None, "a=b"]
    df = spark.createDataFrame([(c, 1) for c in cells], "t string, n int")
    found = [r["t"] for r in export.escape_formulas(df).collect()]
    assert found == ["'" + c for c in cells[:6]] + cells[6:]


def test_export_headers(spark):
    df = spark.createDataFrame([("=1", 5, 2, 10.5, 0, "Champions")],
                               "customer_id string, recency int, frequency int, monetary double, cluster int, segment string")
    dated = df.withColumn("first_purchase", F.lit("2023-01-02 10:00:00").cast("timestamp_ntz"))
    table = export.export_table(dated, currency_symbol="€")
    assert table.columns == ["Customer ID", "Recency (Days)", "Frequency (Orders)", "Monetary (€)", "Cluster ID",
                             "Customer Segment", "First Purchase Date"]
    assert one(table)["Customer ID"] == "'=1" and one(table)["First Purchase Date"] == "2023-01-02"
    assert "First Purchase Date" not in export.export_table(dated, include_dates=False).columns


def test_crm_payload(spark):
    ids = [f"CUST_{i}" for i in range(100)]
    df = spark.createDataFrame([(i, 2.5, 3.5, 0.2) for i in ids],
                               "customer_id string, recency double, frequency double, p_alive double")
    rows = by(export.crm_payload(df, "v1"), "customer_id")
    held = {i for i in ids if int(hashlib.sha256(f"{i}_v1".encode()).hexdigest(), 16) % 100 < 10}
    assert {i for i, r in rows.items() if r["control_holdout"]} == held and 5 <= len(held) <= 20
    row = rows["CUST_0"]
    assert (row["recency_days"], row["frequency_orders"], row["churn_risk_pct"]) == (2, 4, 80.0)
    assert (row["segment_name"], row["cluster_id"], row["monetary_spend"], row["predicted_clv_6m"]) == ("Unassigned", 0, 0.0, 0.0)


LABELED = "customer_id string, recency bigint, frequency bigint, monetary double, segment string, country string"


@pytest.fixture(scope="module")
def labeled(spark):
    return spark.createDataFrame(
        [("1", 1, 9, 100.0, "Champions", "UK"), ("2", 10, 5, 50.0, "Champions", "FR"),
         ("3", 100, 1, 10.0, "At Risk", "UK"), ("4", 100, 1, 40.0, "At Risk", "UK")], LABELED)


def test_filters(labeled):
    count = lambda *a: reports.filter_customers(labeled, *a).count()
    assert count([]) == 0 and count(["Champions", "At Risk"], []) == 4
    assert count(["Champions"], ["UK"]) == 1 and count(["At Risk"], None, (10.0, 39.9)) == 1


def test_figures(labeled):
    assert one(reports.overview_kpis(labeled)) == {"customers": 4, "revenue": 200.0, "avg_spend": 50.0, "segments": 2}
    play = by(reports.segment_playbook(labeled), "segment")
    assert (play["Champions"]["revenue_pct"], play["At Risk"]["customer_pct"], play["At Risk"]["avg_monetary"]) == (75.0, 50.0, 25.0)
    assert by(reports.segment_customers(labeled), "segment")["At Risk"]["percentage"] == 50.0
    assert by(reports.segment_revenue(labeled), "segment")["At Risk"]["percentage"] == 25.0
    radar = by(reports.segment_radar(labeled), "segment")
    assert (radar["At Risk"]["recency_score"], radar["Champions"]["monetary_score"]) == (0.0, 75.0)


def test_percentile_position_of_customers(labeled):
    found = by(reports.customer_percentiles(labeled), "customer_id")
    assert [found[c]["recency_pct"] for c in "1234"] == [100.0, 75.0, 50.0, 50.0]
    assert [found[c]["frequency_pct"] for c in "1234"] == [100.0, 75.0, 50.0, 50.0]
    assert [found[c]["monetary_pct"] for c in "1234"] == [100.0, 75.0, 25.0, 50.0]


def test_histograms_count_everyone(labeled):
    bars = reports.rfm_histograms(labeled, {"recency": 3, "monetary": 2})
    totals = {r["metric"]: r["n"] for r in bars.groupBy("metric").agg(F.sum("n").alias("n")).collect()}
    assert totals == {"recency": 4, "monetary": 4} and bars.count() == 5
    flat = reports.rfm_histograms(labeled.where("segment = 'At Risk'"), {"recency": 30})
    assert [(r["bin"], r["n"]) for r in flat.collect()] == [(0, 2)]


def test_top_scores_and_separation(spark):
    scored = spark.createDataFrame([("555",)] * 3 + [("111",)] * 3 + [("123",)], "rfm_score string")
    top = reports.top_scores(scored, 2).collect()
    assert [(r["rfm_score"], r["customer_count"], r["pct_of_base"]) for r in top] == [("111", 3, 42.9), ("555", 3, 42.9)]
    table = spark.createDataFrame([(2, 0.6), (3, 0.35), (4, 0.2), (5, 0.1)], "k int, silhouette double")
    verdicts = [r["separation"] for r in reports.separation_report(table).orderBy("k").collect()]
    assert verdicts == ["strong", "moderate", "weak", "poor"]


def test_chart_columns(labeled):
    row = one(reports.chart_columns(labeled.limit(1).withColumn("predicted_clv_6m", F.lit(1e6))))
    assert (row["log_monetary"], row["clv_marker_size"]) == (2.0, 20.0)


def test_timeline(transactions):
    df = transactions([("1", "10", "2023-01-02", 2, 5, "a"), ("1", "10", "2023-01-02", 1, 1.5, "a"),
                       ("1", "9", "2023-01-01", 1, 1, "b"), ("2", "8", "2023-01-01", 1, 1, "b")], ", description string")
    rows = reports.customer_timeline(df, "1").collect()
    assert [(r["invoice_no"], r["order_total"], r["item_count"], r["distinct_products"]) for r in rows] == [
        ("9", 1.0, 1.0, 1), ("10", 11.5, 3.0, 1)]
    plain = reports.customer_timeline(df.drop("description"), "1").collect()
    assert plain[1]["distinct_products"] == 2
    assert [r["invoice_no"] for r in reports.customer_lines(df, " 1 ").collect()] == ["10", "10", "9"]


def test_lookup_reads_one_bucket(spark, tmp_path):
    lines = spark.range(3000).selectExpr(
        "cast(if(id % 3 = 0, 1, id % 97) as string) AS customer_id", "cast(id as string) AS invoice_no",
        "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) AS invoice_date",
    )
    name = "lookup_lines"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    reports.store_by_customer(lines, name, str(tmp_path / "t"), buckets=16)
    try:
        found = reports.stored_lines(spark, name, " 1 ")
        # The plan names the buckets only where it keeps their order; files of other buckets are left out either way.
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        shown = reports.stored_lines(spark, name, "1")._jdf.queryExecution().toString()
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert "SelectedBucketsCount: 1 out of 16" in shown
        assert [r["invoice_no"] for r in found.collect()] == [
            r["invoice_no"] for r in reports.customer_lines(lines, "1").collect()]
        assert spark.table(name).count() == 3000
        hot = spark.table(name).where("customer_id = '1'").selectExpr("_metadata.file_name AS f").distinct().count()
        assert 1 < hot <= reports.FILES_PER_BUCKET
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")

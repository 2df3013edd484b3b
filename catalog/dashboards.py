"""Reporting queries (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.customers import ACTIVITY, ALIVE, BGNBD, COHORTS, GAMMA_GAMMA, SUMMARY, summary
from catalog.inputs import (
    CLUSTERS,
    GROSS,
    LABELS,
    LABELS_COUNTRY,
    RFM,
    SCORED,
    TX,
    gross,
    labeled,
    mean,
    r,
    rfm,
    scored,
    scratch,
    sql,
)
from catalog.registry import query
from catalog.segments import (
    DETAILS,
    PERSONA_TABLE,
    TOTAL_SQUARE,
    TRANSITIONS,
    checked_evaluation,
    scaled_cte,
    score_evaluation,
    score_evaluation_cte,
    window_labels,
    windows,
)
from patronage.functions.text import round_to
from patronage.operators import backtest, clv, cohorts, reports
from patronage.session import materialize


@query(
    "D1_filter",
    sql(
        *LABELS_COUNTRY,
        """SELECT * FROM labeled WHERE segment IN ('Champions', 'At Risk', 'Lost / Dormant')
        AND country IN ('NATION_1', 'NATION_2', 'NATION_3') AND monetary BETWEEN 500000 AND 2000000""",
    ),
)
def d1(spark, d):
    return reports.filter_customers(
        labeled(spark, d, country=True),
        ["Champions", "At Risk", "Lost / Dormant"],
        ["NATION_1", "NATION_2", "NATION_3"],
        (500000.0, 2000000.0),
    )


@query(
    "D2_kpis",
    sql(
        *LABELS,
        f"""SELECT count(*) AS customers, {r('sum(monetary)', 2)} AS revenue, {r(mean('monetary'), 2)} AS avg_spend,
        count(DISTINCT segment) AS segments FROM labeled""",
    ),
)
def d2(spark, d):
    return reports.overview_kpis(labeled(spark, d))


EXACT_SUM = "CAST(sum(CAST(monetary AS DECIMAL(18, 2))) AS DOUBLE)"
SHARE = f"{r(f'{EXACT_SUM} / sum({EXACT_SUM}) OVER () * 100', 1)}"
HEADS = f"{r('count(*) / sum(count(*)) OVER () * 100', 1)}"


@query(
    "D3_playbook",
    sql(
        *LABELS,
        f"""figures AS (SELECT segment, count(*) AS customers, {HEADS} AS customer_pct, {r('sum(monetary)', 2)} AS revenue,
        {SHARE} AS revenue_pct, {r('avg(recency)', 2)} AS avg_recency, {r('avg(frequency)', 2)} AS avg_frequency,
        {r(mean('monetary'), 2)} AS avg_monetary FROM labeled GROUP BY segment)""",
        PERSONA_TABLE, DETAILS.format(source="figures"), "SELECT * FROM detailed",
    ),
)
def d3(spark, d):
    return reports.segment_playbook(labeled(spark, d))


@query(
    "D4_segment_customers",
    sql(
        *LABELS,
        f"SELECT segment, count(*) AS customer_count, {HEADS} AS percentage FROM labeled GROUP BY segment",
    ),
)
def d4(spark, d):
    return reports.segment_customers(labeled(spark, d))


@query(
    "D5_segment_revenue",
    sql(
        *LABELS,
        f"SELECT segment, {EXACT_SUM} AS revenue, {SHARE} AS percentage FROM labeled GROUP BY segment",
    ),
)
def d5(spark, d):
    return reports.segment_revenue(labeled(spark, d))


@query(
    "D6_segment_shares",
    sql(
        *LABELS,
        f"""SELECT segment, count(*) AS customers, {r('sum(monetary)', 2)} AS revenue, {r('avg(recency)', 6)} AS avg_recency,
        {r('avg(frequency)', 6)} AS avg_frequency, {r(mean('monetary'), 2)} AS avg_spend_per_cust
        FROM labeled GROUP BY segment""",
    ),
)
def d6(spark, d):
    shares = reports.segment_shares(labeled(spark, d))
    return shares.withColumns(
        {c: round_to(F.col(c), 6) for c in ("avg_recency", "avg_frequency")}
    )


@query(
    "D7_chart_columns",
    sql(
        *RFM, SUMMARY.format(source="gross"), ALIVE,
        f"valued2 AS (SELECT customer_id, {r('orders * spend', 2)} AS predicted_clv_6m FROM valued)",
        f"""SELECT customer_id, greatest(monetary, 0.01) AS monetary_floor,
        {r('log10(greatest(monetary, 1))', 6)} AS log_monetary,
        {r('least(greatest(sqrt(greatest(predicted_clv_6m, 1)), 3), 20)', 6)} AS clv_marker_size
        FROM rfm JOIN valued2 USING (customer_id)""",
    ),
)
def d7(spark, d):
    values = clv.customer_clv(materialize(summary(spark, d)), BGNBD, GAMMA_GAMMA)
    charted = reports.chart_columns(rfm(spark, d).join(values, "customer_id"))
    return charted.select(
        "customer_id",
        "monetary_floor",
        *[round_to(F.col(c), 6).alias(c) for c in ("log_monetary", "clv_marker_size")],
    )


def histogram_sql(metric: str, bins: int) -> str:
    return f"""SELECT '{metric}' AS metric, b.bin, {r(f'lo + b.bin * w', 4)} AS lower,
      {r(f'lo + b.bin * w + w', 4)} AS upper, (SELECT count(*) FROM rfm
        WHERE least(CAST(floor(({metric} - lo) / w) AS INTEGER), {bins - 1}) = b.bin) AS n
      FROM (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin) b,
      (SELECT CAST(min({metric}) AS DOUBLE) AS lo,
        (CAST(max({metric}) AS DOUBLE) - min({metric})) / {bins} AS w FROM rfm) e"""


@query(
    "D8_histograms",
    sql(
        *RFM,
        " UNION ALL ".join(histogram_sql(m, n) for m, n in reports.HISTOGRAM_BINS.items()),
    ),
)
def d8(spark, d):
    bars = reports.rfm_histograms(materialize(rfm(spark, d)))
    return bars.withColumns({c: round_to(F.col(c), 4) for c in ("lower", "upper")})


def _median(metric: str) -> str:
    share = f"quantile_cont(CAST({metric} AS DOUBLE), 0.5) / (SELECT max({metric}) FROM labeled) * 100"
    return f"greatest(100 - {share}, 0)" if metric == "recency" else f"least({share}, 100)"


@query(
    "D9_radar",
    sql(
        *LABELS,
        "SELECT segment, "
        + ", ".join(f"{r(_median(m), 6)} AS {m}_score" for m in ("recency", "frequency", "monetary"))
        + " FROM labeled GROUP BY segment",
    ),
)
def d9(spark, d):
    radar = reports.segment_radar(labeled(spark, d))
    names = [f"{m}_score" for m in ("recency", "frequency", "monetary")]
    return radar.select("segment", *[round_to(F.col(c), 6).alias(c) for c in names])


@query(
    "D10_mean_scores",
    sql(
        *SCORED,
        f"""SELECT {r('avg(r_score)', 2)} AS avg_r_score, {r('avg(f_score)', 2)} AS avg_f_score,
        {r('avg(m_score)', 2)} AS avg_m_score, {r('avg(rfm_total)', 1)} AS avg_rfm_total FROM scored""",
    ),
)
def d10(spark, d):
    return reports.mean_scores(scored(spark, d))


@query(
    "D11_top_scores",
    sql(
        *SCORED,
        f"""SELECT rfm_score, count(*) AS customer_count, {HEADS} AS pct_of_base FROM scored
        GROUP BY rfm_score ORDER BY customer_count DESC, rfm_score LIMIT 10""",
    ),
)
def d11(spark, d):
    return reports.top_scores(scored(spark, d))


@query(
    "D12_separation",
    sql(
        *CLUSTERS, score_evaluation_cte(),
        "SELECT *, CASE "
        + " ".join(f"WHEN silhouette >= {limit} THEN '{name}'" for limit, name in reports.SEPARATION_VERDICTS)
        + " ELSE 'poor' END AS separation FROM evaluation",
    ),
)
def d12(spark, d):
    return reports.separation_report(score_evaluation(spark, d))


@query(
    "D12_separation_fitted",
    sql(
        *RFM, scaled_cte("rfm"),
        f"""SELECT CAST(k AS INTEGER) AS k, {TOTAL_SQUARE}, true AS verdict_follows, true AS centers_are_means,
        true AS beats_scores FROM range(2, 9) AS t(k)""",
    ),
)
def d12_fitted(spark, d):
    """Verdicts on fitted clusters, each held against the limits of the silhouette."""
    report = reports.separation_report(checked_evaluation(spark, d))
    verdict = "CASE " + " ".join(f"WHEN silhouette >= {limit} THEN '{name}'" for limit, name in reports.SEPARATION_VERDICTS)
    follows = F.expr(f"separation = {verdict} ELSE 'poor' END").alias("verdict_follows")
    return report.select("k", "total_square", follows, "centers_are_means", "beats_scores")


TIMELINE = f"""SELECT customer_id, invoice_no, invoice_date, {r('sum(quantity * unit_price)', 2)} AS order_total,
  sum(quantity) AS item_count, count(DISTINCT description) AS distinct_products FROM gross"""


@query(
    "D13_order_timeline",
    sql(TX, GROSS, f"{TIMELINE} GROUP BY customer_id, invoice_no, invoice_date"),
)
def d13(spark, d):
    return reports.order_timeline(gross(spark, d, description=True))


@query(
    "D13_customer_timeline",
    sql(TX, GROSS, f"{TIMELINE} WHERE customer_id = '42' GROUP BY customer_id, invoice_no, invoice_date"),
)
def d13_customer(spark, d):
    return reports.customer_timeline(gross(spark, d, description=True), "42")


@query(
    "D14_percentiles",
    sql(
        *RFM,
        f"""SELECT *, {r('cume_dist() OVER (ORDER BY recency DESC) * 100', 1)} AS recency_pct,
        {r('cume_dist() OVER (ORDER BY frequency) * 100', 1)} AS frequency_pct,
        {r('cume_dist() OVER (ORDER BY monetary) * 100', 1)} AS monetary_pct FROM rfm""",
    ),
)
def d14(spark, d):
    return reports.customer_percentiles(materialize(rfm(spark, d)))


@query("D15_profile", sql(*LABELS, "SELECT * FROM labeled WHERE customer_id = '42'"))
def d15(spark, d):
    return reports.customer_profile(labeled(spark, d), " 42 ")


@query(
    "D15_line_items",
    sql(TX, GROSS, "SELECT * FROM gross WHERE customer_id = '42' ORDER BY invoice_date DESC, invoice_no"),
)
def d15_lines(spark, d):
    return reports.customer_lines(gross(spark, d, country=True, description=True), "42")


@query(
    "D15_stored_lines",
    sql(TX, GROSS, "SELECT * FROM gross WHERE customer_id = '42' ORDER BY invoice_date DESC, invoice_no"),
)
def d15_stored(spark, d):
    """All line items stored by customer, and one customer looked up."""
    path = scratch(spark, "lines")
    name = "lines_" + path.rsplit("-", 1)[1]
    reports.store_by_customer(gross(spark, d, country=True, description=True), name, path)
    return reports.stored_lines(spark, name, " 42 ")


@query(
    "D16_preview",
    sql(*LABELS, "SELECT * FROM labeled ORDER BY monetary DESC, customer_id LIMIT 100"),
)
def d16(spark, d):
    return reports.preview(labeled(spark, d))


@query(
    "D17_retention_cells",
    sql(
        TX, GROSS, ACTIVITY, COHORTS,
        """SELECT *, CASE WHEN retention_pct IS NULL THEN 'No Data' WHEN cohort_index = 0 THEN format('{:,}', customers)
        ELSE format('{:,.1f}', retention_pct) || '%' END AS cell_text FROM matrix""",
    ),
)
def d17(spark, d):
    return reports.retention_cells(cohorts.cohort_matrix(gross(spark, d)))


@query(
    "D17_transition_cells",
    sql(
        *window_labels(), TRANSITIONS,
        f"pct AS (SELECT segment_t1, segment_t2, n AS customers, {r('prob * 100', 1)} AS migration_pct FROM transitions)",
        "SELECT *, format('{:.1f}', migration_pct) || '%' AS cell_text FROM pct",
    ),
)
def d17_transitions(spark, d):
    return reports.transition_cells(backtest.transition_matrix(*windows(spark, d)))

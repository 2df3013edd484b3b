"""Customer metrics (F), cohorts (H), lifetime value (V), governance (G) and exports (X)."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import functions as F

from catalog.inputs import (
    CLUSTERS,
    EVENTS,
    GROSS,
    LABELS,
    LABELS_COUNTRY,
    NET,
    RFM,
    RFM_COUNTRY,
    SCORED,
    TX,
    clustered,
    events,
    gross,
    labeled,
    mean,
    net,
    r,
    rfm,
    rfm_cte,
    scored,
    scored_cte,
    scratch,
    sql,
)
from catalog.registry import query
from patronage.functions.text import exact_sum, round_to
from patronage.operators import clv, cohorts, export, governance
from patronage.operators.rfm import (
    calculate_rfm,
    compute_rfm_quintiles,
    rfm_collinearity,
    rfm_summary,
    snapshot_frame,
)
from patronage.plans import activation
from patronage.session import materialize
from patronage.sources import files

# ---------------------------------------------------------------- metrics and scores


@query(
    "F1_default_snapshot",
    sql(EVENTS, "SELECT CAST(CAST(max(invoice_date) AS DATE) + 1 AS TIMESTAMP) AS snapshot_date FROM ev"),
)
def f1(spark, d):
    return snapshot_frame(events(spark, d))


@query("F2_rfm", sql(*RFM_COUNTRY, "SELECT * FROM rfm"))
def f2(spark, d):
    return rfm(spark, d, country=True)


# Unit prices of eight digits after the point, as of metered services.
TINY = "tiny AS (SELECT * REPLACE (CAST(unit_price AS DOUBLE) / 1000000 AS unit_price) FROM gross)"


@query(
    "F2b_tiny_prices",
    sql(
        TX, GROSS, TINY,
        f"""SELECT customer_id, {r('sum(CAST(quantity * unit_price AS DECIMAL(38, 12)))', 6)} AS spend,
        CAST(count(*) AS BIGINT) AS n FROM tiny GROUP BY customer_id""",
    ),
)
def f2b_tiny(spark, d):
    lines = gross(spark, d).withColumn("unit_price", F.col("unit_price") / 1_000_000)
    spend = round_to(exact_sum(F.col("quantity") * F.col("unit_price")), 6)
    return lines.groupBy("customer_id").agg(spend.alias("spend"), F.count(F.lit(1)).alias("n"))


@query("F2_rfm_net_refunds", sql(TX, NET, rfm_cte("net"), "SELECT * FROM rfm"))
def f2_net(spark, d):
    return calculate_rfm(net(spark, d))


LOOKBACK = """recent AS (SELECT * FROM gross WHERE invoice_date BETWEEN
  TIMESTAMP '2001-09-01' - INTERVAL 365 DAYS AND TIMESTAMP '2001-09-01')"""


@query(
    "F2d_rfm_lookback",
    sql(TX, GROSS, LOOKBACK, rfm_cte("recent", snapshot="TIMESTAMP '2001-09-01'"), "SELECT * FROM rfm"),
)
def f2d(spark, d):
    return calculate_rfm(gross(spark, d), snapshot_date="2001-09-01", lookback_days=365)


@query("F2g_rfm_intraday", sql(EVENTS, rfm_cte("ev"), "SELECT * FROM rfm"))
def f2g(spark, d):
    return calculate_rfm(events(spark, d))


@query("F2i_rfm_average", sql(TX, NET, rfm_cte("net", average=True), "SELECT * FROM rfm"))
def f2i(spark, d):
    return calculate_rfm(net(spark, d), use_average_monetary=True)


@query("F2j_rfm_by_spend", sql(*RFM, "SELECT * FROM rfm ORDER BY monetary DESC, customer_id"))
def f2j(spark, d):
    return rfm(spark, d).orderBy(F.desc("monetary"), "customer_id")


@query(
    "F2j_ordered_sink",
    sql(*RFM, "SELECT row_number() OVER (ORDER BY monetary DESC, customer_id) - 1 AS position, customer_id, monetary FROM rfm"),
)
def f2j_sink(spark, d):
    """The metrics written by spend, and the customer at each place of the files."""
    uri = files.write_table(
        rfm(spark, d), scratch(spark, "ordered") + ".parquet", order_by=[F.desc("monetary"), "customer_id"]
    )
    return files.with_positions(spark, uri).select("position", "customer_id", "monetary")


@query(
    "F3_summary",
    sql(
        *RFM,
        "long AS (SELECT unnest(['recency', 'frequency', 'monetary']) AS metric, "
        "unnest([CAST(recency AS DOUBLE), CAST(frequency AS DOUBLE), monetary]) AS v FROM rfm)",
        f"""SELECT metric, {r(mean('v'), 2)} AS mean, {r('stddev_samp(v)', 2)} AS std, min(v) AS min,
        {r('quantile_cont(v, 0.25)', 2)} AS p25, {r('quantile_cont(v, 0.5)', 2)} AS median,
        {r('quantile_cont(v, 0.75)', 2)} AS p75, max(v) AS max FROM long GROUP BY metric""",
    ),
)
def f3(spark, d):
    return rfm_summary(materialize(rfm(spark, d)))


@query("F4_quintiles", sql(*SCORED, "SELECT * FROM scored"))
def f4(spark, d):
    return scored(spark, d)


@query("F4_quintiles_intraday", sql(EVENTS, rfm_cte("ev"), scored_cte(), "SELECT * FROM scored"))
def f4_events(spark, d):
    return compute_rfm_quintiles(calculate_rfm(events(spark, d)))


@query(
    "F5_collinearity",
    sql(
        *RFM,
        f"""SELECT {r('corr(recency, frequency)', 4)} AS r_f_corr, {r('corr(frequency, monetary)', 4)} AS f_m_corr,
        {r('corr(recency, monetary)', 4)} AS r_m_corr FROM rfm""",
    ),
)
def f5(spark, d):
    return rfm_collinearity(rfm(spark, d))


# ---------------------------------------------------------------- cohorts

ACTIVITY = """months AS (SELECT DISTINCT customer_id, date_trunc('month', invoice_date) AS m FROM gross),
activity AS (SELECT customer_id, CAST(min(m) OVER (PARTITION BY customer_id) AS DATE) AS cohort_month,
  CAST(m AS DATE) AS active_month FROM months),
indexed AS (SELECT *, CAST(date_diff('month', cohort_month, active_month) AS INTEGER) AS cohort_index
  FROM activity)"""
COHORTS = f"""counts AS (SELECT cohort_month, cohort_index, count(*) AS customers FROM indexed GROUP BY ALL),
grid AS (SELECT cohort_month, CAST(unnest(range(0, (SELECT max(cohort_index) + 1 FROM counts))) AS INTEGER)
  AS cohort_index FROM (SELECT DISTINCT cohort_month FROM counts)),
matrix AS (SELECT strftime(g.cohort_month, '%Y-%m') AS cohort_month, g.cohort_index, c.customers,
  {r('c.customers / s.customers * 100', 1)} AS retention_pct FROM grid g
  LEFT JOIN counts c ON c.cohort_month = g.cohort_month AND c.cohort_index = g.cohort_index
  JOIN counts s ON s.cohort_month = g.cohort_month AND s.cohort_index = 0)"""


@query(
    "H1_cohort_month",
    sql(TX, GROSS, ACTIVITY, "SELECT DISTINCT customer_id, cohort_month FROM indexed"),
)
def h1(spark, d):
    first = cohorts.customer_activity(gross(spark, d)).where("cohort_index = 0")
    return first.select("customer_id", "cohort_month")


@query("H2_cohort_index", sql(TX, GROSS, ACTIVITY, "SELECT * FROM indexed"))
def h2(spark, d):
    return cohorts.customer_activity(gross(spark, d))


@query(
    "H3_cohort_counts",
    sql(TX, GROSS, ACTIVITY, COHORTS, "SELECT cohort_month, cohort_index, customers FROM matrix"),
)
def h3(spark, d):
    return cohorts.cohort_matrix(gross(spark, d)).drop("retention_pct")


@query("H4_retention", sql(TX, GROSS, ACTIVITY, COHORTS, "SELECT * FROM matrix"))
def h4(spark, d):
    return cohorts.cohort_matrix(gross(spark, d))


@query(
    "H5_cohort_summary",
    sql(
        TX, GROSS, ACTIVITY, COHORTS,
        "SELECT count(DISTINCT cohort_month) AS total_cohorts, "
        + ", ".join(
            f"coalesce({r(f'avg(retention_pct) FILTER (cohort_index = {m})', 1)}, 0) "
            f"AS avg_m{m}_retention"
            for m in (1, 3, 6)
        )
        + " FROM matrix",
    ),
)
def h5(spark, d):
    return cohorts.cohort_summary(cohorts.cohort_matrix(gross(spark, d)))


# ---------------------------------------------------------------- lifetime value

BGNBD = clv.BGNBDParameters(r=0.8, alpha=15.0, a=0.5, b=1.2)
GAMMA_GAMMA = clv.GammaGammaParameters(p=2.0, q=4.0, v=100.0)

SUMMARY = """orders_ AS (SELECT customer_id, invoice_no, min(invoice_date) AS order_date,
  CAST(sum(CAST(quantity * unit_price AS DECIMAL(18, 4))) AS DECIMAL(18, 4)) AS spend
  FROM {source} GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, invoice_no) AS rn,
  max(order_date) OVER () + INTERVAL 1 DAY AS snap FROM orders_),
summary AS (SELECT customer_id, CAST(count(*) - 1 AS INTEGER) AS frequency_repeat,
  CAST(greatest(0, date_sub('day', min(order_date), max(order_date))) AS DOUBLE) AS recency_days,
  CAST(greatest(1, date_sub('day', min(order_date), max(snap))) AS DOUBLE) AS tenure_days,
  greatest(CAST(0.01 AS DOUBLE), coalesce(CAST(sum(spend) FILTER (rn > 1) AS DOUBLE) / nullif(count(*) - 1, 0),
    CAST(min(spend) FILTER (rn = 1) AS DOUBLE))) AS monetary_avg,
  greatest(CAST(0.01 AS DOUBLE), CAST(min(spend) FILTER (rn = 1) AS DOUBLE)) AS first_order_value,
  CAST(count(*) AS INTEGER) AS total_orders FROM ordered GROUP BY customer_id)"""


def summary_ctes(source: str) -> list[str]:
    base = {"gross": [TX, GROSS], "ev": [EVENTS]}[source]
    return [*base, SUMMARY.format(source=source)]


ALIVE = f"""model AS (SELECT *, CAST(frequency_repeat AS DOUBLE) AS x,
  1 / (1 + {BGNBD.a} / ({BGNBD.b} + frequency_repeat)
    * pow(({BGNBD.alpha} + tenure_days) / ({BGNBD.alpha} + recency_days), {BGNBD.r} + frequency_repeat))
  AS alive, (SELECT median(monetary_avg) FROM summary) AS med FROM summary),
valued AS (SELECT *, ({BGNBD.r} + x) / ({BGNBD.alpha} + tenure_days) * alive * 180 AS orders,
  greatest(0.01, CASE WHEN x = 0 THEN (monetary_avg + med) / 2 ELSE
    ({GAMMA_GAMMA.q} - 1) / ({GAMMA_GAMMA.p} * x + {GAMMA_GAMMA.q} - 1)
      * {GAMMA_GAMMA.p} * {GAMMA_GAMMA.v} / ({GAMMA_GAMMA.q} - 1)
    + {GAMMA_GAMMA.p} * x / ({GAMMA_GAMMA.p} * x + {GAMMA_GAMMA.q} - 1) * monetary_avg END) AS spend
  FROM model)"""


def summary(spark, d, source=gross):
    return clv.clv_summary(source(spark, d))


@query(
    "V1_order_rollup",
    sql(
        *summary_ctes("gross"),
        f"SELECT customer_id, invoice_no, order_date, {r('spend', 2)} AS order_spend FROM orders_",
    ),
)
def v1(spark, d):
    rolled = clv.order_rollup(gross(spark, d))
    return rolled.withColumn("order_spend", round_to(F.col("order_spend"), 2))


SUMMARY_OUT = "SELECT * FROM summary"


@query("V2_clv_summary", sql(*summary_ctes("gross"), SUMMARY_OUT))
def v2(spark, d):
    return summary(spark, d)


@query("V2_clv_summary_intraday", sql(*summary_ctes("ev"), SUMMARY_OUT))
def v2_events(spark, d):
    return summary(spark, d, events)


# The fixed point and one near it; lgamma is evaluated by the SQL engine itself.
POINTS = [BGNBD, clv.BGNBDParameters(2.5, 400.0, 0.1, 30.0)]


def bgnbd_sql(p: clv.BGNBDParameters) -> str:
    return f"""sum(lgamma({p.r} + x) - lgamma({p.r}) - lgamma(x + 1)
  + lgamma({p.b} + x) + lgamma({p.a} + {p.b}) - lgamma({p.a} + {p.b} + x) - lgamma({p.b})
  + {p.r} * ln({p.alpha} / ({p.alpha} + tenure_days)) - x * ln({p.alpha} + tenure_days)
  + CASE WHEN x > 0 THEN ln(1 + {p.a} / ({p.b} + greatest(x - 1, 0))
    * pow(({p.alpha} + tenure_days) / ({p.alpha} + recency_days), {p.r} + x)) ELSE 0 END)"""


LN_BGNBD = " UNION ALL ".join(
    f"SELECT {i} AS point, {r(bgnbd_sql(p), 4)} AS log_likelihood FROM model"
    for i, p in enumerate(POINTS)
)


@query("V3_bgnbd_likelihood", sql(*summary_ctes("gross"), ALIVE, LN_BGNBD))
def v3_likelihood(spark, d):
    values = clv.bgnbd_log_likelihood(summary(spark, d), [astuple(p) for p in POINTS])
    return spark.createDataFrame(
        [(i, round(v, 4)) for i, v in enumerate(values)], "point int, log_likelihood double"
    )


def at_bounds_sql(name: str, rows: str, likelihood, free: str, bounds: dict[str, tuple[float, float]], fixed: dict[str, float]) -> str:
    """Maximum in ``free`` by halving on the slope, the others on the given bounds; a bound at which the likelihood rises
    inwards gives null. Slopes are central differences of the engine's own lgamma."""

    def slope(parameter: str, point: dict[str, str]) -> str:
        up, down = ({**point, parameter: f"({point[parameter]} * {f})"} for f in ("1.00001", "0.99999"))
        return f"sum(w * (({likelihood(**up)}) - ({likelihood(**down)})))"

    low, high = bounds[free]
    middle = {**{key: f"{value!r}::DOUBLE" for key, value in fixed.items()}, free: "((lo + hi) / 2)"}
    found = {**middle, free: "lo"}
    kept = ", ".join(
        f"CASE WHEN {slope(key, found)} {'>' if value == bounds[key][1] else '<'} 0 THEN {value!r}::DOUBLE END AS {key}"
        for key, value in fixed.items()
    )
    return f"""{name}_rows AS ({rows}),
{name}_halving AS (SELECT {low!r}::DOUBLE AS lo, {high!r}::DOUBLE AS hi, 0 AS i UNION ALL
  SELECT CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT lo, hi, i, {slope(free, middle)} > 0 AS up FROM {name}_halving, {name}_rows WHERE i < 50 GROUP BY ALL)),
{name} AS (SELECT {r('lo', 4)} AS {free}, {kept} FROM {name}_halving, {name}_rows WHERE i = 50 GROUP BY lo)"""


def bgnbd_row(r: str, alpha: str, a: str, b: str) -> str:
    return f"""lgamma({r} + x) - lgamma({r}) + lgamma({b} + x) + lgamma({a} + {b}) - lgamma({a} + {b} + x)
      - lgamma({b}) + {r} * ln({alpha} / ({alpha} + tenure_days)) - x * ln({alpha} + tenure_days)
      + CASE WHEN x > 0 THEN ln(1 + {a} / ({b} + greatest(x - 1, 0))
        * pow(({alpha} + tenure_days) / ({alpha} + recency_days), {r} + x)) ELSE 0 END"""


def gamma_gamma_row(p: str, q: str, v: str) -> str:
    return f"""lgamma({p} * x + {q}) - lgamma({p} * x) - lgamma({q}) + {q} * ln({v}) + ({p} * x - 1) * ln(monetary_avg)
      + {p} * x * ln(x) - ({p} * x + {q}) * ln(x * monetary_avg + {v})"""


# These tables are more regular than any customers: the most likely parameters but one lie on their bounds.
BGNBD_FIT = at_bounds_sql(
    "bgnbd", "SELECT x, recency_days, tenure_days, count(*) AS w FROM model GROUP BY ALL", bgnbd_row, "r",
    dict(zip(("r", "alpha", "a", "b"), clv.BGNBD_BOUNDS)), {"alpha": 1000.0, "a": 0.0001, "b": 50.0},
)
GAMMA_GAMMA_FIT = at_bounds_sql(
    "spend_fit", "SELECT x, monetary_avg, count(*) AS w FROM model WHERE x > 0 GROUP BY ALL", gamma_gamma_row, "q",
    dict(zip(("p", "q", "v"), clv.GAMMA_GAMMA_BOUNDS)), {"p": 50.0, "v": 5000.0},
)


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "V3_fit_bgnbd",
    recursive(
        sql(
            *summary_ctes("gross"), ALIVE, BGNBD_FIT,
            f"SELECT {r('r', 2)} AS r, {r('alpha', 2)} AS alpha, {r('a', 4)} AS a, {r('b', 2)} AS b FROM bgnbd",
        )
    ),
)
def v3(spark, d):
    found = clv.fit_bgnbd(summary(spark, d))
    return spark.createDataFrame(
        [(round(found.r, 2), round(found.alpha, 2), found.a, round(found.b, 2))], "r double, alpha double, a double, b double"
    )


def beats_others(likelihood, found: tuple, others: list[tuple], bounds: tuple) -> bool:
    """Whether the fit is as likely as given points, and as all points inside the bounds of the fit that are a tenth away
    in one parameter."""
    around = [
        tuple(min(max(v * (factor if i == j else 1), low), high) for j, (v, (low, high)) in enumerate(zip(found, bounds)))
        for i in range(len(found)) for factor in (0.9, 1.1)
    ]
    at_fit, *rest = likelihood([found, *others, *around])
    return at_fit >= max(rest) - 0.01


@query(
    "V3_fit_quality",
    sql(
        *summary_ctes("gross"), ALIVE,
        "SELECT count(*) AS customers, CAST(sum(x) AS BIGINT) AS repeat_orders, true AS best FROM model",
    ),
)
def v3_quality(spark, d):
    table = materialize(summary(spark, d))
    found = astuple(clv.fit_bgnbd(table))
    others = [astuple(p) for p in POINTS] + [clv.BGNBD_START]
    best = beats_others(lambda points: clv.bgnbd_log_likelihood(table, points), found, others, clv.BGNBD_BOUNDS)
    return table.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("frequency_repeat").alias("repeat_orders"),
        F.lit(best).alias("best"),
    )


@query(
    "V4_p_alive",
    sql(*summary_ctes("gross"), ALIVE, f"SELECT customer_id, {r('alive', 6)} AS p_alive FROM valued"),
)
def v4(spark, d):
    return summary(spark, d).select("customer_id", round_to(clv.p_alive(BGNBD), 6).alias("p_alive"))


@query(
    "V5_expected_orders",
    sql(*summary_ctes("ev"), ALIVE, f"SELECT customer_id, {r('orders', 6)} AS orders FROM valued"),
)
def v5(spark, d):
    expected = round_to(clv.expected_orders(BGNBD), 6)
    return summary(spark, d, events).select("customer_id", expected.alias("orders"))


P, Q, V = GAMMA_GAMMA.p, GAMMA_GAMMA.q, GAMMA_GAMMA.v


@query(
    "V6_gamma_gamma_likelihood",
    sql(
        *summary_ctes("gross"), ALIVE,
        "SELECT "
        + r(
            f"""sum(lgamma({P} * x + {Q}) - lgamma({P} * x) - lgamma({Q}) + {Q} * ln({V})
            + ({P} * x - 1) * ln(monetary_avg) + {P} * x * ln(x)
            - ({P} * x + {Q}) * ln(x * monetary_avg + {V}))""",
            4,
        )
        + " AS log_likelihood FROM model WHERE x > 0",
    ),
)
def v6_likelihood(spark, d):
    values = clv.gamma_gamma_log_likelihood(summary(spark, d), [(P, Q, V)])
    return spark.createDataFrame([(round(values[0], 4),)], "log_likelihood double")


@query(
    "V6_fit_gamma_gamma",
    recursive(
        sql(
            *summary_ctes("gross"), ALIVE, GAMMA_GAMMA_FIT,
            f"SELECT {r('p', 2)} AS p, {r('q', 2)} AS q, {r('v', 2)} AS v FROM spend_fit",
        )
    ),
)
def v6(spark, d):
    found = clv.fit_gamma_gamma(summary(spark, d))
    return spark.createDataFrame([tuple(round(value, 2) for value in astuple(found))], "p double, q double, v double")


@query(
    "V6_fit_quality",
    sql(
        *summary_ctes("gross"), ALIVE,
        f"""SELECT count(*) AS buyers, {r('sum(CAST(x * monetary_avg AS DECIMAL(38, 8)))', 0)} AS repeat_spend, true AS best
        FROM model WHERE x > 0""",
    ),
)
def v6_quality(spark, d):
    table = materialize(summary(spark, d))
    found = astuple(clv.fit_gamma_gamma(table))
    others = [(P, Q, V), clv.GAMMA_GAMMA_START]
    best = beats_others(lambda points: clv.gamma_gamma_log_likelihood(table, points), found, others, clv.GAMMA_GAMMA_BOUNDS)
    buyers = table.where("frequency_repeat > 0")
    return buyers.agg(
        F.count(F.lit(1)).alias("buyers"),
        round_to(exact_sum(F.col("frequency_repeat") * F.col("monetary_avg")), 0).alias("repeat_spend"),
        F.lit(best).alias("best"),
    )


@query(
    "V7_expected_spend",
    sql(*summary_ctes("ev"), ALIVE, f"SELECT customer_id, {r('spend', 6)} AS spend FROM valued"),
)
def v7(spark, d):
    table = summary(spark, d, events)
    spend = clv.expected_spend(GAMMA_GAMMA, clv.median_spend(table))
    return table.select("customer_id", round_to(spend, 6).alias("spend"))


CLV_SQL = f"""SELECT customer_id, {r('alive', 4)} AS p_alive, {r('1 - alive', 4)} AS churn_probability,
  {r('orders', 2)} AS expected_transactions_6m, {r('spend', 2)} AS expected_avg_spend,
  {r('orders * spend', 2)} AS predicted_clv_6m FROM valued"""


@query("V8_customer_clv", sql(*summary_ctes("gross"), ALIVE, CLV_SQL))
def v8(spark, d):
    return clv.customer_clv(materialize(summary(spark, d)), BGNBD, GAMMA_GAMMA)


FITTED_CLV = f"""fitted AS (SELECT customer_id,
    1 / (1 + a / (b + x) * pow((alpha + tenure_days) / (alpha + recency_days), r + x)) AS alive,
    (r + x) / (alpha + tenure_days) * 180 AS rate,
    greatest(0.01, CASE WHEN x = 0 THEN (monetary_avg + med) / 2
      ELSE (p * v + p * x * monetary_avg) / (p * x + q - 1) END) AS spend
  FROM model, bgnbd, spend_fit),
valued_fit AS (SELECT customer_id, alive, rate * alive AS orders, spend FROM fitted)"""


@query(
    "V8_fitted_clv",
    recursive(
        sql(
            *summary_ctes("gross"), ALIVE, BGNBD_FIT, GAMMA_GAMMA_FIT, FITTED_CLV,
            CLV_SQL.replace("FROM valued", "FROM valued_fit"),
        )
    ),
)
def v8_fitted(spark, d):
    return activation.customer_values(gross(spark, d))


# ---------------------------------------------------------------- governance

SALT = "a-secret-kept-outside-the-tables"


def hmac_sql(key: str, message: str) -> str:
    """Nested SHA-256 over blobs with the padded keys written out."""
    padded = key.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in padded).hex(), bytes(b ^ 0x5C for b in padded).hex()
    first = f"sha256(unhex('{inner}') || encode({message}))"
    return f"sha256(unhex('{outer}') || unhex({first}))"


@query(
    "G1_pseudonymize",
    f"""SELECT 'usr_' || substr({hmac_sql(SALT, 'CAST(c_custkey AS VARCHAR)')}, 1, 16) AS customer_id,
    c_mktsegment FROM customer""",
)
def g1(spark, d):
    customer = spark.read.parquet(f"{d}/customer.parquet").selectExpr(
        "concat(' ', c_custkey) AS customer_id", "c_mktsegment"
    )
    return governance.pseudonymize_customer_ids(customer, SALT)


ERASED = """erased AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS customer_id FROM customer
  JOIN clustered ON CAST(c_custkey AS VARCHAR) = clustered.customer_id WHERE c_acctbal < 0)"""


def erasure(spark, d):
    table = materialize(clustered(spark, d))
    customer = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal < 0")
    ids = customer.select(F.col("c_custkey").cast("string").alias("customer_id")).join(
        table.select("customer_id"), "customer_id", "left_semi"
    )
    means = [F.avg(F.col(f).cast("double")).alias(f) for f in ("recency", "frequency", "monetary")]
    return governance.erase_customers(table, ids, table.groupBy("cluster").agg(*means))


@query(
    "G2_erased_table",
    sql(
        *CLUSTERS, ERASED,
        "SELECT * FROM clustered WHERE customer_id NOT IN (SELECT customer_id FROM erased)",
    ),
)
def g2_table(spark, d):
    return erasure(spark, d)[0]


@query(
    "G2_erased_centroids",
    sql(
        *CLUSTERS, ERASED,
        """SELECT cluster, round(coalesce(avg(recency) FILTER (gone = 0), 0), 4) AS recency,
        round(coalesce(avg(frequency) FILTER (gone = 0), 0), 4) AS frequency,
        round(coalesce(avg(monetary) FILTER (gone = 0), 0), 2) AS monetary, max(gone) = 1 AS affected
        FROM (SELECT *, CASE WHEN customer_id IN (SELECT customer_id FROM erased) THEN 1 ELSE 0 END AS gone
          FROM clustered) GROUP BY cluster""",
    ),
)
def g2_centroids(spark, d):
    centroids = erasure(spark, d)[1]
    return centroids.withColumns(
        {"recency": F.round("recency", 4), "frequency": F.round("frequency", 4),
         "monetary": F.round("monetary", 2)}
    )


# ---------------------------------------------------------------- exports


@query(
    "X1_escape_formulas",
    r"""SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^[=+\-@\t\r]') THEN '''' || t ELSE t END AS t
    FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '=' WHEN 1 THEN '' ELSE chr(9) END || text AS t
      FROM conversations)""",
)
def x1(spark, d):
    talks = spark.read.parquet(f"{d}/conversations.parquet").selectExpr(
        "conv_id", "turn",
        "concat(CASE turn % 3 WHEN 0 THEN '=' WHEN 1 THEN '' ELSE chr(9) END, text) AS t",
    )
    return export.escape_formulas(talks)


@query(
    "X2_export_table",
    sql(
        *LABELS_COUNTRY,
        """SELECT customer_id AS "Customer ID", recency AS "Recency (Days)", frequency AS "Frequency (Orders)",
        monetary AS "Monetary (£)", cluster AS "Cluster ID", segment AS "Customer Segment",
        strftime(first_purchase, '%Y-%m-%d') AS "First Purchase Date",
        strftime(last_purchase, '%Y-%m-%d') AS "Last Purchase Date", country AS "Country" FROM labeled""",
    ),
)
def x2(spark, d):
    return export.export_table(labeled(spark, d, country=True), currency_symbol="£")


CAMPAIGN = "spring_campaign"
# 256-bit digest modulo 100 from its eight 32-bit parts; 2**32 leaves 96.
_parts = [f"CAST('0x' || substr(h, {i}, 8) AS BIGINT)" for i in range(1, 65, 8)]
_mod = "0"
for _part in _parts:
    _mod = f"(({_mod}) * 96 + {_part}) % 100"
HOLDOUT = f"({_mod}) < 10"
HASHED = f"hashed AS (SELECT *, sha256(customer_id || '_{CAMPAIGN}') AS h FROM {{source}})"


@query(
    "X3_crm_payload",
    sql(
        *LABELS, SUMMARY.format(source="gross"), ALIVE, f"clv AS ({CLV_SQL})",
        "joined AS (SELECT l.*, c.* EXCLUDE (customer_id) FROM labeled l JOIN clv c USING (customer_id))",
        HASHED.format(source="joined"),
        f"""SELECT customer_id, recency AS recency_days, frequency AS frequency_orders,
        {r('monetary', 2)} AS monetary_spend, segment AS segment_name, cluster AS cluster_id,
        predicted_clv_6m, {r('churn_probability * 100', 1)} AS churn_risk_pct,
        {HOLDOUT} AS control_holdout FROM hashed""",
    ),
)
def x3(spark, d):
    values = clv.customer_clv(materialize(summary(spark, d)), BGNBD, GAMMA_GAMMA)
    return activation.crm_audience(labeled(spark, d), values, CAMPAIGN)


@query(
    "X4_control_group",
    sql(
        "ids AS (SELECT CAST(c_custkey AS VARCHAR) AS customer_id FROM customer)",
        HASHED.format(source="ids"),
        f"""SELECT customer_id, 0 AS recency_days, 1 AS frequency_orders, 0.0 AS monetary_spend,
        'Unassigned' AS segment_name, 0 AS cluster_id, 0.0 AS predicted_clv_6m, 0.0 AS churn_risk_pct,
        {HOLDOUT} AS control_holdout FROM hashed""",
    ),
)
def x4(spark, d):
    customer = spark.read.parquet(f"{d}/customer.parquet")
    ids = customer.select(F.col("c_custkey").cast("string").alias("customer_id"))
    return export.crm_payload(ids, CAMPAIGN)

"""Inputs of the registered queries, each as a DataFrame and as SQL over the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.operators.cleaning import CleaningPolicy, clean_transactions
from patronage.operators.personas import label_segments
from patronage.operators.rfm import calculate_rfm, compute_rfm_quintiles
from patronage.session import checkpoint_dir
from patronage.sources.retail_view import purchase_events, retail_transactions

# ---------------------------------------------------------------- DataFrames


def tx(spark: SparkSession, d: str, country: bool = False, description: bool = False) -> DataFrame:
    return retail_transactions(spark, d, country, description)


def gross(spark: SparkSession, d: str, **columns: bool) -> DataFrame:
    return clean_transactions(tx(spark, d, **columns))[0]


def net(spark: SparkSession, d: str, **columns: bool) -> DataFrame:
    return clean_transactions(tx(spark, d, **columns), policy=CleaningPolicy("net"))[0]


def events(spark: SparkSession, d: str) -> DataFrame:
    return purchase_events(spark, d)


def rfm(spark: SparkSession, d: str, country: bool = False) -> DataFrame:
    return calculate_rfm(gross(spark, d, country=country))


def scored(spark: SparkSession, d: str, country: bool = False) -> DataFrame:
    return compute_rfm_quintiles(rfm(spark, d, country))


def clustered(spark: SparkSession, d: str, country: bool = False) -> DataFrame:
    """Customers grouped by spend score: clusters that SQL can reproduce."""
    return scored(spark, d, country).withColumn("cluster", F.col("m_score") - 1)


def labeled(spark: SparkSession, d: str, country: bool = False) -> DataFrame:
    return label_segments(clustered(spark, d, country))[0]


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw export with damaged ids, numbers, dates and invoices, and with exact copies."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    customer = spark.read.parquet(f"{d}/customer.parquet")
    joined = lines.join(orders, F.expr("l_orderkey = o_orderkey")).join(
        customer, F.expr("o_custkey = c_custkey")
    )
    copies = F.expr("explode(array_repeat(1, if(l_orderkey % 53 = 0, 2, 1)))")
    return joined.select("*", copies).selectExpr(
        """CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN ' NaN '
             WHEN l_orderkey % 103 = 0 THEN concat(o_custkey, '.0')
             WHEN l_orderkey % 107 = 0 THEN concat('00', o_custkey)
             ELSE concat(' ', o_custkey) END AS `Customer ID`""",
        """CASE WHEN l_orderkey % 73 = 0 THEN 'NULL' WHEN l_orderkey % 67 = 0 THEN '  '
             ELSE concat(if(l_returnflag = 'R', 'c', ''), l_orderkey) END AS InvoiceNo""",
        """CASE WHEN l_orderkey % 71 = 0 THEN 'junk'
             ELSE date_format(if(l_returnflag = 'R', l_shipdate, o_orderdate),
                              'yyyy-MM-dd HH:mm:ss') END AS InvoiceDate""",
        """CASE WHEN l_orderkey % 89 = 0 THEN concat('(', cast(l_quantity AS bigint), ')')
             WHEN l_orderkey % 59 = 0 THEN 'n/a' WHEN l_orderkey % 47 = 0 THEN '0'
             ELSE concat(if(l_returnflag = 'R' AND l_orderkey % 3 > 0, ' -', ' '),
                         cast(l_quantity AS bigint), ' ') END AS Qty""",
        """CASE WHEN l_orderkey % 83 = 0 THEN '$1,000.50' WHEN l_orderkey % 61 = 0 THEN '0'
             WHEN l_orderkey % 43 = 0 THEN '--5'
             ELSE concat(cast(l_quantity AS bigint) * 3 + l_linenumber, '.25') END AS price""",
        "c_mktsegment AS Region",
        "l_tax AS tax",
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh location in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- SQL


def r(value: str, digits: int) -> str:
    """The scaled double rounded half to even."""
    scale = 10**digits
    return f"(round_even(CAST({value} AS DOUBLE) * {scale}, 0) / {scale})"


def mean(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18, 4))) AS DOUBLE) / count({column})"


MISSING = "('', 'nan', 'none', 'null')"
MISSING_INVOICE = "('', 'nan', 'none', 'null', '0')"

TX = """tx AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id,
    CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice_no,
    CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE o_orderdate END AS invoice_date,
    CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
    CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
      // (2 * CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100 AS unit_price,
    n_name AS country, p_name AS description
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

GROSS = f"""gross AS (
  SELECT *, quantity * unit_price < 0 OR upper(invoice_no) LIKE 'C%' AS is_refund FROM tx
  WHERE upper(invoice_no) NOT LIKE 'C%' AND lower(trim(invoice_no)) NOT IN {MISSING_INVOICE}
    AND quantity > 0 AND unit_price > 0)"""

NET = f"""net AS (
  SELECT *, quantity * unit_price < 0 OR upper(invoice_no) LIKE 'C%' AS is_refund FROM tx
  WHERE NOT (upper(invoice_no) LIKE 'C%' AND quantity >= 0)
    AND lower(trim(invoice_no)) NOT IN {MISSING_INVOICE} AND quantity <> 0 AND unit_price > 0)"""

EVENTS = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(event_id AS VARCHAR) AS invoice_no,
    ts AS invoice_date, CAST(1 AS DOUBLE) AS quantity, value AS unit_price
  FROM events WHERE event_type = 'purchase')"""


def rfm_cte(
    source: str,
    name: str = "rfm",
    country: bool = False,
    snapshot: str | None = None,
    average: bool = False,
) -> str:
    snap = snapshot or (
        f"(SELECT CAST(CAST(max(invoice_date) AS DATE) + 1 AS TIMESTAMP) FROM {source})"
    )
    total = f"greatest(0, {r('sum(quantity * unit_price)', 2)})"
    orders = "greatest(1, count(DISTINCT CASE WHEN quantity > 0 THEN invoice_no END))"
    monetary = r(f"{total} / {orders}", 2) if average else total
    main = f"""SELECT customer_id,
      CAST(greatest(0, date_sub('day', coalesce(max(CASE WHEN quantity > 0 THEN invoice_date END),
        max(invoice_date)), {snap})) AS BIGINT) AS recency,
      CAST({orders} AS BIGINT) AS frequency, CAST({monetary} AS DOUBLE) AS monetary,
      min(invoice_date) AS first_purchase, max(invoice_date) AS last_purchase
    FROM {source} WHERE lower(trim(invoice_no)) NOT IN {MISSING_INVOICE} GROUP BY customer_id"""
    if not country:
        return f"{name} AS ({main})"
    return f"""{name}_base AS ({main}),
{name}_country AS (SELECT customer_id, country, row_number() OVER (
    PARTITION BY customer_id ORDER BY count(*) DESC, country) AS rn
  FROM {source} GROUP BY customer_id, country),
{name} AS (SELECT b.*, c.country FROM {name}_base b JOIN {name}_country c
    ON b.customer_id = c.customer_id AND c.rn = 1)"""


def scored_cte(source: str = "rfm", name: str = "scored") -> str:
    def score(rank: str) -> str:
        return f"CAST(greatest(1, (({rank} - 1) * 5 + n - 2) // (n - 1)) AS INTEGER)"

    return f"""{name}_ranks AS (SELECT *, count(*) OVER () AS n,
    row_number() OVER (ORDER BY recency DESC, monetary DESC, customer_id) AS rr,
    row_number() OVER (ORDER BY frequency, monetary DESC, customer_id) AS rf,
    row_number() OVER (ORDER BY monetary, customer_id) AS rm FROM {source}),
{name}_parts AS (SELECT * EXCLUDE (n, rr, rf, rm), {score('rr')} AS r_score,
    {score('rf')} AS f_score, {score('rm')} AS m_score FROM {name}_ranks),
{name} AS (SELECT *, CAST(r_score AS VARCHAR) || f_score || m_score AS rfm_score,
    r_score + f_score + m_score AS rfm_total FROM {name}_parts)"""


def persona_sql(r: str, f: str, m: str) -> str:
    return f"""CASE
    WHEN {r} >= 0.6 AND {f} >= 0.6 AND {m} >= 0.6 THEN 'Champions'
    WHEN {f} >= 0.6 AND {m} >= 0.5 THEN CASE WHEN {r} >= 0.4 THEN 'Loyal Customers' ELSE 'At Risk' END
    WHEN {m} >= 0.7 AND {r} <= 0.4 THEN 'At Risk'
    WHEN {r} >= 0.7 AND {f} <= 0.4 THEN CASE WHEN {m} >= 0.5 THEN 'Promising' ELSE 'New Customers' END
    WHEN {r} >= 0.5 AND {f} >= 0.4 THEN 'Potential Loyalists'
    WHEN {r} >= 0.35 AND {f} >= 0.25 THEN 'Needs Attention'
    WHEN {r} <= 0.35 AND {f} <= 0.35 THEN
      CASE WHEN {m} <= 0.35 THEN 'Lost / Dormant' ELSE 'About to Sleep' END
    WHEN {r} <= 0.4 THEN 'About to Sleep' ELSE 'Needs Attention' END"""


def mapping_cte(source: str = "clustered", name: str = "mapping") -> str:
    def norm(c: str) -> str:
        low, high = f"min({c}) OVER ()", f"max({c}) OVER ()"
        return f"coalesce(({c} - {low}) / nullif({high} - {low}, 0), 0.5)"

    recent = "coalesce(1 - (recency - min(recency) OVER ()) / nullif(max(recency) OVER () - min(recency) OVER (), 0), 0.5)"
    return f"""{name}_means AS (SELECT cluster, avg(recency) AS recency, avg(frequency) AS frequency,
    avg(monetary) AS monetary FROM {source} GROUP BY cluster),
{name}_norm AS (SELECT *, {recent} AS r_norm, {norm('frequency')} AS f_norm,
    {norm('monetary')} AS m_norm, count(*) OVER () AS clusters FROM {name}_means),
{name}_base AS (SELECT *, 0.35 * r_norm + 0.35 * f_norm + 0.30 * m_norm AS composite,
    {persona_sql('r_norm', 'f_norm', 'm_norm')} AS base FROM {name}_norm),
{name}_tier AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY composite DESC, cluster)
    AS tier FROM {name}_base),
{name} AS (SELECT cluster, CASE WHEN clusters = 1 THEN 'All Customers' WHEN tier = 1 THEN base
    ELSE base || ' (Tier ' || tier || ')' END AS segment FROM {name}_tier)"""


def sql(*parts: str) -> str:
    """``WITH`` all but the last part, then the last part."""
    return f"WITH {', '.join(parts[:-1])} {parts[-1]}" if len(parts) > 1 else parts[0]


CLUSTERED = "clustered AS (SELECT *, m_score - 1 AS cluster FROM scored)"
LABELED = "labeled AS (SELECT c.*, m.segment FROM clustered c JOIN mapping m ON c.cluster = m.cluster)"

RFM = [TX, GROSS, rfm_cte("gross")]
RFM_COUNTRY = [TX, GROSS, rfm_cte("gross", country=True)]
SCORED = [*RFM, scored_cte()]
CLUSTERS = [*SCORED, CLUSTERED]
LABELS = [*CLUSTERS, mapping_cte(), LABELED]
LABELS_COUNTRY = [*RFM_COUNTRY, scored_cte(), CLUSTERED, mapping_cte(), LABELED]

RAW = """raw AS (
  SELECT CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN ' NaN '
      WHEN l_orderkey % 103 = 0 THEN o_custkey || '.0'
      WHEN l_orderkey % 107 = 0 THEN '00' || o_custkey ELSE ' ' || o_custkey END AS customer_id,
    CASE WHEN l_orderkey % 73 = 0 THEN 'NULL' WHEN l_orderkey % 67 = 0 THEN '  '
      ELSE (CASE WHEN l_returnflag = 'R' THEN 'c' ELSE '' END) || l_orderkey END AS invoice_no,
    CASE WHEN l_orderkey % 71 = 0 THEN 'junk' ELSE strftime(
      CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') END
      AS invoice_date,
    CASE WHEN l_orderkey % 89 = 0 THEN '(' || CAST(l_quantity AS BIGINT) || ')'
      WHEN l_orderkey % 59 = 0 THEN 'n/a' WHEN l_orderkey % 47 = 0 THEN '0'
      ELSE (CASE WHEN l_returnflag = 'R' AND l_orderkey % 3 > 0 THEN ' -' ELSE ' ' END)
        || CAST(l_quantity AS BIGINT) || ' ' END AS quantity,
    CASE WHEN l_orderkey % 83 = 0 THEN '$1,000.50' WHEN l_orderkey % 61 = 0 THEN '0'
      WHEN l_orderkey % 43 = 0 THEN '--5'
      ELSE (CAST(l_quantity AS BIGINT) * 3 + l_linenumber) || '.25' END AS unit_price,
    c_mktsegment AS country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey,
    (VALUES (1), (2)) AS copies(copy) WHERE copy = 1 OR l_orderkey % 53 = 0)"""


def number_sql(column: str) -> str:
    bare = rf"regexp_replace(trim({column}), '^\(\s*(.*?)\s*\)$', '-\1')"
    return rf"TRY_CAST(regexp_replace({bare}, '[^0-9.\-]', '', 'g') AS DOUBLE)"


def marked_cte(policy: str, name: str) -> str:
    cancelled = "upper(trim(invoice_no)) LIKE 'C%'"
    if policy == "net":
        cancelled += " AND coalesce(quantity >= 0, false)"
        bad_quantity = "quantity IS NULL OR quantity = 0"
    else:
        bad_quantity = "quantity IS NULL OR quantity <= 0"
    return rf"""{name}_typed AS (SELECT
    customer_id IS NULL OR lower(trim(customer_id)) IN {MISSING} AS no_customer,
    coalesce(regexp_replace(trim(customer_id), '\.0+$', ''), '') AS customer_id, invoice_no,
    TRY_CAST(invoice_date AS TIMESTAMP) AS invoice_date, {number_sql('quantity')} AS quantity,
    {number_sql('unit_price')} AS unit_price, country FROM raw),
{name} AS (SELECT * EXCLUDE (no_customer), CASE WHEN no_customer THEN 'missing_customer'
    WHEN {cancelled} THEN 'cancelled'
    WHEN lower(trim(invoice_no)) IN {MISSING_INVOICE} THEN 'missing_invoice'
    WHEN {bad_quantity} THEN 'non_positive_qty'
    WHEN unit_price IS NULL OR unit_price <= 0 THEN 'non_positive_price'
    WHEN invoice_date IS NULL THEN 'invalid_date' END AS removal_reason FROM {name}_typed)"""

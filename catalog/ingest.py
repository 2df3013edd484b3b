"""Sources and sinks (S), cleaning (C), reconciliation (R)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.inputs import (
    MISSING,
    NET,
    RAW,
    TX,
    marked_cte,
    net,
    number_sql,
    r,
    raw_lines,
    scratch,
    sql,
    tx,
)
from catalog.registry import query
from patronage.functions.text import clean_id, clean_number, is_missing, parse_date, round_to
from patronage.operators import cleaning, reconcile
from patronage.operators.cleaning import CleaningPolicy
from patronage.sources import files
from patronage.sources.conform import conform_transactions, select_canonical

NET_POLICY = CleaningPolicy("net")
MARKED = {"gross": [RAW, marked_cte("gross", "marked")], "net": [RAW, marked_cte("net", "marked")]}


# ---------------------------------------------------------------- sources and sinks


@query(
    "S1_csv_scan",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, "
    "CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer",
)
def s1(spark, d):
    path = scratch(spark, "csv")
    customer = spark.read.parquet(f"{d}/customer.parquet")
    files.write_csv(customer, path, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return files.read_csv(spark, path)


@query(
    "S1_csv_header_orders",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment "
    "FROM customer",
)
def s1_orders(spark, d):
    """One folder with files whose headers name other columns in another order."""
    path = scratch(spark, "csv")
    customer = spark.read.parquet(f"{d}/customer.parquet")
    files.write_csv(customer.where("c_custkey % 2 = 0"), path, ["c_mktsegment", "c_custkey", "c_name"])
    files.write_csv(customer.where("c_custkey % 2 = 1"), path, ["c_name", "c_custkey"], mode="append")
    return files.read_csv(spark, path)


@query(
    "S2_encoding_fallback",
    "SELECT CAST(p_partkey AS VARCHAR) AS id, 'Café ' || p_name AS name, '£' || p_size AS size FROM part",
)
def s2(spark, d):
    path = scratch(spark, "latin")
    part = spark.read.parquet(f"{d}/part.parquet")
    text = part.selectExpr(
        "p_partkey AS id", "concat('Café ', p_name) AS name", "concat('£', p_size) AS size"
    )
    half = F.col("id") % 2 == 0
    text.where(half).write.option("header", True).csv(path)
    text.where(~half).write.mode("append").option("header", True).option(
        "encoding", "ISO-8859-1"
    ).csv(path)
    return files.read_csv(spark, path)


@query(
    "S3_ids_stay_text",
    "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS order_id, "
    "'00' || o_custkey AS customer_no FROM orders",
)
def s3(spark, d):
    path = scratch(spark, "ids")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    ids = orders.selectExpr(
        "lpad(o_orderkey, 12, '0') AS order_id", "concat('00', o_custkey) AS customer_no"
    )
    files.write_csv(ids, path)
    return files.read_csv(spark, path)


@query("S4_parquet_detection", "SELECT * FROM supplier")
def s4(spark, d):
    path = scratch(spark, "table")  # no suffix: found out from the stored bytes
    files.write_parquet(spark.read.parquet(f"{d}/supplier.parquet"), path)
    return files.read_table(spark, path)


@query("S5_store_roundtrip", "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders")
def s5(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    columns = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]
    return files.read_table(
        spark, files.write_table(orders.select(columns), scratch(spark, "store") + ".parquet")
    )


@query(
    "S6_csv_store",
    "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, r_name "
    "FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def s6(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    region = spark.read.parquet(f"{d}/region.parquet")
    table = nation.join(region, F.expr("n_regionkey = r_regionkey"))
    target = files.write_table(
        table.select("n_nationkey", "n_name", "r_name"), scratch(spark, "store"), fmt="csv"
    )
    return files.read_table(spark, target)


FORMULA = "CASE e_mod WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' ELSE '' END"


@query(
    "S7_csv_sink",
    f"""SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN e_mod < 4 THEN '''' ELSE '' END
      || {FORMULA} || event_type AS note FROM (SELECT *, event_id % 5 AS e_mod FROM events)""",
)
def s7(spark, d):
    path = scratch(spark, "sink")
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("e_mod", F.expr("event_id % 5"))
    noted = events.withColumn("note", F.expr(f"concat({FORMULA}, event_type)"))
    files.write_csv(noted, path, ["event_id", "note"])
    return files.read_csv(spark, path)


@query("S8_parquet_sink", "SELECT user_id, ts, value FROM events")
def s8(spark, d):
    path = scratch(spark, "sink")
    files.write_parquet(spark.read.parquet(f"{d}/events.parquet"), path, ["user_id", "ts", "value"])
    return spark.read.parquet(path)


@query(
    "S10_conform",
    sql(
        RAW,
        f"""SELECT regexp_replace(trim(customer_id), '\\.0+$', '') AS customer_id, invoice_no,
        TRY_CAST(invoice_date AS TIMESTAMP) AS invoice_date, {number_sql('quantity')} AS quantity,
        {number_sql('unit_price')} AS unit_price, country FROM raw""",
    ),
)
def s10(spark, d):
    return conform_transactions(raw_lines(spark, d))


# ---------------------------------------------------------------- cleaning


@query("C1_canonical_columns", sql(RAW, "SELECT * FROM raw"))
def c1(spark, d):
    return select_canonical(raw_lines(spark, d))


@query(
    "C2_duplicate_rows",
    sql(
        RAW,
        """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM (
        SELECT count(*) AS n FROM raw GROUP BY ALL HAVING count(*) > 1)""".replace(
            "SELECT count(*) AS n FROM raw GROUP BY ALL",
            "SELECT customer_id, invoice_no, invoice_date, quantity, unit_price, country, "
            "count(*) AS n FROM raw GROUP BY ALL",
        ),
    ),
)
def c2(spark, d):
    return cleaning.duplicate_row_count(select_canonical(raw_lines(spark, d)))


@query(
    "C3_missing_customer",
    sql(
        RAW,
        f"""SELECT customer_id, customer_id IS NULL OR lower(trim(customer_id)) IN {MISSING}
        AS missing, count(*) AS n FROM raw GROUP BY ALL""",
    ),
)
def c3(spark, d):
    raw = select_canonical(raw_lines(spark, d))
    missing = is_missing(F.col("customer_id"), raw.schema["customer_id"].dataType)
    return raw.groupBy("customer_id", missing.alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "C4_normalize_ids",
    sql(
        RAW,
        r"""SELECT customer_id AS raw_id, coalesce(regexp_replace(trim(customer_id), '\.0+$', ''), '')
        AS customer_id, count(*) AS n FROM raw GROUP BY ALL""",
    ),
)
def c4(spark, d):
    raw = select_canonical(raw_lines(spark, d))
    cleaned = clean_id(F.col("customer_id"), raw.schema["customer_id"].dataType)
    return raw.groupBy(F.col("customer_id").alias("raw_id"), cleaned.alias("customer_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "C5_parse_numbers",
    sql(
        RAW,
        f"""SELECT quantity AS raw_quantity, unit_price AS raw_price, {number_sql('quantity')} AS quantity,
        {number_sql('unit_price')} AS unit_price, count(*) AS n FROM raw GROUP BY ALL""",
    ),
)
def c5(spark, d):
    raw = select_canonical(raw_lines(spark, d))
    text = raw.schema["quantity"].dataType
    return raw.groupBy(
        F.col("quantity").alias("raw_quantity"),
        F.col("unit_price").alias("raw_price"),
        clean_number(F.col("quantity"), text).alias("quantity"),
        clean_number(F.col("unit_price"), text).alias("unit_price"),
    ).agg(F.count(F.lit(1)).alias("n"))


def removal_query(name: str, reason: str, policy: str) -> None:
    chosen = CleaningPolicy(policy)

    @query(
        name,
        sql(
            *MARKED[policy],
            f"""SELECT customer_id, invoice_no, invoice_date, quantity, unit_price, country
            FROM marked WHERE removal_reason = '{reason}'""",
        ),
    )
    def removed(spark, d):
        marked = cleaning.annotate_transactions(select_canonical(raw_lines(spark, d)), chosen)
        return marked.where(F.col("removal_reason") == reason).drop("removal_reason")


removal_query("C6_cancelled_gross", "cancelled", "gross")
removal_query("C6_cancelled_net", "cancelled", "net")
removal_query("C7_missing_invoice", "missing_invoice", "gross")
removal_query("C8_quantity_gross", "non_positive_qty", "gross")
removal_query("C8_quantity_net", "non_positive_qty", "net")
removal_query("C9_price", "non_positive_price", "gross")
removal_query("C10_invalid_date", "invalid_date", "gross")

# Ten ways to write a date, dealt out by order; layouts with a clock get a time of day.
LAYOUTS = [
    "M/d/yyyy h:mm a", "dd/MM/yyyy", "MM-dd-yyyy HH:mm", "yyyyMMdd", "yyyy.MM.dd", "MMM d, yyyy", "MMMM d yyyy HH:mm:ss",
    "dd-MMM-yyyy HH:mm", "M/d/yy H:mm", "yyyy/M/d",
]
DAY_FIRST = 1  # this layout is read with the day first


@query(
    "C10_date_layouts",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN ({', '.join(str(i) for i, x in enumerate(LAYOUTS) if 'm' in x)})
      THEN date_trunc('day', o_orderdate) + to_minutes(CAST(o_orderkey % 1440 AS INTEGER))
      ELSE date_trunc('day', o_orderdate) END AS written
    FROM orders""",
)
def c10_layouts(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "o_orderkey",
        "cast(date_trunc('day', o_orderdate) AS timestamp) + make_interval(0, 0, 0, 0, 0, o_orderkey % 1440) AS t",
    )
    number = F.col("o_orderkey") % 10
    text = F.coalesce(*[F.when(number == i, F.date_format("t", layout)) for i, layout in enumerate(LAYOUTS)])
    read = F.when(number == DAY_FIRST, parse_date(text, T.StringType(), day_first=True)).otherwise(
        parse_date(text, T.StringType())
    )
    return orders.select("o_orderkey", read.alias("written"))

KEPT = """kept AS (SELECT * EXCLUDE (removal_reason), quantity * unit_price AS total,
  quantity * unit_price < 0 OR upper(invoice_no) LIKE 'C%' AS is_refund
  FROM marked WHERE removal_reason IS NULL)"""


@query(
    "C11_deduplicated",
    sql(*MARKED["gross"], KEPT, "SELECT DISTINCT * EXCLUDE (total) FROM kept"),
)
def c11(spark, d):
    return cleaning.clean_transactions(raw_lines(spark, d), remove_duplicates=True)[0]


@query("C12_refund_flag", sql(*MARKED["net"], KEPT, "SELECT * EXCLUDE (total) FROM kept"))
def c12(spark, d):
    return cleaning.clean_transactions(raw_lines(spark, d), policy=NET_POLICY)[0]


def report_sql(policy: str, dedupe: bool = False) -> str:
    revenue = "pos - neg" if policy == "net" else "pos"
    removed = ", ".join(
        f"count(*) FILTER (removal_reason = '{r}') AS rows_removed_{r}"
        for r in cleaning.REMOVAL_REASONS
    )
    source = "(SELECT DISTINCT * FROM kept)" if dedupe else "kept"
    return sql(
        *MARKED[policy],
        KEPT,
        f"before AS (SELECT count(*) AS total_rows_before, {removed} FROM marked)",
        """dups AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows_detected FROM (
          SELECT customer_id, invoice_no, invoice_date, quantity, unit_price, country, count(*) AS n
          FROM raw GROUP BY ALL HAVING count(*) > 1))""",
        f"""after AS (SELECT count(*) AS total_rows_after, count(DISTINCT customer_id) AS total_customers,
          strftime(min(invoice_date), '%Y-%m-%d') AS date_min,
          strftime(max(invoice_date), '%Y-%m-%d') AS date_max,
          coalesce(sum(total) FILTER (total > 0), 0) AS pos,
          coalesce(-sum(total) FILTER (total < 0), 0) AS neg,
          count(*) FILTER (total < 0) AS refund_count FROM {source})""",
        f"""SELECT before.*, dups.*, total_rows_after, total_customers, date_min, date_max,
          {r(revenue, 2)} AS total_revenue, {str(dedupe).lower()} AS duplicates_removed,
          '{policy}' AS policy_type, {r('pos', 2)} AS gross_revenue, {r('neg', 2)} AS refund_amount,
          refund_count, CASE WHEN pos > 0 THEN {r('neg / pos * 100', 2)} ELSE 0 END AS refund_rate_pct,
          total_rows_before - total_rows_after AS total_rows_removed,
          {r('total_rows_after / total_rows_before * 100', 2)} AS retention_percentage
          FROM before, dups, after""",
    )


@query("C13_report_gross", report_sql("gross"))
def c13_gross(spark, d):
    return cleaning.cleaning_report(select_canonical(raw_lines(spark, d)))


@query("C13_report_net", report_sql("net"))
def c13_net(spark, d):
    return cleaning.cleaning_report(select_canonical(raw_lines(spark, d)), NET_POLICY)


@query("C13_report_deduplicated", report_sql("net", dedupe=True))
def c13_dedupe(spark, d):
    return cleaning.cleaning_report(
        select_canonical(raw_lines(spark, d)), CleaningPolicy("net", remove_duplicates=True)
    )


@query(
    "C14_clean_in_date_order",
    sql(*MARKED["gross"], KEPT, "SELECT * EXCLUDE (total) FROM kept ORDER BY invoice_date"),
)
def c14(spark, d):
    return cleaning.clean_transactions(raw_lines(spark, d))[0].orderBy("invoice_date")


@query(
    "C14_ordered_sink",
    sql(
        *MARKED["gross"], KEPT,
        "SELECT row_number() OVER (ORDER BY invoice_date) - 1 AS position, invoice_date FROM kept",
    ),
)
def c14_sink(spark, d):
    """Clean rows written in date order, and the date at each place of the files."""
    clean = cleaning.clean_transactions(raw_lines(spark, d))[0]
    uri = files.write_table(clean, scratch(spark, "ordered") + ".parquet", order_by=["invoice_date"])
    return files.with_positions(spark, uri).select("position", "invoice_date")


@query(
    "C15_removal_breakdown",
    sql(
        *MARKED["gross"],
        "labels AS (SELECT * FROM (VALUES "
        + ", ".join(
            "('{}', '{}')".format(r, label.replace("'", "''"))
            for r, label in cleaning.REMOVAL_REASONS.items()
        )
        + ") AS t(r, reason))",
        """dups AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (
          SELECT customer_id, invoice_no, invoice_date, quantity, unit_price, country, count(*) AS n
          FROM raw GROUP BY ALL HAVING count(*) > 1))""",
        """SELECT reason, (SELECT count(*) FROM marked WHERE removal_reason = r) AS rows_filtered FROM labels
          UNION ALL SELECT 'Redundant duplicate copies', CASE WHEN n >= 2 THEN n // 2 ELSE n END FROM dups""",
    ),
)
def c15(spark, d):
    report = cleaning.cleaning_report(select_canonical(raw_lines(spark, d)))
    return cleaning.removal_breakdown(report)


# ---------------------------------------------------------------- reconciliation

SIGNED = """ev AS (SELECT *, quantity < 0 OR upper(invoice_no) LIKE 'C%' AS rev,
  CAST(round(abs(quantity) * 1000000) AS BIGINT) AS u, lower(trim({item})) AS item FROM {source})"""
# One window per (customer, item): a purchase has lost the drop from its height to the lowest height
# within the lookback; a return finds what lies above the lowest purchase base within the lookback.
STACK = """heights AS (SELECT *, sum(CASE WHEN rev THEN -u ELSE u END) OVER (PARTITION BY customer_id, item
    ORDER BY invoice_date, rev, invoice_no, {tie}unit_price, u ROWS UNBOUNDED PRECEDING) AS s FROM ev),
marks AS (SELECT *,
    min(CASE WHEN rev THEN s END) OVER (PARTITION BY customer_id, item ORDER BY invoice_date
      RANGE BETWEEN CURRENT ROW AND INTERVAL {days} DAYS FOLLOWING) AS low,
    min(CASE WHEN NOT rev THEN s - u END) OVER (PARTITION BY customer_id, item ORDER BY invoice_date
      RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND CURRENT ROW) AS base FROM heights),
ledger AS (SELECT *, CASE WHEN NOT rev THEN (u - least(greatest(coalesce(s - low, 0), 0), u)) / 1000000 END
      AS net_quantity,
    CASE WHEN rev THEN coalesce(s + u - base, 0) > 0 ELSE coalesce(s - low, 0) > 0 END AS is_reconciled,
    quantity * unit_price AS raw_line_total FROM marks)"""
LEDGER_COLUMNS = f"""customer_id, invoice_no, invoice_date, quantity, unit_price, description,
  {r('raw_line_total', 2)} AS raw_line_total, CAST(net_quantity AS DOUBLE) AS net_quantity,
  {r('CASE WHEN NOT rev THEN greatest(0, raw_line_total - (quantity - net_quantity) * unit_price) END', 2)}
    AS net_amount, is_reconciled"""


def ledger_sql(days: int, last: str, item: str = "description") -> str:
    return sql(TX, NET, SIGNED.format(item=item, source="net"), STACK.format(days=days, tie=""), last)


def ledger(spark, d, days: int = 180, item: str | None = "description"):
    lines = net(spark, d, description=True).drop("is_refund")
    return reconcile.reconciliation_ledger(lines, days, item)


def two_digits(df):
    return df.withColumns({c: round_to(F.col(c), 2) for c in ("raw_line_total", "net_amount")})


@query(
    "R1_split",
    sql(
        TX,
        """SELECT quantity < 0 OR upper(invoice_no) LIKE 'C%' AS is_reversal, count(*) AS n,
        CAST(sum(quantity) AS DOUBLE) AS units FROM tx GROUP BY 1""",
    ),
)
def r1(spark, d):
    ledger_rows = reconcile.reconciliation_ledger(tx(spark, d, description=True))
    return ledger_rows.groupBy("is_reversal").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("units")
    )


@query("R2_ledger", ledger_sql(180, f"SELECT {LEDGER_COLUMNS}, rev AS is_reversal FROM ledger"))
def r2(spark, d):
    return two_digits(ledger(spark, d))


@query(
    "R2_ledger_by_customer",
    ledger_sql(30, f"SELECT {LEDGER_COLUMNS}, rev AS is_reversal FROM ledger", item="'any'"),
)
def r2_customer(spark, d):
    return two_digits(ledger(spark, d, 30, None))


@query(
    "R3_settled_purchases",
    ledger_sql(180, f"SELECT {LEDGER_COLUMNS} FROM ledger WHERE NOT rev AND net_quantity > 0"),
)
def r3(spark, d):
    return two_digits(reconcile.settled_purchases(ledger(spark, d)))


REPORT = f"""SELECT count(*) AS total_raw_records, count(*) FILTER (NOT rev) AS purchase_records,
  count(*) FILTER (rev) AS reversal_records, count(*) FILTER (rev AND is_reconciled) AS matched_reversals,
  count(*) FILTER (rev AND NOT is_reconciled) AS unmatched_reversals,
  {r('sum(raw_line_total) FILTER (NOT rev)', 2)} AS gross_revenue,
  {r('sum(raw_line_total - (quantity - net_quantity) * unit_price) FILTER (NOT rev AND net_quantity > 0)', 2)}
    AS net_settled_revenue,
  {r('count(*) FILTER (rev AND is_reconciled) / count(*) FILTER (rev) * 100', 2)}
    AS reconciliation_rate_pct FROM ledger"""


@query("R4_report", ledger_sql(180, REPORT))
def r4(spark, d):
    return reconcile.reconciliation_report(ledger(spark, d))


# The checksum's byte table, then one step of it for each byte.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(
    list_concat([i::UBIGINT], list_resize([]::UBIGINT[], 8, 0)),
    lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)) AS crcs)"""


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII text, next to ``crc_table``."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::UBIGINT)"
    steps = f"list_reduce(list_prepend(4294967295::UBIGINT, {codes}), "
    return f"xor({steps} lambda c, b: xor(c // 256, crcs[(xor(c % 256, b) + 1)::INT])), 4294967295::UBIGINT)"


# Each customer's lines one after the other, with the list of open purchases: the rule itself, without stacks or slabs.
WALK = """steps AS (SELECT *, row_number() OVER (PARTITION BY customer_id
    ORDER BY invoice_date, rev, invoice_no, item, unit_price, u) AS step FROM ev),
walk AS (
  SELECT DISTINCT customer_id, 0::BIGINT AS step, false AS found,
    []::STRUCT(k BIGINT, item VARCHAR, d TIMESTAMP, u BIGINT)[] AS open FROM ev
  UNION ALL
  SELECT s.customer_id, s.step,
    s.rev AND len(list_filter(w.open, lambda x: x.d >= s.invoice_date - INTERVAL 180 DAYS AND s.item IN ('', x.item))) > 0,
    CASE WHEN NOT s.rev THEN list_append(w.open, {'k': s.step, 'item': s.item, 'd': s.invoice_date, 'u': s.u})
    ELSE list_filter(list_transform(w.open, lambda x, i: {'k': x.k, 'item': x.item, 'd': x.d, 'u': x.u - CASE
        WHEN x.d >= s.invoice_date - INTERVAL 180 DAYS AND s.item IN ('', x.item) THEN greatest(0, least(x.u, s.u
          - coalesce(list_sum(list_transform(w.open[i + 1:], lambda y: CASE
              WHEN y.d >= s.invoice_date - INTERVAL 180 DAYS AND s.item IN ('', y.item) THEN y.u ELSE 0 END)), 0)))
        ELSE 0 END}), lambda x: x.u > 0) END
  FROM walk w JOIN steps s ON s.customer_id = w.customer_id AND s.step = w.step + 1),
ends AS (SELECT customer_id, unnest(max_by(open, step), recursive := true) FROM walk GROUP BY customer_id),
ledger AS (
  SELECT s.*, s.quantity * s.unit_price AS raw_line_total,
    CASE WHEN NOT rev THEN coalesce(e.u, 0) / 1000000 END AS net_quantity,
    CASE WHEN rev THEN w.found ELSE coalesce(e.u, 0) < s.u END AS is_reconciled
  FROM steps s JOIN walk w USING (customer_id, step) LEFT JOIN ends e ON e.customer_id = s.customer_id AND e.k = s.step)"""


def blank_returns_sql(last: str) -> str:
    unnamed = f"""unnamed AS (SELECT * EXCLUDE (crcs) REPLACE (CASE WHEN invoice_no LIKE 'C%' AND
      {crc32_sql('invoice_no')} % 7 = 0 THEN '' ELSE description END AS description) FROM net, crc_table)"""
    parts = sql(TX, NET, CRC_TABLE, unnamed, SIGNED.format(item="description", source="unnamed"), WALK, last)
    return parts.replace("WITH ", "WITH RECURSIVE ", 1)


def blank_returns(spark, d):
    """Every seventh credit note names no item and so takes back any item of the customer."""
    blank = F.col("invoice_no").startswith("C") & (F.crc32("invoice_no") % 7 == 0)
    lines = net(spark, d, description=True).drop("is_refund")
    return lines.withColumn("description", F.when(blank, "").otherwise(F.col("description")))


@query(
    "R2_blank_item_ledger",
    blank_returns_sql(f"SELECT {LEDGER_COLUMNS}, rev AS is_reversal FROM ledger"),
)
def r2_blank_ledger(spark, d):
    return two_digits(reconcile.reconciliation_ledger(blank_returns(spark, d)))


@query("R2_blank_item_returns", blank_returns_sql(REPORT))
def r2_blank(spark, d):
    return reconcile.reconciliation_report(reconcile.reconciliation_ledger(blank_returns(spark, d)))


# Credit notes of every seventh customer name no item; those of customer 14 have no customer either.
UNNAMED = """unnamed AS (SELECT * REPLACE (CASE WHEN CAST(customer_id AS BIGINT) % 7 = 0 AND quantity < 0 THEN ''
    ELSE description END AS description, nullif(customer_id, '14') AS customer_id) FROM net)"""


@query(
    "R2_blank_customers",
    sql(
        TX, NET, UNNAMED,
        SIGNED.format(
            item="CASE WHEN customer_id IS NULL OR CAST(customer_id AS BIGINT) % 7 = 0 THEN '*' ELSE description END",
            source="unnamed",
        ),
        STACK.format(days=180, tie="lower(trim(description)), "),
        f"SELECT {LEDGER_COLUMNS}, rev AS is_reversal FROM ledger",
    ),
)
def r2_blank_customers(spark, d):
    lines = net(spark, d, description=True).drop("is_refund")
    unnamed = F.expr("try_cast(customer_id AS bigint) % 7 = 0 AND quantity < 0")
    lines = lines.withColumns(
        {
            "description": F.when(unnamed, "").otherwise(F.col("description")),
            "customer_id": F.nullif(F.col("customer_id"), F.lit("14")),
        }
    )
    return two_digits(reconcile.reconciliation_ledger(lines))


@query("R2_ledger_split_by_day", ledger_sql(180, f"SELECT {LEDGER_COLUMNS}, rev AS is_reversal FROM ledger"))
def r2_by_day(spark, d):
    """The same settlement with every customer treated as one that needs splitting."""
    lines = net(spark, d, description=True).drop("is_refund")
    return two_digits(reconcile.reconciliation_ledger(lines, by_day=True))

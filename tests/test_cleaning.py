from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.text import parse_date
from patronage.operators.cleaning import (
    CleaningPolicy,
    annotate_transactions,
    clean_transactions,
    duplicate_row_count,
    removal_breakdown,
)
from patronage.streaming.stateless import clean_stream
from tests.conftest import one

RAW = "InvoiceNo string, InvoiceDate string, CustomerID double, Quantity int, UnitPrice double, Country string"
TEXT = "customer_id string, invoice_no string, invoice_date string, quantity string, unit_price string"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(
        [
            ("101", "2023-01-10 10:00:00", 1001.0, 2, 10.0, "UK"),
            ("101", "2023-01-10 10:00:00", 1001.0, 1, 5.0, "UK"),
            ("102", "2023-03-15 14:30:00", 1001.0, 3, 20.0, "UK"),
            ("103", "2023-01-05 09:00:00", 1002.0, 1, 100.0, "Germany"),
            ("C104", "2023-02-01 11:00:00", 1001.0, -2, 10.0, "UK"),
            ("105", "2023-02-05 12:00:00", None, 1, 15.0, "UK"),
            ("106", "2023-02-10 13:00:00", 1002.0, -1, 50.0, "Germany"),
            ("107", "2023-02-15 14:00:00", 1001.0, 5, 0.0, "UK"),
            ("101", "2023-01-10 10:00:00", 1001.0, 2, 10.0, "UK"),
        ],
        RAW,
    )


def text_rows(spark, rows):
    return spark.createDataFrame(rows, TEXT)


def test_gross_report(raw):
    clean, report = clean_transactions(raw)
    r = one(report)
    assert clean.count() == r["total_rows_after"] == 5
    assert (r["total_rows_before"], r["total_customers"], r["total_revenue"]) == (9, 2, 205.0)
    reasons = ["missing_customer", "cancelled", "non_positive_qty", "non_positive_price"]
    assert [r[f"rows_removed_{x}"] for x in reasons] == [1, 1, 1, 1]
    assert (r["rows_removed_missing_invoice"], r["rows_removed_invalid_date"]) == (0, 0)
    assert (r["duplicate_rows_detected"], r["duplicates_removed"]) == (2, False)
    assert (r["date_min"], r["date_max"]) == ("2023-01-05", "2023-03-15")
    assert (r["total_rows_removed"], r["retention_percentage"]) == (4, 55.56)


def test_deduplication(raw):
    clean, report = clean_transactions(raw, remove_duplicates=True)
    r = one(report)
    assert clean.count() == r["total_rows_after"] == 4
    assert (r["total_revenue"], r["duplicates_removed"]) == (185.0, True)


def test_nothing_is_deduplicated_when_raw_rows_differ(spark):
    rows = [("1", "10", "2023-01-01", "2", "5"), ("1", "10", "2023-01-01", " 2 ", "5")]
    clean, report = clean_transactions(text_rows(spark, rows), remove_duplicates=True)
    assert clean.count() == one(report)["total_rows_after"] == 2


def test_duplicate_count_has_every_copy(raw):
    assert one(duplicate_row_count(raw))["duplicate_rows"] == 2


def test_currency_and_accounting_text(spark):
    rows = [
        ("1", "10", "2023-01-01", " 2 ", "$10.50"),
        ("2", "11", "2023-01-02", "1,000", "£2.50"),
        ("3", "12", "2023-01-03", "(2)", "5"),
        ("4", "13", "2023-01-04", "1", "($15.00)"),
        ("5", "14", "2023-01-05", "--5", "1"),
        ("6", "15", "2023-01-05", "1.2.3", "1"),
    ]
    r = one(clean_transactions(text_rows(spark, rows))[1])
    assert (r["total_rows_after"], r["total_revenue"]) == (2, 2521.0)
    assert (r["rows_removed_non_positive_qty"], r["rows_removed_non_positive_price"]) == (3, 1)


def test_ids_stay_distinct(spark):
    ids = ["00123", "123", "00123.0", "1E5", "100000", "0", "CUST-999"]
    rows = [(i, "10", "2023-01-01", "1", "1") for i in ids]
    clean, report = clean_transactions(text_rows(spark, rows))
    found = {x["customer_id"] for x in clean.collect()}
    assert found == {"00123", "123", "1E5", "100000", "0", "CUST-999"}
    assert one(report)["rows_removed_missing_customer"] == 0


def test_float_ids_lose_their_point(raw):
    assert {x["customer_id"] for x in clean_transactions(raw)[0].collect()} == {"1001", "1002"}


@pytest.mark.parametrize("invoice", [None, "   ", "nan", "None", "NULL", "0"])
def test_placeholder_invoices_go(spark, invoice):
    rows = [("1", invoice, "2023-01-01", "1", "1"), ("1", "10", "2023-01-01", "1", "1")]
    assert one(clean_transactions(text_rows(spark, rows))[1])["rows_removed_missing_invoice"] == 1


@pytest.mark.parametrize("customer", [None, "", " NaN ", "none", "NULL"])
def test_missing_customers_go(spark, customer):
    rows = [(customer, "10", "2023-01-01", "1", "1"), ("1", "10", "2023-01-01", "1", "1")]
    assert one(clean_transactions(text_rows(spark, rows))[1])["rows_removed_missing_customer"] == 1


def test_bad_dates_go_and_known_layouts_stay(spark):
    rows = [
        ("1", "10", "2023-02-30", "1", "1"),
        ("1", "10", "junk", "1", "1"),
        ("1", "10", "12/1/2010 8:26", "1", "1"),
        ("1", "10", "2023-01-01T05:00:00Z", "1", "1"),
        ("1", "10", "2023-01-01", "1", "1"),
    ]
    clean, report = clean_transactions(text_rows(spark, rows))
    assert one(report)["rows_removed_invalid_date"] == 2
    dates = sorted(str(x["invoice_date"]) for x in clean.collect())
    assert dates == ["2010-12-01 08:26:00", "2023-01-01 00:00:00", "2023-01-01 05:00:00"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_date_layouts(spark, zone):
    same = ["12/31/2010 8:26 PM", "31/12/2010 20:26", "31-12-2010 20:26:00", "2010.12.31 20:26", "Dec 31, 2010 8:26pm",
            "December 31 2010 20:26", "31-Dec-2010 20:26", "12/31/10 20:26", "2010-12-31T20:26:00Z", " 2010/12/31 20:26 "]
    cases = {text: "2010-12-31 20:26:00" for text in same} | {
        "20101231": "2010-12-31 00:00:00", "2/1/2011": "2011-02-01 00:00:00", "3/10/2024 2:30": "2024-03-10 02:30:00",
        "12/1/1999 12:05 a.m.": "1999-12-01 00:05:00", "13/13/2010": None, "31/2/2011": None, "12/1/2010 25:00": None,
        "1 Foo 2010": None, "1.2.3": None, "": None}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in cases], "t string")
        parsed = df.select("t", parse_date(F.col("t"), T.StringType()).cast("string").alias("d"),
                           parse_date(F.col("t"), T.StringType(), day_first=True).cast("string").alias("e")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {r["t"]: r["d"] for r in parsed} == cases
    swapped = {r["t"]: r["e"] for r in parsed if r["e"] != r["d"]}
    assert swapped == {"2/1/2011": "2011-01-02 00:00:00", "3/10/2024 2:30": "2024-10-03 02:30:00",
                       "12/1/1999 12:05 a.m.": "1999-01-12 00:05:00"}


def test_day_first_policy(spark):
    rows = [("1", "1", "2/1/2011", "1", "1")]
    for day_first, month in ((False, "2011-02-01"), (True, "2011-01-02")):
        clean, report = clean_transactions(text_rows(spark, rows), policy=CleaningPolicy(day_first=day_first))
        assert one(report)["date_min"] == month and str(one(clean)["invoice_date"])[:10] == month


def test_tiny_amounts_add_up(spark):
    rows = [("1", str(i), "2023-01-01", "1", "0.00004") for i in range(1000)]
    assert one(clean_transactions(text_rows(spark, rows))[1])["total_revenue"] == 0.04


def test_net_policy_keeps_refunds(spark):
    rows = [
        ("1001", "1", "2023-01-01", "2", "10"),
        ("1001", "C1002", "2023-01-02", "-1", "10"),
        ("1001", "C1004", "2023-01-02", "1", "10"),
        ("1003", "2", "2023-01-03", "5", "20"),
    ]
    clean, report = clean_transactions(text_rows(spark, rows), policy=CleaningPolicy("net"))
    r = one(report)
    assert (r["total_rows_after"], r["rows_removed_cancelled"], r["refund_count"]) == (3, 1, 1)
    figures = [r[c] for c in ("refund_amount", "gross_revenue", "total_revenue", "refund_rate_pct")]
    assert figures == [10.0, 120.0, 110.0, 8.33]
    assert {x["invoice_no"]: x["is_refund"] for x in clean.collect()} == {
        "1": False, "C1002": True, "2": False,
    }


def test_all_removed_gives_zeros(spark):
    r = one(clean_transactions(text_rows(spark, [(None, "1", "2023-01-01", "1", "1")]))[1])
    assert (r["total_rows_after"], r["total_revenue"], r["date_min"]) == (0, 0.0, None)


def test_breakdown_lists_reasons_and_copies(raw):
    rows = {r["reason"]: r["rows_filtered"] for r in removal_breakdown(clean_transactions(raw)[1]).collect()}
    assert len(rows) == 7 and sum(rows.values()) == 5
    assert rows["Redundant duplicate copies"] == 1


def test_reasons_and_kept_rows_agree(spark, sf):
    from catalog.inputs import raw_lines
    from patronage.sources.conform import select_canonical

    raw = select_canonical(raw_lines(spark, sf))
    for policy in (CleaningPolicy(), CleaningPolicy("net")):
        kept = annotate_transactions(raw, policy).where("removal_reason is null").count()
        assert kept == clean_transactions(raw, policy=policy)[0].count()


def test_filters_reach_the_scans(spark, sf):
    from catalog.inputs import gross

    plan = gross(spark, sf)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert any("l_quantity" in line and "l_discount" not in line for line in scans)
    below_join = plan[plan.index("Join") :]
    assert below_join.count("RLIKE") >= 3  # customer, cancellation and invoice rules


def test_unknown_policy():
    with pytest.raises(ValueError):
        CleaningPolicy("other")


def test_stream_is_cleaned_like_a_table(spark, tmp_path):
    rows = [("1", "10", "2023-01-01", "2", "5"), ("", "11", "2023-01-01", "2", "5"), ("2", "C1", "2023-01-01", "1", "5")]
    text_rows(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TEXT).parquet(str(tmp_path / "in"))
    query = (
        clean_stream(stream).writeStream.format("memory").queryName("cleaned")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    query.processAllAvailable()
    query.stop()
    assert [r["customer_id"] for r in spark.table("cleaned").collect()] == ["1"]
    with pytest.raises(ValueError):
        clean_stream(stream, policy=CleaningPolicy(remove_duplicates=True))


def test_copies_in_a_stream_go_within_the_bound(spark, tmp_path):
    """A copy in the same batch and one within the watermark go; what is later than the watermark is dropped as late."""
    row = ("1", "10", "2023-01-05", "2", "5")
    batches = [
        [row, row, ("2", "11", "2023-01-05", "1", "5")],
        [row, ("3", "12", "2023-01-06", "1", "5")],
        [("4", "13", "2023-02-01", "1", "5")],
        [row, ("5", "14", "2023-02-01", "1", "5"), ("4", "13", "2023-02-01", "1", "5")],
    ]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(TEXT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    policy = CleaningPolicy(remove_duplicates=True)
    for i, rows in enumerate(batches):
        text_rows(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = (
            clean_stream(stream, policy=policy, watermark="3 days").writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        )
        query.processAllAvailable()
        query.stop()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["customer_id"] for r in found.collect()) == ["1", "2", "3", "4", "5"]
    assert "_instant" not in found.columns

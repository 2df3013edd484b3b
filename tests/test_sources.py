from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from patronage.schema import COLUMN_ALIASES
from patronage.sources import files
from patronage.sources.conform import (
    conform_transactions,
    map_columns,
    mapping_issues,
    select_canonical,
)


def test_csv_keeps_leading_zeros(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("CustomerID,InvoiceNo,InvoiceDate,Quantity,UnitPrice\n00123,000536,2023-01-01,2,10.5\n")
    table = files.read_csv(spark, str(path))
    assert table.first().asDict() == {
        "CustomerID": "00123", "InvoiceNo": "000536", "InvoiceDate": "2023-01-01",
        "Quantity": "2", "UnitPrice": "10.5",
    }


def test_csv_encodings_are_told_apart_per_file(spark, tmp_path):
    folder = tmp_path / "mixed files"
    folder.mkdir()
    (folder / "u.csv").write_bytes("id,Description\n1,Café\n".encode("utf-8"))
    (folder / "l.csv").write_bytes("id,Description\n2,Café\n".encode("latin-1"))
    rows = files.read_csv(spark, str(folder)).collect()
    assert {(r["id"], r["Description"]) for r in rows} == {("1", "Café"), ("2", "Café")}


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CustomerID,InvoiceNo\nc1,i1\nc2,i2\n")
    (tmp_path / "b.csv").write_text("InvoiceNo,CustomerID,Note\ni3,c3,x\n")
    (tmp_path / "c.csv").write_bytes("\nInvoiceNo,CustomerID\ni4,\xe9\n".encode("latin-1"))
    (tmp_path / "d.csv").write_text("")
    rows = files.read_csv(spark, str(tmp_path)).collect()
    assert {(r["CustomerID"], r["InvoiceNo"], r["Note"]) for r in rows} == {
        ("c1", "i1", None), ("c2", "i2", None), ("c3", "i3", "x"), ("é", "i4", None)}
    (tmp_path / "c.csv").unlink()
    (tmp_path / "d.csv").unlink()
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path), encoding="UTF-8").collect()


def test_csv_cells_are_read_as_spark_reads_them(spark, tmp_path):
    """Quotes, blanks, empty and missing cells, byte-order marks, odd headers: as the reader for one header gives them."""
    text = (
        '\ufeffid,"name, full",Note,note,\n1,"a ""b"" c",,x,\n2,"",  spaced  ,,z\n\n3,only\n4,"é, ü",ok,"q",last,too many\n'
        '5,plain,end\r\n'
    )
    (tmp_path / "a.csv").write_bytes(text.encode("utf-8"))
    reader = spark.read.option("header", True).option("escape", '"')
    expected = reader.csv(str(tmp_path / "a.csv"))
    found = files.read_csv(spark, str(tmp_path))
    assert [c.lower() for c in found.columns] == [c.lower() for c in expected.columns]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_a_file_of_many_parts_keeps_one_encoding(spark, tmp_path):
    """A Latin-1 byte near the end decides for the whole file, however many tasks read it."""
    head = "id,name\n" + "".join(f"{i},plain name {i}\n" for i in range(3000))
    (tmp_path / "l.csv").write_bytes((head + "9999,Caf\xe9 Â£\n").encode("latin-1"))
    (tmp_path / "u.csv").write_bytes(("name,id\n" + "".join(f"Café {i},{i}\n" for i in range(3000))).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = {(r["id"], r["name"]) for r in files.read_csv(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 6001 and ("9999", "Café Â£") in rows and ("7", "Café 7") in rows and ("7", "plain name 7") in rows


def test_a_mixture_of_formats_is_refused(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "a.csv").write_text("id\n1\n")
    with pytest.raises(Exception, match="Parquet|parquet"):
        files.read_table(spark, str(tmp_path / "t")).collect()


def test_empty_csv_is_refused(spark, tmp_path):
    empty, header = tmp_path / "e.csv", tmp_path / "h.csv"
    empty.write_bytes(b"")
    header.write_text("a,b\n")
    with pytest.raises(ValueError, match="empty"):
        files.read_csv(spark, str(empty))
    with pytest.raises(ValueError, match="no data rows"):
        files.read_csv(spark, str(header))


def test_headers_map_to_canonical_names():
    mapping = map_columns(["cust_id", "order_id", "created_at", "qty", "item_price", "region"])
    assert mapping == {
        "customer_id": "cust_id", "invoice_no": "order_id", "invoice_date": "created_at",
        "quantity": "qty", "unit_price": "item_price", "country": "region", "description": None,
    }
    assert mapping_issues(mapping) == []


def test_mapping_issues_name_missing_and_doubled_headers():
    mapping = {c: c for c in COLUMN_ALIASES}
    mapping["customer_id"] = None
    mapping["quantity"] = None
    assert mapping_issues(mapping) == ["customer_id", "quantity"]
    doubled = {c: c for c in COLUMN_ALIASES} | {"unit_price": "quantity"}
    assert len(mapping_issues(doubled)) == 1 and "quantity" in mapping_issues(doubled)[0]


def test_each_header_is_used_once():
    mapping = map_columns(["Amount", "Customer", "Invoice", "Date", "Units"])
    assert mapping["unit_price"] == "Amount" and mapping["customer_id"] == "Customer"
    assert len([v for v in mapping.values() if v]) == len({v for v in mapping.values() if v})


def test_unusable_mapping_raises(spark):
    df = spark.createDataFrame([("1", "2")], "customer_id string, qty string")
    with pytest.raises(ValueError, match="invoice_no"):
        select_canonical(df)


def test_conform_types(spark):
    raw = spark.createDataFrame(
        [("1001.0", "536", "2023-01-02 03:04:05", "(2)", "$1,000.50"), (None, "5", "x", "?", "")],
        "CustomerID string, InvoiceNo string, InvoiceDate string, Quantity string, UnitPrice string",
    )
    good, bad = conform_transactions(raw).orderBy("invoice_no", ascending=False).collect()
    assert (good["customer_id"], good["quantity"], good["unit_price"]) == ("1001", -2.0, 1000.5)
    assert str(good["invoice_date"]) == "2023-01-02 03:04:05"
    assert [bad[c] for c in ("customer_id", "invoice_date", "quantity", "unit_price")] == [None] * 4


def test_write_guards(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="Cannot write"):
        files.write_table(df, str(tmp_path / "x"), fmt="xlsx")
    with pytest.raises(ValueError, match="empty"):
        files.write_table(df.where("a > 1"), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="location"):
        files.write_table(df, " ")
    with pytest.raises(ValueError, match="DataFrame"):
        files.write_table(None, str(tmp_path / "x"))


def test_ordered_sink(spark, tmp_path):
    """Files by name, and rows in them, follow the order; a value that half of the rows share lies in several files."""
    rows = spark.range(4000).selectExpr("if(id % 2 = 0, 7, (id * 7919) % 4000) AS v", "id")
    uri = files.write_table(rows.repartition(5), str(tmp_path / "t.parquet"), order_by=["v"])
    placed = files.with_positions(spark, uri).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(4000))
    assert [r["v"] for r in placed] == sorted(r["v"] for r in rows.collect())
    assert sorted(r["id"] for r in placed) == list(range(4000))
    names = spark.read.parquet(uri).where("v = 7").selectExpr("_metadata.file_name AS f").distinct().count()
    assert names > 1
    down = files.write_table(rows, str(tmp_path / "d"), fmt="csv", order_by=[F.desc("v"), "id"])
    lines = []
    for file in sorted((tmp_path / "d").glob("part-*.csv")):
        lines += [tuple(map(int, line.split(","))) for line in file.read_text().splitlines()[1:]]
    assert down and lines == sorted(((r["v"], r["id"]) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    with pytest.raises(ValueError, match="in order"):
        files.write_table(rows, uri, mode="append", order_by=["v"])


def test_object_uri():
    assert files.object_uri("s3://bucket/", "/folder/a.parquet") == "s3a://bucket/folder/a.parquet"
    with pytest.raises(ValueError):
        files.object_uri("", "a")


@pytest.mark.parametrize("fmt, name", [("parquet", "t"), ("parquet", "t.parquet"), ("csv", "t")])
def test_tables_survive_the_round_trip(spark, tmp_path, fmt, name):
    df = spark.createDataFrame([("a", 1), ("b,\"c\"\n", 2)], "k string, v int")
    uri = files.write_table(df.where("v = 1"), str(tmp_path / fmt / name), fmt=fmt)
    assert [(r["k"], int(r["v"])) for r in files.read_table(spark, uri).collect()] == [("a", 1)]


def test_csv_sink_escapes_formulas(spark, tmp_path):
    df = spark.createDataFrame([("=SUM(1,1)", 1), ("plain", 2)], "note string, n int")
    files.write_csv(df, str(tmp_path / "safe"), ["note"])
    files.write_csv(df, str(tmp_path / "raw"), ["note"], sanitize_formulas=False)
    read = lambda p: {r["note"] for r in files.read_csv(spark, str(tmp_path / p)).collect()}
    assert read("safe") == {"'=SUM(1,1)", "plain"} and read("raw") == {"=SUM(1,1)", "plain"}

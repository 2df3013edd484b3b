"""File and object-store readers and writers for transaction and audience tables.

Locations are Hadoop URIs (``s3a://``, ``hdfs://``, ``file:`` ...); credentials are Spark settings.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.operators.export import escape_formulas
from patronage.session import materialize, small_lookup

#: Different headers that the files of one folder may have.
MAX_HEADERS = 1000


def _first_lines(lines: DataFrame) -> DataFrame:
    """One row a file: its header line, where that lies, and whether some byte of the file is no UTF-8."""
    return lines.groupBy("_file").agg(
        F.max(~F.is_valid_utf8("value")).alias("_latin"),
        F.min("_place").alias("_first"),
        F.min_by("value", "_place").alias("_header"),
    )


def _decoded(value: Column, latin: Column) -> Column:
    text = F.when(latin, F.decode(value.cast("binary"), "ISO-8859-1")).otherwise(value)
    return F.regexp_replace(text, "^\ufeff", "")


def _column_names(header: str) -> list[str]:
    """Names in a header line: those without one get a number, those that occur twice get it behind."""
    names = [name.strip() for name in next(csv.reader([header]))]
    twice = {name.lower() for name in names if sum(name.lower() == other.lower() for other in names) > 1}
    return [f"_c{i}" if not name else f"{name}{i}" if name.lower() in twice else name for i, name in enumerate(names)]


def _read_by_own_headers(spark: SparkSession, path: str) -> DataFrame | None:
    """Every file by its own header and encoding, from one read of the bytes.

    The lines are stored as they are, with their file and place; headers, encodings and rows all come from there. What reaches
    the driver is the distinct headers. Lines are checked where they lie (a line never breaks a UTF-8
    sequence), so no file is held whole."""
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    # The text source hands on the stored bytes unchanged.
    found = spark.read.text(path).where("length(btrim(value)) > 0")
    lines = materialize(found.select(F.col("_metadata.file_path").alias("_file"), place.alias("_place"), "value"))
    heads = _first_lines(lines)
    heads = materialize(heads.withColumn("_header", _decoded(F.col("_header"), F.col("_latin"))))
    distinct = [row["_header"] for row in heads.select("_header").distinct().limit(MAX_HEADERS + 1).collect()]
    if len(distinct) > MAX_HEADERS:
        raise ValueError(f"The files of '{path}' have more than {MAX_HEADERS} different headers.")
    if any(header.startswith("PAR1") for header in distinct):
        raise ValueError(f"'{path}' holds Parquet files among others.")
    if not distinct:
        return None
    names = {header: _column_names(header) for header in sorted(distinct)}
    columns = list(dict.fromkeys(name for header in names.values() for name in header))
    places = [(h, [own.index(c) + 1 if c in own else 0 for c in columns]) for h, own in names.items()]
    where = F.broadcast(spark.createDataFrame(places, "_header string, _places array<int>"))  # at most MAX_HEADERS rows
    known = small_lookup(heads.join(where, "_header").drop("_header"))
    width = max(map(len, names.values()))
    cells = ", ".join(f"c{i} string" for i in range(width))
    rows = lines.join(known, "_file").where("_place <> _first")
    parsed = F.from_csv(_decoded(F.col("value"), F.col("_latin")), cells, {"escape": '"'})
    split = rows.select("_places", parsed.alias("_row")).select(
        "_places", F.array(*[f"_row.c{i}" for i in range(width)]).alias("_cells")
    )
    return split.select(
        *[F.when(F.col("_places")[i] > 0, F.try_element_at("_cells", F.col("_places")[i])).alias(c) for i, c in enumerate(columns)]
    )


def read_csv(
    spark: SparkSession, path: str, encoding: str | None = None, multiline: bool = False
) -> DataFrame:
    """CSV with a header, every column as text so that leading zeros survive.

    Without ``encoding`` each file is read by its own header, as UTF-8, or as Latin-1 if it is not valid UTF-8; a value then
    ends with its line. With it, or with ``multiline`` (then UTF-8), a file whose header differs from the first one's
    is an error.
    """
    if encoding or multiline:
        reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        table = reader.option("enforceSchema", False).option("encoding", encoding or "UTF-8").csv(path)
    else:
        table = _read_by_own_headers(spark, path)
    if table is None or not table.columns:
        raise ValueError(f"'{path}' is empty.")
    if table.isEmpty():
        raise ValueError(f"'{path}' has a header but no data rows.")
    return table


def is_parquet(path: str) -> bool:
    return path.lower().rstrip("/").endswith((".parquet", ".pq"))


def object_uri(bucket: str, key: str, scheme: str = "s3a") -> str:
    """``scheme://bucket/key`` after removing schemes and stray slashes from both parts."""
    bucket = (bucket or "").replace("s3://", "").strip("/\\")
    key = (key or "").lstrip("/\\")
    if not bucket or not key:
        raise ValueError("An object needs a bucket and a key.")
    return f"{scheme}://{bucket}/{key}"


def read_table(spark: SparkSession, uri: str) -> DataFrame:
    """Parquet by suffix or by the four magic bytes of a stored file, else CSV; a mixture of both is an error."""
    if is_parquet(uri):
        return spark.read.parquet(uri)
    return spark.read.parquet(uri) if _has_parquet_magic(spark, uri) else read_csv(spark, uri)


def _has_parquet_magic(spark: SparkSession, uri: str) -> bool:
    # A 4-byte look at one file through the Hadoop file system; the table itself stays unread.
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(conf)
    first = None
    for status in fs.globStatus(path) or []:
        # One file after the other up to the first with data, whatever the folder holds.
        listed = fs.listLocatedStatus(status.getPath())
        while first is None and listed.hasNext():
            file = listed.next()
            if file.isFile() and file.getPath().getName()[0] not in "._" and file.getLen() >= 4:
                first = file.getPath()
    if first is None:
        return False
    stream = fs.open(first)
    try:
        return bytes(stream.read() for _ in range(4)) == b"PAR1"
    finally:
        stream.close()


def write_table(
    df: DataFrame, uri: str, fmt: str = "parquet", mode: str = "error", order_by: list[str | Column] | None = None
) -> str:
    """Write a non-empty DataFrame as Parquet or formula-safe CSV; returns the location.

    With ``order_by`` the rows of each file, and the files by name, are in that order (see :func:`in_order`)."""
    if not isinstance(df, DataFrame):
        raise ValueError("Input must be a Spark DataFrame.")
    if not (uri or "").strip():
        raise ValueError("A target location must be provided.")
    fmt = fmt.lower().strip()
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"Cannot write '{fmt}', only parquet or csv.")
    if df.isEmpty():
        raise ValueError("Cannot write an empty DataFrame.")
    if order_by is not None:
        if mode == "append":
            raise ValueError("Files that are added cannot be in order with those that are there.")
        df = in_order(df, order_by)
    writer = write_parquet if fmt == "parquet" else write_csv
    writer(df, uri, mode=mode)
    return uri


def in_order(df: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """``df`` in partitions that follow each other in the order of ``order_by``, each sorted.

    Rows of one key are dealt over partitions by a number of theirs, so a key that many rows share, or a table of one
    key, is no single task. As many partitions as the session shuffles into."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_deal", F.monotonically_increasing_id())
    return dealt.repartitionByRange(parts, *keys, "_deal").sortWithinPartitions(*keys).drop("_deal")


def with_positions(spark: SparkSession, uri: str) -> DataFrame:
    """A stored Parquet table with ``position``: 0, 1, ... through its files by name, as :func:`write_table` ordered them."""
    stored = spark.read.parquet(uri).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # One row a file: the counts before each.
    sizes = stored.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_file", before.alias("_before"))
    placed = stored.join(starts, "_file")
    return placed.withColumn("position", F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")


def write_csv(
    df: DataFrame,
    path: str,
    columns: list[str] | None = None,
    sanitize_formulas: bool = True,
    mode: str = "error",
) -> None:
    chosen = df.select(*columns) if columns is not None else df
    safe = escape_formulas(chosen) if sanitize_formulas else chosen
    safe.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(
    df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error"
) -> None:
    chosen = df.select(*columns) if columns is not None else df
    chosen.write.mode(mode).parquet(path)

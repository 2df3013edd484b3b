"""What several of the text operators share: stored tables, ordered blocks, Arrow columns."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.session import new_table_path

#: Stands for a null id where ids are compared; nulls therefore come first.
NULL_ID = -(2**63)

#: Upper bound of the number of ordered blocks, and so of pivots and block totals on the driver.
MAX_BLOCKS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it: a later stage, or the retry
    of a lost one, reads the files instead of running everything again."""
    spark = df.sparkSession
    path = new_table_path(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def known_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def block_count(spark: SparkSession) -> int:
    """As many blocks as the session shuffles into, at most ``MAX_BLOCKS``. Blocks are streamed, so
    their size is not bound by memory."""
    return max(1, min(MAX_BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ordered_blocks(
    df: DataFrame, key: str, name: str = "block", weight: Column | None = None
) -> tuple[DataFrame, int]:
    """Number the rows by ranges of the numeric column ``key``: all rows of block i come before
    those of block i+1, equal keys share a block. Returns the frame and the number of blocks.
    Blocks have about as many rows each, or as much ``weight`` (small whole numbers).

    The pivots are approximate quantiles, at most ``MAX_BLOCKS`` numbers on the driver."""
    from pyspark.ml.feature import Bucketizer  # here, as workers import this module too

    blocks = block_count(df.sparkSession)
    shares = [i / blocks for i in range(1, blocks)] or [0.5]
    weighed = df if weight is None else df.select(F.explode(F.array_repeat(key, weight)).alias(key))
    pivots = weighed.agg(F.percentile_approx(key, shares, 20 * max(100, blocks))).first()[0] or []
    splits = [-float("inf"), *sorted({float(p) for p in pivots}), float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0)), 1
    as_double = f"{name}_key"
    out = Bucketizer(splits=splits, inputCol=as_double, outputCol=name).transform(
        df.withColumn(as_double, F.col(key).cast("double"))
    )
    return out.withColumn(name, F.col(name).cast("int")).drop(as_double), len(splits) - 1


def by_block(df: DataFrame, blocks: int, order: Iterable[Column | str], name: str = "block") -> DataFrame:
    """One task for each block, its rows sorted (Spark's sort spills)."""
    return df.repartitionById(blocks, F.col(name)).sortWithinPartitions(name, *order)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def integers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def chunks(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """Slices of ``batch`` whose texts take about ``limit`` bytes, so that what is computed from a
    slice stays small whatever the batch size. A longer single text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop

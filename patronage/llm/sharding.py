"""Uniform shuffle of a table into shards: two-pass external shuffle.

Pass one scatters the rows into buckets of about ``bucket_bytes`` by a seeded hash; pass two orders each
bucket's rows by a Fisher-Yates shuffle and writes it. Buckets one after the other are a uniform
permutation of the table, which is cut into shards whose row counts differ by one at most.

The hash covers the whole row, so rows with one doc_id or one text still scatter, and a seed gives
one order on any cluster. Only rows that are repeated in full more often than a bucket holds are
scattered by their place in the input as well (they are alike, so their order does not matter).
Nulls: a null text has size 1 and the checksum of the empty text; null doc_ids are rows like others.
An empty table gives an empty result; all columns are carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.llm.common import store

#: Text bytes of a bucket: what one task shuffles in memory.
BUCKET_BYTES = 32 << 20

#: Offsets of so many buckets are broadcast (16 bytes each); with more, the planner picks the join.
BROADCAST_BUCKETS = 1 << 22


def shuffle_shards(
    docs: DataFrame, shards: int, seed: int = 0, text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(doc, shard, slot) for each row: ``doc`` is the row as a struct, ``slot`` its place in the shard,
    gapless from 0. The rows are read back from the written buckets.

    ``docs`` should be a scan of stored files: it is read twice."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    body = F.col("doc").getField(text)
    # Map columns cannot be hashed; the seed goes first, so that it reaches every later step.
    hashed = [F.col("doc").getField(f.name) for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    rows = rows.withColumn("mark", F.xxhash64(F.lit(seed), *hashed))
    size = F.coalesce(F.octet_length(body), F.lit(0)) + 64
    n_rows, n_bytes = rows.agg(F.count("*"), F.sum(size)).first()
    buckets = max(1, -(-int(n_bytes or 0) // bucket_bytes))
    limit = max(1000, n_rows // (4 * buckets))
    # Each of these marks has over ``limit`` rows: at most 4 x buckets marks.
    many = rows.groupBy("mark").count().filter(F.col("count") > limit).select("mark", F.lit(True).alias("many"))
    if not many.isEmpty():
        many = F.broadcast(many) if 4 * buckets <= BROADCAST_BUCKETS else many
        rows = rows.join(many, "mark", "left")
        salt = F.when(F.col("many"), F.monotonically_increasing_id()).otherwise(0)
    else:
        salt = F.lit(0).cast("long")
    scattered = rows.select(
        "doc", "mark", F.pmod(F.xxhash64("mark", salt, F.lit(seed + 1)), F.lit(buckets)).alias("bucket")
    )
    schema = T.StructType([scattered.schema["doc"], T.StructField("bucket", T.LongType()), T.StructField("place", T.LongType())])
    written = store(scattered.groupBy("bucket").applyInArrow(_fisher_yates(seed), schema))
    offsets = _offsets(written.groupBy("bucket").count())
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    at = F.col("before") + F.col("place")
    # Shard s holds places ceil(s n / shards) up to ceil((s + 1) n / shards).
    shard = F.expr(f"int((at * {shards}) div {max(1, n_rows)})")
    first = F.expr(f"(shard * {n_rows}L + {shards - 1}) div {shards}")
    placed = written.join(offsets, "bucket").withColumn("at", at).withColumn("shard", shard)
    return placed.select("doc", "shard", (F.col("at") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard as a folder ``shard=N`` of Parquet files, rows sorted by slot."""
    flat = sharded.select("doc.*", F.col("shard").alias("shard"), F.col("slot").alias("slot"))
    flat.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _offsets(counts: DataFrame) -> DataFrame:
    """Rows in all buckets before each one. Sums within groups of 4096 buckets, then over groups, so that
    no window holds more than one row per group or 4096 buckets."""
    from pyspark.sql import Window

    grouped = counts.withColumn("part", F.expr("bucket div 4096"))
    inside = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = grouped.groupBy("part").agg(F.sum("count").alias("part_rows"))
    parts = parts.select("part", F.coalesce(F.sum("part_rows").over(across), F.lit(0)).alias("part_before"))
    within = grouped.select("bucket", "part", F.coalesce(F.sum("count").over(inside), F.lit(0)).alias("inside"))
    return within.join(parts, "part").select("bucket", (F.col("inside") + F.col("part_before")).alias("before"))


def _fisher_yates(seed: int):
    def run(bucket: tuple, rows: pa.Table) -> pa.Table:
        number = bucket[0].as_py()
        # Rows come in any order; sorted by hash they have one order to start from. Equal hashes are equal rows.
        order = np.argsort(rows.column("mark").to_numpy(), kind="stable")
        swap = np.random.default_rng([seed, number])
        swap.shuffle(order)  # Fisher-Yates, in place
        n = len(order)
        return pa.table(
            [rows.column("doc").take(pa.array(order)), pa.array(np.full(n, number)), pa.array(np.arange(n))],
            names=["doc", "bucket", "place"],
        )

    return run

"""Importance resampling: draw the documents whose words look most like a target's.

Words and runs of up to ``max_n`` words are features, hashed into buckets. A bucket's gain is the logarithm of its share
in the target over its share in the documents; a document's weight is the sum of the gains of its features, and noise that
the document's id decides turns the largest scores into a draw without replacement.

A batch's texts are joined with a sentinel byte that no text holds, and one regular expression finds all words and all
sentinels; the sentinels' places are the document offsets, and a search in them masks the runs that cross documents.
Counts are added up in the tasks, so 10,000 numbers a partition are shuffled and one table of gains is sent back. The
draw sorts narrow rows by ranges of (score, id), with a number that deals out equal rows; no task holds them all.

Nulls: a null text has no words; a null doc_id has the noise of an empty id and comes after all others. Rows of equal
score and id are ranked by text hash, and equal rows follow each other in any order. An empty table gives an empty
result; an empty target leaves weights that depend on the documents alone. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import block_count, chunks, known_id, store

_SENTINEL = b"\xff"  # not a byte of UTF-8
_WORD = re.compile(rb"\xff|[0-9a-z\x80-\xfe]+")

#: Words whose checksum a process keeps, and the longest of them.
CACHED_WORDS, CACHED_BYTES = 400_000, 64

_SCORED = "doc_id long, row long, n_words long, n_features long, weight long"


def bucket_counts(docs: DataFrame, max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket."""
    counted = docs.select("text").mapInArrow(_count(max_n, buckets), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(
    docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, scale: int = 1000
) -> list[int]:
    """The gain of each bucket in thousandths (``scale``): one number a bucket, whatever the corpus."""
    counted = [{r.bucket: r.n for r in bucket_counts(d, max_n, buckets).collect()} for d in (docs, target)]
    here, there = ([counts.get(b, 0) for b in range(buckets)] for counts in counted)
    total_here, total_there = sum(here) + buckets, sum(there) + buckets
    ratio = np.array([float((t + 1) * total_here) for t in there]) / [float((s + 1) * total_there) for s in here]
    return np.floor(scale * np.log(ratio)).astype(np.int64).tolist()


def score_documents(
    docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, seed: int = 2024, scale: int = 1000
) -> DataFrame:
    """(doc_id, row, n_words, n_features, weight, score) of every document, stored; ``row`` is a hash of the text."""
    gains = bucket_gains(docs, target, max_n, buckets, scale)
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text"
    )
    weighed = keyed.mapInArrow(_weigh(gains, max_n, buckets), _SCORED)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-scale * F.log(-F.log(uniform))).cast("long")
    return store(weighed.withColumn("score", F.col("weight") + noise))


def draw(scored: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for the floor(``percent`` * N / 100) highest scores of the N documents with
    at least ``min_words`` words, ties to the smaller doc_id; null for all others."""
    fit = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    # The approximate quantile is off by a ten-thousandth of the rows at most; one hundredth more is let through.
    share = max(0.0, 1 - (percent + 1) / 100)
    n, low = scored.filter(fit).agg(F.count("*"), F.percentile_approx("score", share, 10_000)).first()
    size = percent * n // 100
    if not size:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = fit & (F.col("score") >= low)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row", "deal"]
    dealt = scored.filter(near).withColumn("deal", F.monotonically_increasing_id())
    sorted_rows = dealt.repartitionByRange(block_count(scored.sparkSession), *order).sortWithinPartitions(*order)
    # The id holds the partition above bit 33 and the place in it below.
    placed = store(sorted_rows.drop("deal").withColumn("place", F.monotonically_increasing_id()))
    part, place = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a block
    starts, before = [], 0
    for block, rows in sizes:
        starts.append((block, before))
        before += rows
    offsets = scored.sparkSession.createDataFrame(starts, "part long, before long")
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    rank = F.col("before") + place + 1
    ranked = ranked.withColumn("rank", F.when(rank <= size, rank)).drop("part", "before", "place")
    return ranked.unionByName(scored.filter(~near).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`draw` ranked, with ``rank``; a row repeated within the draw comes once."""
    key = [known_id().alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row")]
    chosen = drawn.filter("rank is not null").select(known_id().alias("_id"), F.col("row").alias("_row"), "rank")
    chosen = chosen.groupBy("_id", "_row").agg(F.min("rank").alias("rank"))
    keyed = docs.drop("rank").select("*", *key).dropDuplicates(["_id", "_row"])
    return keyed.join(chosen, ["_id", "_row"]).drop("_id", "_row")


class _Checksums(dict):
    """crc32 of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        crc = zlib.crc32(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = crc
        return crc


_known = _Checksums()


def _features(column: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of each feature of the texts, and the number of words of each document."""
    texts = pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()
    words = _WORD.findall(_SENTINEL.join(texts).lower())
    crcs = np.fromiter(map(_known.__getitem__, words), np.uint32, len(words))
    mark = zlib.crc32(_SENTINEL)
    maybe = np.flatnonzero(crcs == mark).tolist()
    sentinels = np.array([i for i in maybe if words[i] == _SENTINEL], np.int64)
    # Place i belongs to the document that as many sentinels come before; sentinels themselves are masked.
    owner = np.searchsorted(sentinels, np.arange(len(words)), side="right")
    real = np.ones(len(words), bool)
    real[sentinels] = False
    n_words = np.bincount(owner[real], minlength=len(texts))
    found, owners, run = [crcs[real]], [owner[real]], crcs
    for n in range(2, max_n + 1):
        longer = zip(run[: len(words) - n + 1].tolist(), words[n - 1 :])
        run = np.array([zlib.crc32(b" " + word, crc) for crc, word in longer], np.uint32)
        count = len(run)
        # All n words are of one document and none is a sentinel.
        inside = (owner[:count] == owner[n - 1 :]) & real[:count]
        found.append(run[inside])
        owners.append(owner[:count][inside])
    return np.concatenate(found).astype(np.int64) % buckets, np.concatenate(owners), n_words


def _count(max_n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                total += np.bincount(_features(part.column("text"), max_n, buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    return run


def _weigh(gains: list[int], max_n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                found, owners, n_words = _features(part.column("text"), max_n, buckets)
                order = np.argsort(owners, kind="stable")
                sums = np.append(0, np.cumsum(gain[found[order]]))
                ends = np.searchsorted(owners[order], np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(n_words, pa.int64()),
                     pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(sums[ends]))],
                    ["doc_id", "row", "n_words", "n_features", "weight"],
                )

    return run

"""Packing of documents into training sequences along a space-filling curve.

Each document's hashed words are projected to three dimensions; the cell of that point on a Hilbert
curve is its key. Documents are range-sorted by key and their ids laid end to end along the curve,
cut at every ``length`` ids: a sequence holds neighbours on the curve, and only the very last sequence is
not full. Equal texts have equal cells, so the lower half of the key is a hash of doc_id:
a cell that holds a third of all documents spreads over many blocks.

Ids are made once and stored, as the number of ids before a block must be known
before its documents are cut. Nulls: a null text is the empty text (its end id alone); null doc_ids are
kept as null. An empty table gives an empty one, extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.bpe import encoder
from patronage.llm.common import (
    NULL_ID, by_block, chunks, integers, known_id, ordered_blocks, store, text_bytes, texts,
)
from patronage.llm.words import hash_words, mix, seeds

DIMENSIONS, BITS = 3, 10

#: Words fall into so many buckets, each with a direction of its own.
BUCKETS = 4096

#: Tokens that count as one when documents are dealt to blocks.
WEIGHED_TOKENS = 1024

_ENCODED = "id long, curve_key long, n_tokens long, width int, ids binary"
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, blanks_count: bool = False, seed: int = 9
) -> DataFrame:
    """One row per piece: ``doc_id``, its ids [start, start + length) of ``doc_tokens``, and where they lie
    (``sequence_id``, ``offset``); ``ids`` are little-endian 16- or 32-bit numbers, ``ids_crc32`` is over 32 bits."""
    keyed = docs.select(known_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    encoded = store(keyed.mapInArrow(_encode(tokenizer, end_id, blanks_count, seed), _ENCODED))
    # Long documents lie close together on the curve, so blocks are balanced by tokens, not by documents.
    weight = (F.col("n_tokens") / WEIGHED_TOKENS).cast("int") + 1
    numbered, blocks = ordered_blocks(encoded, "curve_key", weight=weight)
    totals = numbered.groupBy("block").agg(F.sum("n_tokens")).orderBy("block").collect()  # at most MAX_BLOCKS
    starts, total = {}, 0
    for block, n in totals:
        starts[block] = total
        total += n
    ordered = by_block(numbered, blocks, ["curve_key", "id", "ids"])
    return ordered.mapInArrow(_cut(starts, length), _PIECES)


def curve_cells(words: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Hilbert index of each document (``places``: where its words start, one entry more)."""
    directions = 1.0 - 2.0 * (mix(seeds(BUCKETS * DIMENSIONS, seed)) & np.uint64(1)).astype(np.float64)
    buckets = (words & np.uint64(BUCKETS - 1)).astype(np.int64)
    steps = directions.reshape(BUCKETS, DIMENSIONS)[buckets]
    sums = np.zeros((len(words) + 1, DIMENSIONS))
    np.cumsum(steps, axis=0, out=sums[1:])
    counts = np.maximum(np.diff(places), 1)
    # Directions of random words cancel to about the square root of their number.
    points = (sums[places[1:]] - sums[places[:-1]]) / np.sqrt(counts)[:, None]
    cells = (0.5 + 0.5 * points / (1.0 + np.abs(points))) * (1 << BITS)
    return hilbert_index(np.minimum(cells.astype(np.int64), (1 << BITS) - 1))


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates (Skilling's transpose form)."""
    x = cells.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def _encode(tokenizer: str, end_id: int, blanks_count: bool, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_encoder = encoder(tokenizer, blanks_count)
        end = np.array([end_id], text_encoder.dtype).tobytes()
        width = text_encoder.dtype.itemsize
        for batch in batches:
            for part in chunks(batch, "text"):
                cells = curve_cells(*hash_words(*text_bytes(part.column("text"))), seed)
                ids = integers(part.column("id"))
                keys = (cells << 32) | (mix(ids.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
                encoded = [data + end for data in text_encoder.encode(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(keys), pa.array([len(e) // width for e in encoded], pa.int64()),
                     pa.array(np.full(len(ids), width, np.int32)), pa.array(encoded, pa.binary())],
                    ["id", "curve_key", "n_tokens", "width", "ids"],
                )

    return run


def _cut(starts: dict[int, int], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, 0
        for batch in batches:
            for part in chunks(batch, "ids"):
                numbers, owners = integers(part.column("block")).tolist(), integers(part.column("id")).tolist()
                widths, data = integers(part.column("width")).tolist(), part.column("ids").to_pylist()
                rows: list[list] = [[] for _ in range(8)]
                for number, owner, width, ids in zip(numbers, owners, widths, data, strict=True):
                    if number != block:
                        block, at = number, starts[number]
                    wide = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4")).cast("B")
                    n, start = len(ids) // width, 0
                    while start < n:
                        size = min(n - start, length - at % length)
                        piece = (
                            None if owner == NULL_ID else owner, start, size, zlib.crc32(wide[4 * start : 4 * (start + size)]),
                            n, at // length, at % length, ids[width * start : width * (start + size)],
                        )
                        for column, value in zip(rows, piece, strict=True):
                            column.append(value)
                        start += size
                        at += size
                types = [pa.int64()] * 7 + [pa.binary()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    return run

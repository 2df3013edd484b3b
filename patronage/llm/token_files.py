"""Token ids of documents as binary segments, in ascending doc_id order.

Each segment holds the concatenated ids of some documents (16 or 32 bits an id) and an Elias-Fano
code of the documents' ends, from which select gives offsets. Documents are range-partitioned by
doc_id into blocks; a block is one task, which streams its sorted documents and closes a segment
when it is full. Segments are rows of a Parquet table, so Spark's committer writes them to any
store and a lost task leaves no half file.

Nulls: a null text is encoded as the empty text; null doc_ids come first. Equal doc_ids are ordered
by text. An empty table gives an empty one; extra columns are ignored. A text longer than a segment
makes a longer segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.bpe import encoder
from patronage.llm.common import NULL_ID, by_block, chunks, integers, known_id, ordered_blocks, store
from patronage.llm.elias_fano import EliasFano, encode

SEGMENT_IDS = 1 << 20

#: block_start: ids of the block before this segment; width: bytes of an id.
_SEGMENT = "block int, block_start long, n_ids long, width int, doc_ids binary, ids binary, ends binary"


def write_token_segments(
    docs: DataFrame, tokenizer: str, end_id: int, blanks_count: bool = True, segment_ids: int = SEGMENT_IDS
) -> DataFrame:
    """Encode ``text`` by ``tokenizer`` (a file, or the name of a public one), append ``end_id`` to each
    document and store the segments; returns the stored table. ``blanks_count``: the tokenizer's ids
    depend on white space."""
    keyed = docs.select(known_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    numbered, blocks = ordered_blocks(keyed, "id")
    ordered = by_block(numbered, blocks, ["id", "text"])
    return store(ordered.mapInArrow(_segments(tokenizer, end_id, blanks_count, segment_ids), _SEGMENT))


def read_token_index(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the segments: ``start``
    counts the ids of all documents before it, the crc is over little-endian 32-bit ids."""
    spark = segments.sparkSession
    totals = segments.groupBy("block").agg(F.sum("n_ids")).orderBy("block").collect()  # at most MAX_BLOCKS
    starts, total = {}, 0
    for block, n in totals:
        starts[block] = total
        total += n
    return segments.mapInArrow(_index(starts), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _segments(tokenizer: str, end_id: int, blanks_count: bool, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_encoder = encoder(tokenizer, blanks_count)
        end = np.array([end_id], text_encoder.dtype).tobytes()
        width = text_encoder.dtype.itemsize
        block, before, owners, parts, size = None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(p) // width for p in parts])
            row = [block, before, size // width, width, np.array(owners, "<i8").tobytes(), b"".join(parts), encode(ends)]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, types, strict=True)],
                ["block", "block_start", "n_ids", "width", "doc_ids", "ids", "ends"],
            )

        for batch in batches:
            for part in chunks(batch, "text"):
                encoded = text_encoder.encode(part.column("text"))
                numbers, ids = integers(part.column("block")), integers(part.column("id"))
                for number, owner, data in zip(numbers.tolist(), ids.tolist(), encoded, strict=True):
                    if parts and (number != block or size >= segment_ids * width):
                        yield close()
                        before, owners, parts, size = before + size // width, [], [], 0
                    if number != block:
                        block, before = number, 0
                    owners.append(owner)
                    parts.append(data + end)
                    size += len(data) + len(end)
        if parts:
            yield close()

    return run


def _index(starts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, before, _, width, owners, ids, ends = (batch.column(i)[row].as_py() for i in range(7))
                owners = np.frombuffer(owners, "<i8")
                ids = np.frombuffer(ids, f"<u{width}")
                offsets = np.append(0, EliasFano(ends).select(np.arange(len(owners))).astype(np.int64))
                wide = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners, mask=owners == NULL_ID), pa.array(offsets[:-1] + before + starts[block]),
                     pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run

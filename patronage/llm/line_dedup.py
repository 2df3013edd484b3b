"""Line de-duplication: lines that many documents repeat stay in one of them only.

Hashes of the lines are range-partitioned, sorted by (hash, document descending, position) and
streamed: the first document of a hash keeps its lines. The range covers (hash, document), so a
line that a third of all documents hold is spread over many tasks; runs cut by a partition border
are settled from two summary rows per partition. The result is a compressed bitmap per document, not text.

Nulls: a null or empty text is one empty line; a null doc_id counts as one document below all
others. Rows that share a doc_id are told apart by 128 bits of hashes of their text. An empty table gives an empty
result, extra columns are carried through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import block_count, integers, known_id, store, texts

#: The ASCII white space that is stripped off both ends of a line to get its key.
BLANKS = " \t\n\v\f\r"

_LINES = "h1 long, h2 long, id long, row long, row2 long, pos int"
_STREAM = "kind int, h1 long, h2 long, id long, row long, row2 long, pos int, docs long"
_DROP, _OPEN, _SUMMARY = 0, 1, 2


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, row, row2, n_dropped, keep) for each document that loses lines; the first three are the columns
    of :func:`with_keys`, ``keep`` is for :func:`kept_lines`.

    A line's key is the line stripped of blanks with A-Z lower-cased. Keys of at least ``min_chars``
    code points in at least ``min_docs`` documents lose their lines except in the largest doc_id."""
    keyed = with_keys(docs).select("id", "row", "row2", "text")
    lines = store(keyed.mapInArrow(_emit_lines(min_chars), _LINES))
    ordered = lines.repartitionByRange(
        block_count(docs.sparkSession), F.col("h1"), F.col("h2"), F.col("id").desc()
    ).sortWithinPartitions("h1", "h2", F.col("id").desc(), "row", "row2", "pos")
    streamed = store(ordered.mapInArrow(_first_occurrences(min_docs), _STREAM))
    # At most two summaries per partition: the bound of this broadcast.
    cut = F.broadcast(
        streamed.filter(F.col("kind") == _SUMMARY)
        .groupBy("h1", "h2")
        .agg(F.sum("docs").alias("all_docs"), F.max("id").alias("first_id"))
        .filter(F.col("all_docs") >= min_docs)
    )
    place = ["id", "row", "row2", "pos"]
    settled = (
        streamed.filter(F.col("kind") == _OPEN)
        .join(cut, ["h1", "h2"])
        .filter(F.col("id") != F.col("first_id"))
        .select(place)
    )
    dropped = streamed.filter(F.col("kind") == _DROP).select(place).unionByName(settled)
    grouped = dropped.groupBy("id", "row", "row2").agg(F.collect_set("pos").alias("dropped"))
    return grouped.mapInArrow(_pack, "id long, row long, row2 long, n_dropped long, keep binary")


def with_keys(docs: DataFrame) -> DataFrame:
    """(doc, id, row, row2, text): the whole row as a struct, what identifies it (two hashes of the text), its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        known_id().alias("id"),
        F.xxhash64(text).alias("row"),
        F.xxhash64(F.lit(2), text).alias("row2"),
        text.alias("text"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, text, n_lines, n_dropped) for each row of ``docs``: ``doc`` is the row as it was, ``text``
    the lines that stay, joined by a line feed."""
    bitmaps = line_bitmaps(docs, min_chars, min_docs)
    joined = with_keys(docs).join(bitmaps.hint("shuffle_hash"), ["id", "row", "row2"], "left")
    joined = joined.select("doc", "text", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep")
    schema = joined.select("doc", "text").schema.add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(_apply, schema)


def kept_lines(text: str, keep: bytes | None) -> list[str]:
    """Lines whose bit is set; lines beyond the bitmap stay."""
    lines = text.split("\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]]


def _emit_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, rows2 = (integers(batch.column(c)) for c in ("id", "row", "row2"))
            digests, owner, places = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for pos, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(key := line.strip(BLANKS)) >= min_chars:
                        # bytes.lower() changes A-Z only
                        digests.append(xxhash.xxh3_128_digest(key.encode().lower()))
                        owner.append(i)
                        places.append(pos)
                if len(digests) > 200_000:
                    yield _line_batch(digests, ids[owner], rows[owner], rows2[owner], places)
                    digests, owner, places = [], [], []
            if digests:
                yield _line_batch(digests, ids[owner], rows[owner], rows2[owner], places)

    return run


def _line_batch(digests, ids, rows, rows2, places) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(ids), pa.array(rows),
         pa.array(rows2), pa.array(places, pa.int32())],
        ["h1", "h2", "id", "row", "row2", "pos"],
    )


def _first_occurrences(min_docs: int):
    """Stream of sorted lines to: lines to drop; lines of a hash that the partition's border cuts
    (open); a summary of each such hash. Holds fewer than ``min_docs`` documents' lines of one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opening, docs, first, last, held = None, True, 0, 0, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, ids, rows, rows2, pos = (integers(batch.column(c)) for c in ("h1", "h2", "id", "row", "row2", "pos"))
            ends = np.flatnonzero(np.append((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]), True)) + 1
            starts = np.append(0, ends[:-1])
            # A short run inside the batch can neither reach min_docs nor touch a border.
            matter = ends - starts >= min_docs
            matter[0] = matter[-1] = True
            out = []
            for s, e in zip(starts[matter].tolist(), ends[matter].tolist(), strict=True):
                now = (int(h1[s]), int(h2[s]))
                if now != key:
                    if key is not None:
                        if opening:
                            out.append(_summary(key, docs, first))
                        opening = False
                    key, docs, first, last, held = now, 0, int(ids[s]), None, []
                run_ids = ids[s:e]
                docs += int(np.count_nonzero(run_ids[1:] != run_ids[:-1])) + (last != int(run_ids[0]))
                last = int(run_ids[-1])
                part = (h1[s:e], h2[s:e], run_ids, rows[s:e], rows2[s:e], pos[s:e])
                if opening:
                    out.append(_rows(_OPEN, part))
                elif docs < min_docs:
                    held.append(part)
                else:
                    for p in [*held, part]:
                        away = p[2] != first
                        out.append(_rows(_DROP, tuple(c[away] for c in p)))
                    held = []
            yield _stream_batch(out)
        if key is not None:
            yield _stream_batch([*(_rows(_OPEN, p) for p in held), _summary(key, docs, first)])

    return run


def _rows(kind: int, part: tuple) -> tuple:
    return (np.full(len(part[0]), kind, np.int32), *part, np.zeros(len(part[0]), np.int64))


def _summary(key: tuple[int, int], docs: int, first: int) -> tuple:
    values = (_SUMMARY, key[0], key[1], first, 0, 0, 0, docs)
    return tuple(np.array([v], t) for v, t in zip(values, _STREAM_TYPES, strict=True))


_STREAM_TYPES = (np.int32, np.int64, np.int64, np.int64, np.int64, np.int64, np.int32, np.int64)


def _stream_batch(parts: list[tuple]) -> pa.RecordBatch:
    columns = [
        np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(_STREAM_TYPES)
    ]
    arrays = [pa.array(c.astype(t)) for c, t in zip(columns, _STREAM_TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "h1", "h2", "id", "row", "row2", "pos", "docs"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, bitmaps = [], []
        for places in batch.column("dropped"):
            places = np.asarray(places.values)
            keep = np.ones(int(places.max()) + 1, np.uint8)
            keep[places] = 0
            counts.append(len(places))
            # The last byte's spare bits are ones: lines beyond the bitmap stay.
            keep = np.append(keep, np.ones(-len(keep) % 8, np.uint8))
            bitmaps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row"), batch.column("row2"), pa.array(counts, pa.int64()),
             pa.array(bitmaps, pa.binary())],
            ["id", "row", "row2", "n_dropped", "keep"],
        )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, counts = [], []
        for text, keep in zip(texts(batch.column("text")), batch.column("keep").to_pylist(), strict=True):
            counts.append(text.count("\n") + 1)
            kept.append(text if keep is None else "\n".join(kept_lines(text, keep)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(kept, batch.schema.field("text").type), pa.array(counts, pa.int64()),
             batch.column("n_dropped")],
            ["doc", "text", "n_lines", "n_dropped"],
        )

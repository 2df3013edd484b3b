"""Suffix de-duplication: remove every byte that a repeated string of ``length`` bytes covers.

The starts of strings (suffixes cut to ``length`` bytes) are dealt into buckets by a q-gram of theirs, and buckets are
refined by identifiers at later offsets, over and over, as in bucket-pointer refinement:

1. *Initial buckets.* Of the q-grams (q = half the length) in a string, that with the smallest hash is its anchor; it
   depends on the string alone, so equal strings have equal anchors at equal offsets. Neighbouring strings of one text
   share their anchor and travel as one *unit*, about one for each q/2 bytes. The bucket is the anchor's q-gram.
2. *Leave early.* A bucket met once holds no repeated string. Units that are equal as a whole are repeated as a whole;
   one of them goes on to stand for the others.
3. *Refine.* The other units travel with their bytes. A bucket of more than ``bucket_rows`` units is split: the strings
   of a unit are halved by their offset from the anchor, and the longer q-gram that all strings of a half share is the
   new bucket (an identifier at later offsets); step 2 follows again. Strings of one offset share all their bytes, so
   halving ends after log2(q) rounds, and a passage that a third of all documents hold is counted, never gathered.
4. *Finish.* Small buckets are refined in memory: identifiers of 8 bytes become those of 16, 32, ... bytes by pairing each
   with the identifier that many bytes later, and sorting by the last ones shows which strings are equal.

What is repeated comes back to the texts as (unit, offsets); the texts are read again, cut into the same units,
and lose the bytes covered. Units repeated inside one text are one row, so text of one letter is not a row for each byte.

Buckets and units are told apart by 64-bit hashes each, so units by 128 bits. A row is known by a hash of its id and
text and, again, by the units looked up in it. Nulls: a null text is the empty text; a null or repeated doc_id is carried
only. Texts shorter than ``length`` keep all bytes. A cut may end inside a character, so kept texts are binary. An empty
table gives an empty result; extra columns are ignored. One text is one value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import block_count, chunks, store, text_bytes
from patronage.llm.words import mix

#: Units that one bucket may bring into a task's memory; larger buckets are split.
BUCKET_ROWS = 512

_UNITS = "core long, whole long, row long, twice boolean"
_PIECES = "core long, whole long, row long, unit long, low int, high int, known boolean, bytes binary"
_SPANS = "row long, unit long, low int, high int"
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def remove_repeats(docs: DataFrame, length: int = 400, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of ``docs``: ``kept`` are the bytes of its text that no
    string of ``length`` bytes covers that also starts elsewhere, in this text or another."""
    if length < 64:
        raise ValueError("length must be 64 or more")
    return _apply(docs, repeated_spans(docs, length, bucket_rows), length)


def repeated_spans(docs: DataFrame, length: int = 400, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(row, unit, low, high): the strings that start ``low`` to ``high`` bytes before the anchor of ``unit`` are repeated."""
    furthest = length - length // 2  # a string starts at most so many bytes before its anchor
    keyed = _keyed(docs)
    units = keyed.mapInArrow(_emit_units(length), _UNITS)
    # ``twice``: a unit met more than once in its text.
    met = units.groupBy("core").agg(
        F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")
    )
    repeated = store(met.filter("n > 1").select("core", (F.col("a") != F.col("b")).alias("mixed")))
    found = store(units.join(repeated.hint("merge"), "core"))
    everything = [F.lit(0).alias("low"), F.lit(furthest).alias("high")]
    spans = [found.filter(~F.col("mixed")).select("row", F.col("whole").alias("unit"), *everything)]

    mixed = found.filter("mixed").select("core", "whole", "row", F.col("whole").alias("unit"), *everything, "twice")
    equal, rest = _settle(mixed.withColumn("known", F.lit(False)))
    spans.append(equal)
    pieces = store(_bytes_of(keyed, rest, length))
    width = 1 << math.ceil(math.log2(furthest + 1))
    while True:
        sizes = store(pieces.groupBy("core").agg(F.count("*").alias("size"), F.min("known").alias("all_known")))
        open_sizes = sizes.filter(~F.col("all_known")).drop("all_known")
        small = pieces.join(open_sizes.filter(F.col("size") <= bucket_rows).hint("merge"), "core", "left_semi")
        blocks = block_count(docs.sparkSession)
        spans.append(
            store(small.repartition(blocks, "core").sortWithinPartitions("core").mapInArrow(_finish(length), _SPANS))
        )
        if width == 1 or not sizes.filter(~F.col("all_known") & (F.col("size") > bucket_rows)).head(1):
            break
        width //= 2
        large = pieces.join(open_sizes.filter(F.col("size") > bucket_rows).hint("merge"), "core", "left_semi")
        halves = store(large.mapInArrow(_halve(width, length), _PIECES))
        equal, rest = _settle(halves.withColumn("twice", F.lit(False)))
        spans.append(equal)
        pieces = store(rest.drop("twice"))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"))


def _settle(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of units of mixed buckets: the spans of those that are equal as a whole to others, and the units that go on: one
    of each equal group, as known, and all others. Stored, as both come from one join."""
    groups = units.groupBy("core", "whole").agg(
        F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n"),
        F.max("known").alias("was_known"),
        F.min(F.struct("row", "unit")).alias("first"),
    )
    groups = store(groups)
    judged = store(units.join(groups.hint("merge"), ["core", "whole"]))
    same = F.col("n") > 1
    equal = judged.filter(same & ~F.col("known")).select("row", "unit", "low", "high")
    goes_on = ~same | (F.struct("row", "unit") == F.col("first"))
    rest = judged.filter(goes_on).withColumn("known", same | F.col("was_known"))
    return equal, rest.drop("n", "was_known", "first")


def _bytes_of(keyed: DataFrame, units: DataFrame, length: int) -> DataFrame:
    """The pieces of text that hold all strings of ``units``."""
    wanted = units.groupBy("row").agg(F.collect_set(F.struct("core", "whole", "known")).alias("wanted"))
    texts = keyed.select("row", "text")
    return texts.join(wanted.hint("merge"), "row").mapInArrow(_cut(length), _PIECES)


def _apply(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    found = spans.groupBy("row").agg(F.collect_set(F.struct("unit", "low", "high")).alias("spans"))
    return _keyed(docs).join(found.hint("merge"), "row", "left").mapInArrow(_remove(length), _OUT)


def _units(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, anchor) of each unit of the texts in ``data`` at ``offsets``."""
    q = length // 2
    span = length - q + 1  # q-grams in a string
    n = len(data) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    # The order of q-grams follows a hash of their first 24 bytes; of equal ones the first is the anchor.
    padded = np.append(data, np.zeros(32, np.uint8))
    grams = len(data) - q + 1
    eight = np.ndarray((len(data) + 17,), "<u8", padded, strides=(1,))
    order = mix(eight[:grams] * _A + eight[8 : grams + 8] * _B + eight[16 : grams + 16] * _C)
    bits = np.uint64(int(grams).bit_length())
    order = order >> bits << bits | np.arange(grams, dtype=np.uint64)
    # Sliding minimum: of blocks of ``span`` from their start, and to their end.
    blocks = -(-grams // span)
    grid = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    grid[:grams] = order
    grid = grid.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.searchsorted(offsets, np.arange(n), side="right") - 1
    inside = np.flatnonzero(np.arange(n) + length <= offsets[owner + 1])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4
    anchor, owner = anchor[inside], owner[inside]
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
    last = np.append(new[1:], len(inside)) - 1
    return owner[new], inside[new], inside[last], anchor[new]


def _signed(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


def _hashed_units(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, int, int, int, memoryview]]:
    """(text, first, last, anchor, core, whole, data): hashes are signed numbers."""
    data, offsets = text_bytes(column)
    owners, first, last, anchor = _units(data, offsets, length)
    if not len(owners):
        return
    raw, q, digest = memoryview(np.ascontiguousarray(data)), length // 2, xxhash.xxh3_64_intdigest
    cores = [digest(raw[a : a + q]) for a in anchor.tolist()]
    wholes = [
        digest(raw[s : e + length], (a - s) << 32 | (a - e))
        for s, e, a in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)
    ]
    cores, wholes = (np.array(x, np.uint64).view(np.int64).tolist() for x in (cores, wholes))
    for unit in zip(owners.tolist(), first.tolist(), last.tolist(), anchor.tolist(), cores, wholes, strict=True):
        yield *unit, raw


def _emit_units(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = part.column("row").to_pylist()
                seen: dict[tuple[int, int, int], bool] = {}
                for i, _, _, _, core, whole, _ in _hashed_units(part.column("text"), length):
                    key = (i, core, whole)
                    seen[key] = key in seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[1] for k in seen], pa.int64()), pa.array([k[2] for k in seen], pa.int64()),
                     pa.array([rows[k[0]] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.bool_())],
                    ["core", "whole", "row", "twice"],
                )

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = part.column("row").to_pylist()
                wanted = [{(w["core"], w["whole"]): w["known"] for w in ws} for ws in part.column("wanted").to_pylist()]
                out = []
                for i, first, last, anchor, core, whole, raw in _hashed_units(part.column("text"), length):
                    known = wanted[i].pop((core, whole), None)
                    if known is not None:
                        low, high = anchor - last, anchor - first
                        out.append((core, whole, rows[i], whole, low, high, known, bytes(raw[first : last + length])))
                yield _piece_batch(out)

    return run


def _piece_batch(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    names = ["core", "whole", "row", "unit", "low", "high", "known", "bytes"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def _halve(width: int, length: int):
    """Pieces whose offsets from the anchor lie between two multiples of ``width``. Their bucket is what strings at all
    offsets of that range share, whether they occur here or not; that is the same wherever the anchor occurs."""
    furthest = length - length // 2
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for piece in batch.to_pylist():
                data, low, high = piece["bytes"], piece["low"], piece["high"]
                for begin in range(low // width * width, high + 1, width):
                    a, b = max(low, begin), min(high, begin + width - 1)
                    shared = data[max(0, high - begin) : high - min(begin + width - 1, furthest) + length]
                    own = data[high - b : high - a + length]
                    core = digest(shared, (piece["core"] ^ begin) & 0xFFFFFFFFFFFFFFFF)
                    whole = digest(own, a << 32 | b)
                    core, whole = (x - 2**64 if x >= 2**63 else x for x in (core, whole))
                    out.append((core, whole, piece["row"], piece["unit"], a, b, piece["known"], own))
                    size += len(own)
                if size > 4 << 20:
                    yield _piece_batch(out)
                    out, size = [], 0
            yield _piece_batch(out)

    return run


def _finish(length: int):
    """Spans of repeated strings of sorted buckets, a few megabytes of whole buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bucket = [], 0, None
        for batch in batches:
            for piece in batch.to_pylist():
                if piece["core"] != bucket and size > 2 << 20:
                    yield _span_batch(_repeated_strings(held, length))
                    held, size = [], 0
                bucket = piece["core"]
                held.append(piece)
                size += len(piece["bytes"])
        yield _span_batch(_repeated_strings(held, length))

    return run


def _span_batch(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["row", "unit", "low", "high"]
    )


def _repeated_strings(pieces: list[dict], length: int) -> list[tuple[int, int, int, int]]:
    if not pieces:
        return []
    data = np.frombuffer(b"".join(p["bytes"] for p in pieces), np.uint8)
    sizes = np.array([len(p["bytes"]) for p in pieces])
    counts = np.array([p["high"] - p["low"] + 1 for p in pieces])
    starts = np.cumsum(sizes) - sizes
    # Every string: its piece, its place, and its offset before the anchor.
    piece = np.repeat(np.arange(len(pieces)), counts)
    step = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    offset = np.array([p["high"] for p in pieces])[piece] - step
    buckets = np.cumsum([i > 0 and p["core"] != pieces[i - 1]["core"] for i, p in enumerate(pieces)])
    bucket = buckets[piece] * (1 << 32) + offset
    name = _identifiers(data, length)[starts[piece] + step]
    order = np.lexsort((name, bucket))
    same = (name[order][1:] == name[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
    twin = np.zeros(len(order), bool)
    twin[order[:-1][same]] = True
    twin[order[1:][same]] = True
    twin &= ~np.array([p["known"] for p in pieces])[piece]
    # Neighbouring offsets of a piece become one span.
    hits = np.flatnonzero(twin)
    if not len(hits):
        return []
    new = np.flatnonzero(np.append(True, (np.diff(hits) > 1) | (np.diff(piece[hits]) > 0)))
    ends = np.append(new[1:], len(hits)) - 1
    return [
        (pieces[p]["row"], pieces[p]["unit"], low, high)
        for p, low, high in zip(
            piece[hits[new]].tolist(), offset[hits[ends]].tolist(), offset[hits[new]].tolist(), strict=True
        )
    ]


def _identifiers(data: np.ndarray, length: int) -> np.ndarray:
    """An identifier of the ``length`` bytes at each place, from those of half as many here and later."""
    size, n = 8, len(data) - 7
    names = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()
    while size < length:
        later = min(size, length - size)
        n -= later
        names = mix(mix(names[:n] * _A + np.uint64(size)) + names[later : later + n] * _B)
        size += later
    return names


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = pc.fill_null(part.column("text").cast(pa.large_binary()), b"").to_pylist()
                spans = part.column("spans").to_pylist()
                hits: list[list[tuple[int, int]]] = [[] for _ in texts]
                if any(spans):
                    ranges = [_by_unit(s) for s in spans]
                    places = _hashed_units(part.column("text"), length)
                    _, offsets = text_bytes(part.column("text"))
                    begin = offsets.tolist()
                    for i, first, last, anchor, _, whole, _ in places:
                        for low, high in ranges[i].get(whole, ()):
                            a, b = max(first, anchor - high), min(last, anchor - low)
                            if a <= b:
                                hits[i].append((a - begin[i], b - begin[i] + length))
                removed, count, kept = [], [], []
                for text, found in zip(texts, hits, strict=True):
                    out, end, gone, runs = [], 0, 0, 0
                    start = None
                    for a, b in found:  # ascending, as units are
                        if start is None or a > end:
                            if start is not None:
                                gone += end - start
                            out.append(text[end if start is not None else 0 : a])
                            start, end, runs = a, b, runs + 1
                        else:
                            end = max(end, b)
                    if start is not None:
                        gone += end - start
                    out.append(text[end:])
                    removed.append(gone)
                    count.append(runs)
                    kept.append(b"".join(out))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(count, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def _by_unit(spans: list[dict] | None) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    # From the largest offset on, so that the strings come in the order of the text.
    for span in sorted(spans or (), key=lambda s: -s["high"]):
        out.setdefault(span["unit"], []).append((span["low"], span["high"]))
    return out

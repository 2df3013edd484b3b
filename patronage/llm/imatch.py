"""I-Match fingerprints with randomised lexicons.

A term (word) is in the lexicon if its inverse document frequency over the whole corpus lies in a band.
A fingerprint has one signature for the whole lexicon and one for each of 176 random subsets
of it: the hash of the document's sorted distinct terms in that subset. The subsets keep 1/8 down to
1/2^24 of the terms, eight draws each, so that short and long texts alike have subsets with one or
two of their terms, which survive an edit. A signature starts with its number of terms (one digit); likeness is
the share of equal signatures among those that have one or two terms on either side.

Size of the lexicon: a term of the band is in at least a share exp(-max_idf) of the documents, so
there are at most exp(max_idf) x (mean distinct terms of a document) of them, whatever the
corpus. Beyond ``MAX_LEXICON`` terms, those with the lowest hashes stand for the rest (one more random subset).

Nulls: a null text is the empty text. A text without terms of the band is fingerprinted by all its terms; the empty
text has empty signatures. Equal texts have equal fingerprints, and equal fingerprints have likeness 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import (
    NULL_ID, by_block, chunks, integers, known_id, ordered_blocks, text_bytes, texts,
)
from patronage.llm.words import hash_words, mix, seeds, shingle_sets

MIN_IDF, MAX_IDF = math.log(10), math.log(1000)
MAX_LEXICON = 1 << 21

#: Subset i keeps the terms whose i-th hash lies in the lowest 1/2**_LEVELS[i].
_LEVELS = np.repeat(np.arange(3, 11), 8)
_SEEDS = seeds(len(_LEVELS), 4)
#: The levels after those have eight hashes together: level l keeps the terms whose hash starts with l - 1 zeros and a one.
_FAR = np.arange(11, 25)
_FAR_SEEDS = seeds(8, 5)
_DIGITS = 6
_EMPTY = "0" * _DIGITS

#: Terms that a task counts before it hands them on.
_COUNTED = 1 << 21


def lexicon(docs: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> np.ndarray:
    """Sorted hashes of the terms of the band; document frequencies are over all of ``docs``."""
    n = docs.count()
    counted = docs.select("text").mapInArrow(_count_terms, "term long, docs long")
    frequent = counted.groupBy("term").agg(F.sum("docs").alias("docs"))
    low, high = n * math.exp(-max_idf), n * math.exp(-min_idf)
    band = frequent.filter(F.col("docs").between(low, high)).select("term")
    kept = band.orderBy(F.xxhash64("term"), "term").limit(MAX_LEXICON)
    terms = kept.toArrow().column("term").to_numpy()
    return np.sort(terms.view(np.uint64))


def fingerprints(docs: DataFrame, terms: np.ndarray, column: str = "text") -> DataFrame:
    """``docs`` with the column ``fingerprint`` (replaced if there is one)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for part in chunks(batch, "text") for f in _of_texts(part.column("text"), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, pa.string())], ["doc", "fingerprint"])

    schema = rows.select("doc").schema.add("fingerprint", "string")
    keep = [f"doc.`{c}`" for c in docs.columns if c != "fingerprint"]
    return rows.mapInArrow(run, schema).select(*keep, "fingerprint")


def likeness(a: str, b: str) -> float:
    """Share of equal signatures among those of few terms on either side; 1 for equal fingerprints.
    Where no signature has few terms, all that are not empty count."""
    if a == b:
        return 1.0
    pairs = [(a[i : i + _DIGITS], b[i : i + _DIGITS]) for i in range(0, len(a), _DIGITS)]
    few = [x == y for x, y in pairs if x[0] in "12" or y[0] in "12"]
    some = few or [x == y for x, y in pairs if x != _EMPTY or y != _EMPTY]
    return sum(some) / len(some)


def compare_with_edits(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and how alike they are.

    Documents are taken by descending doc_id (ties by a hash of the text), the first following the last. The edited text
    has its last floor(n_chars / 3) code points replaced by as many (or all) of the next document.
    Documents are dealt to ranges of doc_id and streamed in order; each range also gets the first
    row of the next one. Texts are compressed on the way."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    rows = docs.select(known_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("id", F.bitwise_not("id").alias("key"), "text")
    numbered, blocks = ordered_blocks(rows, "key")
    heads = sorted(numbered.groupBy("block").agg(F.min("key")).collect())  # at most MAX_BLOCKS
    follows = [(key, heads[i - 1][0]) for i, (_, key) in enumerate(heads)]
    # Joined before the texts are packed; the side to broadcast has a row per block.
    heads_df = docs.sparkSession.createDataFrame(follows, "key long, also long")
    also = numbered.join(F.broadcast(heads_df), "key", "left")
    packed = also.mapInArrow(
        _fingerprint_and_pack(shared),
        "key long, tie long, block int, also int, id long, n_chars long, fingerprint string, packed binary",
    )
    places = F.array(F.struct("block", F.lit(0).alias("ahead")), F.struct(F.col("also").alias("block"), F.lit(1).alias("ahead")))
    dealt = packed.withColumn("place", F.explode(places)).filter("place.block is not null")
    dealt = dealt.select("place.*", "key", "tie", "id", "n_chars", "fingerprint", "packed")
    ordered = by_block(dealt, blocks, ["ahead", "key", "tie"])
    return ordered.mapInArrow(
        _compare(shared),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "docs"])

    waiting: list[np.ndarray] = []
    for batch in batches:
        for part in chunks(batch, "text"):
            waiting += _terms(part.column("text"))
            if sum(map(len, waiting)) < _COUNTED:
                continue
            terms, counts = _merge(terms, counts, waiting)
            waiting = []
            if len(terms) > _COUNTED:
                yield rows()
                terms, counts = terms[:0], counts[:0]
    terms, counts = _merge(terms, counts, waiting)
    yield rows()


def _merge(terms: np.ndarray, counts: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    more, more_counts = np.unique(np.concatenate([*sets, terms[:0]]), return_counts=True)
    out, where = np.unique(np.concatenate([terms, more]), return_inverse=True)
    summed = np.bincount(where, np.concatenate([counts, more_counts]), len(out))
    return out, summed.astype(np.int64)


def _terms(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct terms of each text."""
    return shingle_sets(*hash_words(*text_bytes(column)), 1)


def _of_texts(column: pa.Array, terms: np.ndarray) -> list[str]:
    return [_fingerprint(own, terms) for own in _terms(column)]


def _fingerprint(own: np.ndarray, terms: np.ndarray) -> str:
    if len(own) and len(terms):
        at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
        band = own[terms[at] == own]
        own = band if len(band) else own
    if not len(own):
        return _EMPTY * (1 + len(_LEVELS) + len(_FAR) * len(_FAR_SEEDS))
    draws = mix(own[None, :] ^ _SEEDS[:, None]) >> (64 - _LEVELS).astype(np.uint64)[:, None]
    subsets = [own, *(own[row] for row in draws == 0)]
    return "".join([_signature(s) if len(s) else _EMPTY for s in subsets] + _far_signatures(own))


def _far_signatures(own: np.ndarray) -> list[str]:
    out = [_EMPTY] * (len(_FAR) * len(_FAR_SEEDS))
    draws = mix(own[None, :] ^ _FAR_SEEDS[:, None])
    draw, term = np.nonzero(draws < np.uint64(1 << (65 - int(_FAR[0]))))
    # Number of the level, counted from the last: its smallest hash is a power of two.
    borders = np.uint64(1) << (64 - _FAR[::-1]).astype(np.uint64)
    level = len(_FAR) - np.searchsorted(borders, draws[draw, term], side="right")
    draw, term, level = (x[level < len(_FAR)] for x in (draw, term, level))
    place = level * len(_FAR_SEEDS) + draw
    order = np.argsort(place, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        if len(part):
            out[place[part[0]]] = _signature(own[term[part]])
    return out


def _signature(sorted_terms: np.ndarray) -> str:
    return f"{min(len(sorted_terms), 15):x}{xxhash.xxh3_64_intdigest(sorted_terms.tobytes()) >> 44:05x}"


def _fingerprint_and_pack(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in chunks(batch, "text"):
                whole = texts(part.column("text"))
                data = [t.encode() for t in whole]
                ties = np.array([xxhash.xxh3_64_intdigest(t) for t in data], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(ties), part.column("block"), part.column("also").cast(pa.int32()),
                     part.column("id"), pa.array([len(t) for t in whole], pa.int64()),
                     pa.array(_of_texts(part.column("text"), shared.value), pa.string()),
                     pa.array([squeeze.compress(t) for t in data], pa.binary())],
                    ["key", "tie", "block", "also", "id", "n_chars", "fingerprint", "packed"],
                )

    return run


def _compare(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        last = None  # a row that waits for the one after it
        for batch in batches:
            for part in chunks(batch, "packed", 1 << 20):
                pairs = []
                columns = [part.column(c).to_pylist() for c in ("block", "ahead", "id", "n_chars", "fingerprint", "packed")]
                for block, ahead, owner, n, mark, packed in zip(*columns, strict=True):
                    row = (block, owner, n, mark, expand.decompress(packed).decode())
                    if last and last[0] == block:
                        pairs.append((last, row))
                    # What comes after a range's last row is its successor, not a row of the range.
                    last = None if ahead else row
                if pairs:
                    yield _judged(pairs, shared.value)

    return run


def _judged(pairs: list[tuple], terms: np.ndarray) -> pa.RecordBatch:
    edited = [own[4][: own[2] - own[2] // 3] + after[4][: own[2] // 3] for own, after in pairs]
    marks = _of_texts(pa.array(edited, pa.large_string()), terms)
    own, after = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None if r[1] == NULL_ID else r[1] for r in own], pa.int64()),
            pa.array([r[2] for r in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([r[3] for r in own]),
            pa.array(marks),
            pa.array([likeness(r[3], m) for r, m in zip(own, marks, strict=True)]),
            pa.array([likeness(r[3], a[3]) for r, a in zip(own, after, strict=True)]),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )

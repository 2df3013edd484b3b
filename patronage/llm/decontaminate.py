"""Benchmark decontamination by spaced seeds.

Tokens are words without ASCII signs, lower-cased, and single characters of scripts without blanks. A mask looks at seven positions of a window of 8 to 13 tokens
and ignores the others, so a window matches in spite of substitutions there. The seven masks were chosen so that any
13 to 25 tokens of which four fifths are equal have a hit, wherever the others are (the tests go through all places);
a longer stretch with that share has a part of 13 to 25 tokens with it, too. The masked hashes of the test items are joined with those of all documents; around each
hit the document and the item are laid side by side and compared token by token. A document leaks an item if
in some stretch of at least ``min_tokens`` tokens the share ``min_share`` of them is equal.

A bitmap of the items' hashes keeps windows that cannot match from leaving the scan. It has 64 bits for each
window, at most ``MAX_BITMAP_BITS`` in all: more items make it less selective, not larger, and the join is exact.
Hits in one neighbourhood of a document travel as one row with the tokens around them; an overlap with a damaged gap of
over a hundred tokens is reported by its longer part.

An item of fewer than ``min_tokens`` tokens has no such stretch. With ``short_items`` it is leaked by a document that holds
all its tokens one after the other: such an item has one window, under a mask that looks at all its positions, and the
documents' windows of the lengths of such items are hashed, too. Without, such items are not looked for.
Nulls: null texts have no tokens; null ids stay null, rows that share a doc_id are told apart by 128 bits
of hashes of their text.
Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import NULL_ID, chunks, integers, known_id, store, text_bytes
from patronage.llm.words import hash_words, mix, seeds

MASKS = (
    "11110111", "110100010111", "11101001011", "1100110011001", "1100101001011", "1000011001111", "1111000110001",
)

#: The masks find all stretches with at least these.
MIN_TOKENS, MIN_SHARE = 13, 0.8

#: Tokens that go with a hit on either side of it.
AROUND = 48

MAX_BITMAP_BITS = 1 << 28

#: Windows of the items are broadcast up to this number (24 bytes each); beyond it the planner picks the join.
BROADCAST_WINDOWS = 1 << 21

_NEAR = "id long, row long, row2 long, start int, tokens array<long>, places array<int>, hashes array<long>"


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    min_tokens: int = MIN_TOKENS,
    min_share: float = MIN_SHARE,
    short_items: bool = False,
) -> DataFrame:
    """(id, row, row2, item_id, n_tokens, n_equal): the items that a document leaks, with the longest stretch and how many of
    its tokens are equal. The first three are columns of :func:`with_keys`.

    ``docs``: doc_id, text; ``items``: item_id, text."""
    if min_tokens < MIN_TOKENS or min_share < MIN_SHARE:
        raise ValueError(f"The masks find stretches of {MIN_TOKENS} tokens and a share of {MIN_SHARE} or more, not less.")
    spark = docs.sparkSession
    listed = items.select(known_id("item_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    windows = store(
        listed.mapInArrow(
            _item_windows(min_tokens, short_items), "item_id long, tokens array<long>, places array<int>, hashes array<long>"
        )
    )
    size = F.size("tokens")
    lengths = windows.filter((size > 0) & (size < min_tokens)).select(size.alias("n")).distinct().collect() if short_items else []
    masks = [*MASKS, *("1" * r.n for r in lengths)]  # fewer than min_tokens lengths
    spread = windows.select("item_id", F.explode(F.arrays_zip("places", "hashes")).alias("w")).select(
        "item_id", F.col("w.places").alias("item_place"), F.col("w.hashes").alias("hash")
    )
    n = spread.count()
    bitmap = spark.sparkContext.broadcast(_bitmap(spread, n))
    near = store(with_keys(docs).select("id", "row", "row2", "text").mapInArrow(_doc_hits(bitmap, masks), _NEAR))
    place = ["id", "row", "row2", "start"]
    hits = near.select(*place, F.explode(F.arrays_zip("places", "hashes")).alias("w")).select(
        *place, F.col("w.places").alias("place"), F.col("w.hashes").alias("hash")
    )
    side = F.broadcast(spread) if n <= BROADCAST_WINDOWS else spread
    shift = (F.col("place") - F.col("item_place")).alias("shift")
    # The tokens around a hit travel once for each item, with all the ways the two lie side by side.
    aligned = hits.join(side, "hash").select(*place, "item_id", shift).groupBy(*place, "item_id")
    aligned = aligned.agg(F.collect_set("shift").alias("shifts"))
    laid = aligned.join(near.select(*place, "tokens"), place).join(
        windows.select("item_id", F.col("tokens").alias("item_tokens")), "item_id"
    )
    found = laid.mapInArrow(
        _verify(min_tokens, min_share), "id long, row long, row2 long, item_id long, n_tokens long, n_equal long"
    )
    best = F.max(F.struct("n_tokens", "n_equal")).alias("best")
    grouped = found.groupBy("id", "row", "row2", "item_id").agg(best)
    item_id = F.when(F.col("item_id") != NULL_ID, F.col("item_id")).alias("item_id")
    return grouped.select("id", "row", "row2", item_id, "best.*")


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


def without_leaks(docs: DataFrame, items: DataFrame, short_items: bool = False) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    leaking = find_leaks(docs, items, short_items=short_items).select("id", "row", "row2").distinct()
    kept = with_keys(docs).drop("text").join(leaking.hint("shuffle_hash"), ["id", "row", "row2"], "left_anti")
    return kept.select("doc.*")


def masked_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """One hash per window."""
    n = max(0, len(tokens) - len(mask) + 1)
    out = np.full(n, xxhash.xxh3_64_intdigest(mask), np.uint64)
    for i, (looked_at, step) in enumerate(zip(mask, seeds(len(mask), 13), strict=True)):
        if looked_at == "1":
            out += tokens[i : i + n] * step
    return mix(out)


def longest_stretch(equal: np.ndarray, min_tokens: int, min_share: float) -> tuple[int, int]:
    """Length and number of equal tokens of the longest stretch of at least ``min_tokens`` whose share of equal tokens is
    ``min_share`` or more; (0, 0) if there is none."""
    counts = np.append(0, np.cumsum(equal))
    places = np.arange(len(counts))
    # Whole numbers: a share of 0.8 must not fail by rounding. A stretch fits if this does not fall from its start to its end.
    level = 1000 * counts - round(1000 * min_share) * places
    lowest = np.minimum.accumulate(level)
    start = np.searchsorted(-lowest, -level, side="left")  # the first place that is not above
    length = places - start
    best = int(length.max())
    if best < min_tokens:
        return 0, 0
    return best, int((counts - counts[start])[length == best].max())


def _bitmap(windows: DataFrame, n: int) -> np.ndarray:
    """Bytes of the bitmap; two bits for each window. At most MAX_BITMAP_BITS / 64 numbers reach the driver."""
    bits = min(MAX_BITMAP_BITS, 1 << max(16, (64 * n - 1).bit_length()))
    both = F.array(F.col("hash"), F.shiftrightunsigned("hash", 32))
    bit = windows.select(F.explode(both).alias("place")).select(F.pmod("place", F.lit(bits)).alias("bit"))
    word = F.shiftright("bit", 6).cast("int").alias("word")
    value = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int")).alias("value")
    found = bit.select(word, value).groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("value").to_numpy()
    return words.view(np.uint8)


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(hashes.shape, bool)
    for shift in (0, 32):
        place = (hashes >> np.uint64(shift)) & np.uint64(8 * len(bitmap) - 1)
        out &= (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _passing(
    bitmap: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, mask: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, text and hash of the windows that pass the bitmap."""
    hashes = masked_hashes(tokens, mask)
    place = np.flatnonzero(_passes(bitmap, hashes))
    owner = np.searchsorted(bounds, place, side="right") - 1
    inside = place + len(mask) <= bounds[owner + 1]  # a window that crosses into the next text is none
    return place[inside], owner[inside], hashes[place[inside]]


def _item_windows(min_tokens: int, short_items: bool):
    def masks(n: int) -> tuple[str, ...]:
        if n >= min_tokens:
            return MASKS
        return ("1" * n,) if n and short_items else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places = hash_words(*text_bytes(batch.column("text")), plain=True, single=True)
            own = [tokens[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
            none = np.zeros(0, np.uint64)
            hashes = [[none, *(masked_hashes(t, mask) for mask in masks(len(t)))] for t in own]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id"),
                    _lists(own, pa.int64()),
                    _lists([np.concatenate([np.arange(len(m)) for m in h]) for h in hashes], pa.int32()),
                    _lists([np.concatenate(h) for h in hashes], pa.int64()),
                ],
                ["item_id", "tokens", "places", "hashes"],
            )

    return run


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, parts[0].dtype if parts else np.int64)])
    values = flat.view(np.int64) if flat.dtype == np.uint64 else flat
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def _doc_hits(shared, masks: list[str]):
    span = max(map(len, masks))
    names = ["id", "row", "row2", "start", "tokens", "places", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                tokens, bounds = hash_words(*text_bytes(part.column("text")), plain=True, single=True)
                ids, rows, rows2 = (integers(part.column(c)) for c in ("id", "row", "row2"))
                hits = [_passing(bitmap, tokens, bounds, mask) for mask in masks]
                place, owner, hashes = (np.concatenate(column) for column in zip(*hits, strict=True))
                order = np.argsort(place, kind="stable")
                place, owner, hashes = place[order], owner[order], hashes[order]
                if not len(place):
                    continue
                apart = (place[1:] - place[:-1] > span + 2 * AROUND) | (owner[1:] != owner[:-1])
                groups = np.split(np.arange(len(place)), np.flatnonzero(apart) + 1)
                of = [int(owner[g[0]]) for g in groups]
                first = [max(int(bounds[o]), int(place[g[0]]) - AROUND) for g, o in zip(groups, of, strict=True)]
                last = [
                    min(int(bounds[o + 1]), int(place[g[-1]]) + span + AROUND) for g, o in zip(groups, of, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[of]),
                        pa.array(rows[of]),
                        pa.array(rows2[of]),
                        pa.array([f - int(bounds[o]) for f, o in zip(first, of, strict=True)], pa.int32()),
                        _lists([tokens[f:e] for f, e in zip(first, last, strict=True)], pa.int64()),
                        _lists([place[g] - bounds[o] for g, o in zip(groups, of, strict=True)], pa.int32()),
                        _lists([hashes[g] for g in groups], pa.int64()),
                    ],
                    names,
                )

    return run


def _verify(min_tokens: int, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            names = ("id", "row", "row2", "item_id", "start", "shifts", "tokens", "item_tokens")
            columns = [batch.column(c) for c in names]
            for i in range(batch.num_rows):
                *keys, start = (c[i].as_py() for c in columns[:5])
                shifts, doc, item = (c[i].values.to_numpy() for c in columns[5:])
                best = (0, 0)
                for shift in shifts.tolist():
                    # Token j of the item lies beside token j + shift of the document, place j + shift - start of the slice.
                    low, high = max(0, start - shift), min(len(item), start - shift + len(doc))
                    equal = item[low:high] == doc[low + shift - start : high + shift - start]
                    if len(item) >= min_tokens:
                        best = max(best, longest_stretch(equal, min_tokens, min_share))
                    elif len(equal) == len(item) and equal.all():
                        best = (len(item), len(item))
                if best[0]:
                    found.append((*keys, *best))
            columns = list(zip(*found, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["id", "row", "row2", "item_id", "n_tokens", "n_equal"]
            )

    return run

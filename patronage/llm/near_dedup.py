"""Near-duplicate documents: MinHash bands for candidates, odd sketches to judge them, full sets to confirm.

Each text's 128 MinHash samples of its word shingles make 32 bands of four; documents with a band in
common are candidates (a pair of similarity 0.8 shares none with probability 5e-8). The samples are also folded
into an odd sketch: each flips one of 512 bits, so that the ones in the XOR of two sketches tell how
many samples differ. Pairs whose sketches differ far more than any pair of similarity 0.8 are dropped;
those left are confirmed on their whole sets.

Equal sets are one class from the start, whatever the number of copies. The others are dealt to cells of about 1024
documents: documents that share bands mostly get one label, and a label's documents are sliced by a hash. Every two cells
that have a band in common make a unit, the work of one task, whose memory is bounded by two cells. Each pair of documents with a
common band meets in just one unit. There, pairs are tried from the most alike on, and only if they
are not connected yet; a unit returns the links that connect its documents, fewer than it has documents. A document is a
row in each unit of its cell, so m near copies of one text make about m * m / 1024 rows in all, over as many tasks.

Nulls: a null or empty text has no shingles and is linked with nothing; a row without doc_id is a group of its own
(component null, kept). Rows with one doc_id count as one document that has the links of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import chunks, store, text_bytes
from patronage.llm.components import connected
from patronage.llm.words import hash_words, mix, seeds, shingle_sets

BANDS, ROWS = 32, 4
SKETCH_BITS = 512

#: Documents of a cell, and shingles of a cell; a unit holds the sets of two cells at most (64 MB).
CELL, CELL_SHINGLES = 1024, 4 << 20

_SAMPLES = BANDS * ROWS
_XOR, _TIMES = seeds(_SAMPLES, 21), seeds(_SAMPLES, 22)
_BAND_STEPS = seeds(ROWS, 23)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text): documents are linked if
    their sets of ``shingle_words``-word shingles have an intersection of ``percent`` % of the union or more;
    ``component_id`` is the smallest doc_id reachable over links."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = store(rows.mapInArrow(_sign(shingle_words), _SIGNED))
    linked = signed.filter("n > 0 and id is not null")
    # Copies of one set: the smallest doc_id stands for them.
    classes = linked.groupBy("set1", "set2").agg(F.min("id").alias("class"))
    members = store(linked.select("id", "set1", "set2").join(classes, ["set1", "set2"]).select("id", "class").distinct())
    heads = classes.select(F.col("class").alias("id"), "set1", "set2")
    heads = linked.join(heads, ["id", "set1", "set2"], "left_semi").dropDuplicates(["id", "set1", "set2"])
    heads = store(heads.select("id", "n", "bands", "sketch"))
    links = _links(heads, rows, shingle_words, percent)
    # Rows that share a doc_id but not a text belong together, too.
    links = links.unionByName(members.filter("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b")))
    found = connected(links)
    out = signed.select("id", "n").join(found, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _links(heads: DataFrame, rows: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between representatives that connect whatever is connected."""
    exploded = heads.select("id", "n", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("center")).filter("size > 1")
    groups = store(exploded.join(shared, "band").select("band", "id", "n", "center"))
    # The smallest id that a document shares a band with: near copies of one another mostly have the same.
    labels = groups.groupBy("id").agg(F.min("center").alias("label"), F.max("n").alias("n"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    slices = F.greatest(F.ceil(F.col("members") / CELL), F.ceil(F.col("shingles") / CELL_SHINGLES))
    cell = F.xxhash64("label", F.pmod(F.xxhash64("id"), slices)).alias("cell")
    placed = groups.select("band", "id").join(labels.join(sizes, "label").select("id", cell), "id")
    units = store(_units(placed))
    sets = _sets(rows, groups.select("id").distinct(), shingle_words)
    dealt = units.join(sets, "id").join(heads.select("id", "sketch"), "id")
    work = dealt.groupBy("first", "second").applyInArrow(_connect(percent), "a long, b long")
    return store(work.distinct())


def _units(placed: DataFrame) -> DataFrame:
    """(first, second, id, cell): the documents of every two cells that share a band, as far as they share it."""
    cells = placed.groupBy("band", "cell").agg(F.count("*").alias("n"))
    cells = cells.select("band", F.col("cell").alias("other"), "n")
    met = placed.join(cells, "band").filter("cell <> other or n > 1")
    return met.select(
        F.least("cell", "other").alias("first"), F.greatest("cell", "other").alias("second"), "id", "cell"
    ).distinct()


def _connect(percent: int):
    most = _most_different(percent)

    def run(key: tuple, unit: pa.Table) -> pa.Table:
        first, second = key[0].as_py(), key[1].as_py()
        ids, cells = unit.column("id").to_numpy(), unit.column("cell").to_numpy()
        order = np.lexsort((ids, cells != first))
        ids, cells = ids[order], cells[order]
        sets = [np.asarray(unit.column("shingles")[i].values) for i in order.tolist()]
        sketches = np.stack([np.asarray(unit.column("sketch")[i].values) for i in order.tolist()]).view(np.uint64)
        sizes = np.array([len(s) for s in sets])
        left = np.arange(len(ids)) if first == second else np.flatnonzero(cells == first)
        right = left if first == second else np.flatnonzero(cells == second)
        found = []
        for i in left.tolist():
            partners = right[right > i] if first == second else right
            fits = 100 * np.minimum(sizes[i], sizes[partners]) >= percent * np.maximum(sizes[i], sizes[partners])
            partners = partners[fits]
            apart = np.bitwise_count(sketches[partners] ^ sketches[i]).sum(axis=1)
            near = apart <= most
            found.append((apart[near], np.full(near.sum(), i), partners[near]))
        apart, one, other = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([], [], [])
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        nearest_first = np.argsort(apart, kind="stable")
        for i, j in zip(one[nearest_first].tolist(), other[nearest_first].tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y and _similar(sets[i], sets[j], percent):
                root[x] = y
                links.append((int(ids[i]), int(ids[j])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``percent`` % of their union in common."""
    if len(one) < len(other):
        one, other = other, one
    at = np.minimum(np.searchsorted(one, other), len(one) - 1)
    common = int(np.count_nonzero(one[at] == other))
    return 100 * common >= percent * (len(one) + len(other) - common)


def _most_different(percent: int) -> int:
    """Bits by which sketches of a pair of similarity ``percent`` % can differ: seven deviations allowed for."""
    share = 1 - percent / 100
    samples = min(_SAMPLES, share * _SAMPLES + 7.5 * (share * (1 - share) * _SAMPLES) ** 0.5 + 1)
    bits = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * samples))
    return int(bits + 14)


def _sets(rows: DataFrame, ids: DataFrame, shingle_words: int) -> DataFrame:
    """(id, shingles) of the documents with these ids, sorted as signed numbers."""
    wanted = rows.join(ids.hint("shuffle_hash"), "id", "left_semi")
    return wanted.mapInArrow(_shingles(shingle_words), "id long, shingles array<long>")


_SIGNED = "id long, n long, set1 long, set2 long, bands array<long>, sketch array<long>"


def _sign(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(*hash_words(*text_bytes(part.column("text"))), shingle_words)
                samples = np.stack([min_hashes(s) for s in sets])
                digests = b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets])
                halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(halves[:, 0].copy()),
                        pa.array(halves[:, 1].copy()),
                        _fixed_lists(bands(samples)),
                        _fixed_lists(odd_sketches(samples)),
                    ],
                    ["id", "n", "set1", "set2", "bands", "sketch"],
                )

    return run


def _shingles(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(*hash_words(*text_bytes(part.column("text"))), shingle_words)
                offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                values = pa.array(np.concatenate([np.sort(s.view(np.int64)) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "shingles"]
                )

    return run


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each of the hash functions over the set; all ones for the empty set."""
    out = np.full(_SAMPLES, 2**64 - 1, np.uint64)
    for start in range(0, len(shingles), 1024):
        values = (shingles[start : start + 1024, None] ^ _XOR) * _TIMES
        np.minimum(out, values.min(axis=0), out=out)
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    """One number per band of each row of samples; the band's place is part of it."""
    grouped = samples.reshape(len(samples), BANDS, ROWS)
    return mix((grouped * _BAND_STEPS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Each sample flips the bit that a hash of its place and value names; eight 64-bit words a row."""
    bit = mix(samples + np.arange(_SAMPLES, dtype=np.uint64) * _TIMES) & np.uint64(SKETCH_BITS - 1)
    flips = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    np.add.at(flips, (np.arange(len(samples))[:, None], bit.astype(np.int64)), 1)
    return np.packbits(flips & 1, axis=1, bitorder="little").view(np.uint64)


def _fixed_lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel().view(np.int64)))

"""Periodic runs of words: stretches that repeat themselves at a fixed distance, and texts without the repeats.

A run is a stretch with smallest period q, of at least ``min_words`` words and two periods, that no neighbouring word
extends. Two words q apart are equal on a *diagonal* of lag q, so a run is a long enough stretch of one diagonal.

Seeds: for lags from k to 2k such a stretch has at least k words (half of ``min_words`` for all smaller lags), so the
k-grams of a document are indexed for k = 6, 12, 24, ..., and only repeated k-grams can be part of a repeated 2k-gram.
Pairs of places of one k-gram whose lag belongs to k are extended along their diagonal; a table of the furthest place
covered on each lag drops further pairs of the same stretch.

A k-gram that overlaps itself with period d <= k/2 occurs in chains of step d. Pairs inside a chain have a multiple
of d as lag, which is not a smallest period. Between two chains a stretch ends where one of both does, so the first and
the last two places of the earlier chain meet every stretch; only these are paired. Pairs so number at most a few for each
place and size, and a text of one word repeated costs no more than any other (the tests compare with all pairs).

Nulls: a null text has no words; doc_id is carried only and may be null or repeated. Texts without words have no runs
and collapse to the empty text. An empty table gives an empty result; extra columns are ignored. Words are told
apart by 64-bit hashes. One text is one value and is searched in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import chunks, text_bytes
from patronage.llm.words import hash_words, mix, seeds

_OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_STEPS = seeds(64, 11)

Run = tuple[int, int, int]


def periodic_runs(docs: DataFrame, min_words: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: ``runs`` ordered by start, then period; ``collapsed`` has the words
    that no run contains after its first period, joined by one blank."""
    if not 2 <= min_words <= 2 * len(_STEPS):
        raise ValueError(f"min_words must be from 2 to {2 * len(_STEPS)}")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_search(min_words), _OUT)


def find_runs(words: np.ndarray, min_words: int = 12) -> list[Run]:
    """(start, length, period) of all runs of a sequence of word hashes, by start, then period."""
    k = (min_words + 1) // 2
    grams = _gram_ids(words, k)
    runs, lowest = [], 1
    while grams is not None and 2 * lowest <= len(words):
        places, ids = grams
        at, lag = _seeds(places, ids, k, lowest)
        runs += _extend(words, at, lag, k, min_words)
        lowest, grams, k = 2 * k, _double(places, ids, k), 2 * k
    return sorted(runs, key=lambda run: (run[0], run[2]))


def without_repeats(n: int, runs: list[Run]) -> np.ndarray:
    """Numbers of the words that no run contains after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return np.flatnonzero(keep)


def _gram_ids(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and ids of the k-grams that occur twice or more, by id, then place; None without any."""
    if len(words) <= k:
        return None
    return _repeated(np.arange(len(words) - k + 1), _windows(words, k))


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    sums = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        sums += words[i : len(sums) + i] * _STEPS[i]
    return mix(sums)


def _repeated(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])
    twin = ~new | np.append(~new[1:], False)
    if not twin.any():
        return None
    return places[order][twin], np.cumsum(new)[twin]


def _double(places: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The repeated 2k-grams, from the ids of both halves."""
    by_place = np.argsort(places)
    places, ids = places[by_place], ids[by_place]
    second = np.searchsorted(places, places + k)
    second[second == len(places)] = 0
    both = places[second] == places + k
    if not both.any():
        return None
    return _repeated(places[both], ids[both] * (ids.max() + 1) + ids[second[both]])


def _seeds(places: np.ndarray, ids: np.ndarray, k: int, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of pairs that meet every run whose period is from ``lowest`` to 2k - 1."""
    n = len(places)
    step = np.append(np.where(ids[1:] == ids[:-1], places[1:] - places[:-1], 0), 0)
    # The last place of a chain: the next place of the gram is over half a gram away, or there is none.
    last = (step == 0) | (2 * step > k)
    first = np.append(True, last[:-1])
    chain_end = np.flatnonzero(last)[np.cumsum(first) - 1]
    anchor = np.flatnonzero(first | last | np.append(last[1:], False))
    span = 2 * (int(places.max()) + 2 * k + 1)
    key = ids * span + places
    begin = np.maximum(np.searchsorted(key, key[anchor] + k), chain_end[anchor] + 1)
    count = np.maximum(np.searchsorted(key, key[anchor] + 2 * k) - begin, 0)
    source = np.repeat(anchor, count)
    partner = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    at, lag = places[source], places[partner] - places[source]
    if lowest < k:  # shorter lags than the gram: next places of it
        close = np.flatnonzero((step > 0) & (step < k))
        at, lag = np.append(at, places[close]), np.append(lag, step[close])
    return at, lag


def _extend(words: np.ndarray, at: np.ndarray, lag: np.ndarray, k: int, min_words: int) -> list[Run]:
    if not len(at):
        return []
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    follows = np.append(False, (lag[1:] == lag[:-1]) & (at[1:] == at[:-1] + 1))
    runs, period, covered = [], 0, 0
    for i, p in zip(at[~follows].tolist(), lag[~follows].tolist(), strict=True):
        if p != period:
            period, covered = p, 0
        if i < covered:
            continue
        end = i + _equal_ahead(words, i, i + p)
        start = i - _equal_ahead(words[::-1], len(words) - i, len(words) - i - p, swap=True)
        covered = end
        length = end - start + p
        if length >= max(min_words, 2 * p) and _primitive(words[start : start + p]):
            runs.append((start, length, p))
    return runs


def _equal_ahead(words: np.ndarray, a: int, b: int, swap: bool = False) -> int:
    """How many words from places a and b on are equal; with ``swap``, a is the place further on."""
    if swap:
        a, b = b, a
    n, same, width = len(words), 0, 32
    far = max(a, b)
    while far + same < n:
        stop = min(width, n - far - same)
        unequal = words[a + same : a + same + stop] != words[b + same : b + same + stop]
        if unequal.any():
            return same + int(np.argmax(unequal))
        same, width = same + stop, 4 * width
    return same


def _primitive(word: np.ndarray) -> bool:
    """False for a word that is a shorter one repeated."""
    p = rest = len(word)
    factor = 2
    while rest > 1:
        if rest % factor == 0:
            part = p // factor
            if np.array_equal(word[part:], word[:-part]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor = factor + 1 if factor * factor <= rest else max(rest, factor + 1)
    return True


def _search(min_words: int):
    k = (min_words + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                hashes, places = hash_words(data, offsets, fold=False)
                sizes = np.diff(places)
                suspects = _with_repeated_grams(hashes, places, k)
                texts = pc.fill_null(part.column("text").cast(pa.large_binary()), b"").to_pylist()
                runs, collapsed = [], []
                for i, text in enumerate(texts):
                    words = text.split()  # splits bytes at the same six blanks
                    found = find_runs(hashes[places[i] : places[i + 1]], min_words) if i in suspects else []
                    if found:
                        words = [words[j] for j in without_repeats(len(words), found).tolist()]
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    collapsed.append(b" ".join(words))
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind),
                     pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def _with_repeated_grams(hashes: np.ndarray, places: np.ndarray, k: int) -> set[int]:
    """Numbers of the texts in which a k-gram occurs twice: the others have no run."""
    if len(hashes) <= k:
        return set()
    owner = np.searchsorted(places, np.arange(len(hashes) - k + 1), side="right") - 1
    inside = np.arange(len(owner)) + k <= places[owner + 1]
    keys = _windows(hashes, k)[inside] ^ mix(owner[inside].astype(np.uint64))
    owner = owner[inside]
    order = np.argsort(keys)
    twins = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return set(owner[order[twins]].tolist())

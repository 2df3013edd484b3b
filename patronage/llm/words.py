"""64-bit hashes of words and word shingles, computed for many texts at once with numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z counts as a-z. With ``plain``, the other
ASCII signs separate words, too. With ``single``, each character of a script without blanks is a word, and the signs
of such scripts separate words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes that are hashed in one step; a longer word is hashed by itself.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_VALUE[_BLANK] = 0
_EXACT = np.arange(1, 257, dtype=np.uint64)
_SIGN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_powers: list[np.ndarray] = []

#: First character and the one after the last of Thai, Lao, Tibetan, Burmese; Khmer; Tai; Balinese; CJK radicals; CJK
#: marks, kana, bopomofo; ideographs; Javanese, Burmese; ideographs, narrow kana; kana, ideographs beyond 16 bits.
_SINGLE = np.array([
    0x0E00, 0x10A0, 0x1780, 0x1800, 0x1950, 0x19E0, 0x1A20, 0x1AB0, 0x1B00, 0x1B80, 0x2E80, 0x2FE0, 0x3005, 0x3008,
    0x3021, 0x302A, 0x3031, 0x3036, 0x3038, 0x303D, 0x3040, 0x30FB, 0x30FC, 0x3130, 0x31A0, 0x31C0, 0x31F0, 0x3200,
    0x3400, 0x4DC0, 0x4E00, 0xA000, 0xA980, 0xAA00, 0xAA60, 0xAA80, 0xF900, 0xFB00, 0xFF66, 0xFFA0, 0x1AFF0, 0x1B170,
    0x20000, 0x40000,
])
_SINGLE_SIGNS = np.array([
    0x3000, 0x3005, 0x3008, 0x3021, 0x3030, 0x3031, 0x303D, 0x3040, 0x30FB, 0x30FC, 0xFF01, 0xFF10, 0xFF1A, 0xFF21,
    0xFF3B, 0xFF41, 0xFF5B, 0xFF66,
])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` odd numbers that ``seed`` decides."""
    start = np.uint64((seed * 0xD1342543DE82EF95 + 1) & (2**64 - 1))
    return mix(start + np.arange(n, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            step = np.full(PIECE + 1, base, np.uint64)
            step[0] = 1
            _powers.append(np.multiply.accumulate(step))
    return _powers


def hash_words(
    data: np.ndarray, offsets: np.ndarray, plain: bool = False, single: bool = False, fold: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts that lie in ``data`` at ``offsets``, and for each text where
    its words start (one entry more than texts). Without ``fold``, A-Z differs from a-z."""
    value = _VALUE if fold else _EXACT
    starts, ends = word_places(data, offsets, plain, single)
    hashes = np.empty(len(starts), np.uint64)
    power, inverse = _power_tables()
    first = 0
    while first < len(starts):
        low = starts[first]
        last = int(np.searchsorted(ends, low + PIECE, side="right"))
        if last <= first:
            word = data[low : ends[first]].tobytes()
            hashes[first] = xxhash.xxh3_64_intdigest(word.lower() if fold else word)
            first += 1
            continue
        high = ends[last - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(value[data[low:high]] * power[: high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        hashes[first:last] = (sums[e] - sums[s]) * inverse[s]
        first = last
    hashes ^= (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix(hashes), np.searchsorted(starts, offsets)


def word_places(
    data: np.ndarray, offsets: np.ndarray, plain: bool = False, single: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~(_SIGN if plain else _BLANK)[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    if single:
        for size in (3, 4):
            place, code = _long_characters(data, size)
            own = place[np.searchsorted(_SINGLE, code, side="right") % 2 == 1]
            border[own] = border[own + size] = True
            signs = place[np.searchsorted(_SINGLE_SIGNS, code, side="right") % 2 == 1]
            for i in range(1, size + 1):
                inside[signs + i] = False
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
    return starts, ends


def _long_characters(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and code points of the characters of three or four bytes."""
    lead = data >= 0xF0 if size == 4 else (data >= 0xE0) & (data < 0xF0)
    place = np.flatnonzero(lead[: max(0, len(data) - size + 1)])
    code = data[place].astype(np.int64) & (0x0F if size == 3 else 0x07)
    for i in range(1, size):
        code = code << 6 | (data[place + i] & 0x3F)
    return place, code


_STEPS = seeds(64, 7)


def shingle_sets(words: np.ndarray, places: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``size``-word shingles. A text with fewer words has its
    whole sequence as one shingle, a text without words has none."""
    if len(words) >= size:
        windows = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            windows += words[i : len(windows) + i] * _STEPS[i]
        windows = mix(windows)
    out = []
    for first, last in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        n = last - first
        if n >= size:
            out.append(np.unique(windows[first : last - size + 1]))
        elif n:
            whole = words[first:last] * _STEPS[:n]
            out.append(mix(np.array([np.sum(whole) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

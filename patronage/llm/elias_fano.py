"""Elias-Fano code of a monotone sequence with a select structure.

A value's low bits are stored as they are; its high bits set bit (high + index) of a bit vector.
Every 512 bits of that vector the number of ones so far is noted in 32 bits, so ``select`` finds the
index-th one by a search over these notes and a count inside 512 bits. About
2 + log2(universe / n) bits a value, against 64 in a plain table.

Layout, little-endian: n (u64), universe (u64), low width (u8), low bits, high bits, notes (u32)."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQB")
_BLOCK = 512


def encode(values: np.ndarray) -> bytes:
    """``values``: non-negative, not decreasing."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    universe = int(values[-1]) + 1 if n else 0
    width = max(0, (universe // max(n, 1)).bit_length() - 1)
    shifts = np.arange(width, dtype=np.uint64)
    low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(_high_bits(n, universe, width), np.uint8)
    high[ones] = 1
    notes = np.add.reduceat(high, np.arange(0, len(high), _BLOCK), dtype=np.uint32)
    notes = np.append(0, np.cumsum(notes)[:-1]).astype("<u4")
    packed = (np.packbits(bits.ravel(), bitorder="little").tobytes() for bits in (low, high))
    return _HEAD.pack(n, universe, width) + b"".join(packed) + notes.tobytes()


def _high_bits(n: int, universe: int, width: int) -> int:
    """Whole blocks, at least one."""
    return -(-max(1, n + (universe >> width) + 1) // _BLOCK) * _BLOCK


class EliasFano:
    """Reader of the code; nothing is unpacked but what ``select`` looks at."""

    def __init__(self, data: bytes):
        self.n, universe, self.width = _HEAD.unpack_from(data)
        low_size = -(-self.n * self.width // 8)
        bits = _high_bits(self.n, universe, self.width)
        raw = np.frombuffer(data, np.uint8, offset=_HEAD.size)
        self.low, raw = raw[:low_size], raw[low_size:]
        self.high, raw = raw[: bits // 8], raw[bits // 8 :]
        self.notes = raw.view("<u4") if raw.ctypes.data % 4 == 0 else np.frombuffer(raw.tobytes(), "<u4")

    def select(self, index: np.ndarray) -> np.ndarray:
        """Values at ``index`` (any order)."""
        index = np.asarray(index, np.int64)
        if index.size and (index.min() < 0 or index.max() >= self.n):
            raise IndexError("select beyond the sequence")
        block = np.searchsorted(self.notes, index, side="right") - 1
        out = np.empty(len(index), np.uint64)
        size = _BLOCK // 8
        for start in range(0, len(index), 4096):  # 2 MB of bits at a time
            i, b = index[start : start + 4096], block[start : start + 4096]
            distinct, where = np.unique(b, return_inverse=True)
            bits = np.unpackbits(self.high.reshape(-1, size)[distinct], axis=1, bitorder="little")
            before, place = np.zeros(len(distinct) + 1, np.int64), np.flatnonzero(bits)
            np.cumsum(bits.sum(axis=1, dtype=np.int64), out=before[1:])
            nth = place[before[where] + i - self.notes[b]] % _BLOCK
            high = (b * _BLOCK + nth - i).astype(np.uint64)
            out[start : start + 4096] = (high << np.uint64(self.width)) | self._low_bits(i)
        return out

    def _low_bits(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.uint64)
        places = index[:, None] * self.width + np.arange(self.width)
        bits = (self.low[places >> 3] >> (places & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

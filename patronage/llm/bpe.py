"""Token ids of whole texts through the ``tokenizers`` library.

The library splits a text into pieces before it merges bytes, so a piece that recurs needs to be
encoded once only. Texts are cut where the library always cuts, too: before a single blank or line
feed that a visible character follows, and between a Latin letter and a sign that ends a clause. A slice of texts is cut at once in its UTF-8 bytes and its pieces are dictionary-encoded,
so Python sees each distinct piece of a slice once; ids are gathered by numpy. Of the pieces that a worker has not met
yet, those of Latin letters alone go straight to the library's merges, as nothing there is left to split; the others go
to the whole library together, one to a line. The ids are those of the whole text at once (the tests compare them)."""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from patronage.llm.common import text_bytes

# Tasks share the machine already: no threads inside the library.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LINE, _ANY_BLANK = re.compile(r"\n(?=\S)"), re.compile(r"\s")

#: A process forgets the older half of its pieces when it has this many; longer pieces are not kept.
CACHED_PIECES, CACHED_BYTES = 1_100_000, 64

#: UTF-8 of the white space beyond ASCII.
_WIDE_BLANKS = [chr(c).encode() for c in range(0x80, 0x3001) if chr(c).isspace()]
_ASCII_BLANK = np.array([bool(_ANY_BLANK.match(chr(b))) if b < 0x80 else False for b in range(256)])

#: Signs that never share a piece with a letter before them, and the letters of one byte, or of two bytes from C3 on.
_SIGNS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])
_LETTERS = np.array([chr(b).isalpha() and b < 0x80 for b in range(256)])
_SECOND = np.array([0x80 <= b < 0xC0 and chr(b + 0x40).isalpha() for b in range(256)])

_LETTERS_ONLY = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}


_loaded: dict[tuple[str, bool], "TextEncoder"] = {}


def encoder(path: str, blanks_count: bool) -> "TextEncoder":
    """One encoder for each file and worker process. A bare file name is one of the public
    tokenizers. ``blanks_count``: white space is part of the ids."""
    key = (path, blanks_count)
    if key not in _loaded:
        _loaded[key] = TextEncoder(path if "/" in path else public_tokenizers.path(path), blanks_count)
    return _loaded[key]


class TextEncoder:
    def __init__(self, path: str, blanks_count: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.blanks_count = blanks_count
        # Stands between the pieces of one call; no piece that goes with others holds it.
        self.mark = "\n" if blanks_count else "|"
        self.between = "\n" if blanks_count else " | "
        (self.mark_id,) = self._library(self.mark)
        self.known: dict[bytes, bytes] = {}
        self.feed = self._library("\n").tobytes()
        self.letters = _byte_letters()
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.direct = self._is_direct()

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers of ``dtype``; a null is the empty text."""
        ids, ends = self.encode_column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        data, width = ids.tobytes(), self.dtype.itemsize
        ends = (ends * width).tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids start (one entry more than texts)."""
        data, offsets = text_bytes(texts)
        cuts = self._cuts(data, offsets)
        # Pieces tile the bytes: a text starts one, and every cut.
        begins = np.zeros(len(data) + 1, bool)
        begins[cuts] = True
        begins[offsets] = True
        starts = np.flatnonzero(begins[:-1])
        borders = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        numbers = pieces.indices.to_numpy(zero_copy_only=False)
        table, lengths = self._ids_of(pieces.dictionary.to_pylist())
        first = np.cumsum(lengths) - lengths
        # Ids of piece i lie in the table from first[i] on: one gather for all places.
        sizes = lengths[numbers]
        ends = np.append(0, np.cumsum(sizes))
        places = np.repeat(first[numbers] - ends[:-1], sizes) + np.arange(ends[-1])
        return table[places], ends[np.searchsorted(starts, offsets)]

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places of the blanks, line feeds and signs that start a piece."""
        cuts = np.flatnonzero((data == 0x20) | (data == 0x0A))
        signs = np.flatnonzero(_SIGNS[data])
        before = data[signs - 1]
        signs = signs[_LETTERS[before] | (_SECOND[before] & (data[signs - 2] == 0xC3))]
        if not self.blanks_count or not len(cuts):
            return np.append(cuts, signs)
        last = np.zeros(len(data) + 1, bool)
        last[offsets] = True
        cuts = cuts[~last[cuts + 1]]
        following = data[cuts + 1]
        visible = ~_ASCII_BLANK[following]
        for blank in _WIDE_BLANKS:
            maybe = np.flatnonzero(following == blank[0])
            maybe = maybe[cuts[maybe] + len(blank) < len(data)]
            same = np.ones(len(maybe), bool)
            for i, byte in enumerate(blank):
                same &= data[cuts[maybe] + 1 + i] == byte
            visible[maybe[same]] = False
        return np.append(cuts[visible], signs)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has."""
        if not self.blanks_count:
            pieces = [p.lstrip(b" \n") for p in pieces]
        known = self.known
        new = {p for p in pieces if p not in known}
        if new:
            self._learn(list(new))
        found = [known[p] for p in pieces]
        table = np.frombuffer(b"".join(found), self.dtype)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        if len(known) > CACHED_PIECES:
            for piece in list(islice(known, len(known) // 2)):
                del known[piece]
        for piece in new:
            if len(piece) > CACHED_BYTES:
                known.pop(piece, None)
        return table, lengths

    def _learn(self, new: list[bytes]) -> None:
        """Make ``known`` hold every piece of ``new``."""
        if self.direct:
            plain = _LETTERS_ONLY.fullmatch
            rest = []
            for piece in new:
                if plain(piece):
                    self.known[piece] = self._merged(piece)
                else:
                    rest.append(piece)
            new = rest
        short = [p for p in new if 0 < len(p) <= CACHED_BYTES]
        feeds = [p for p in short if p[0] == 0x0A]
        for members, shift in (([p for p in short if p[0] != 0x0A], 0), (feeds, 1)):
            for start in range(0, len(members), 2000):
                self._learn_together(members[start : start + 2000], shift)
        for piece in new:
            if piece not in self.known:
                self.known[piece] = self._alone(piece)

    def _learn_together(self, part: list[bytes], shift: int) -> None:
        """One call for pieces that hold neither white space nor the mark, which shows in how often these occur."""
        text = self.between.join(b"\n".join([p[shift:] for p in part]).decode().split("\n"))
        if len(text.split()) != 2 * len(part) - 1 if self.mark == "|" else len(text.split()) != len(part):
            clean = [p for p in part if not _ANY_BLANK.search(p.decode()[1:]) and self.mark not in p[shift:].decode()]
            if len(clean) == len(part):
                return
            return self._learn_together(clean, shift) if clean else None
        ids = self._library(text)
        ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
        if len(ends) != len(part):
            return None
        data, width, begin, before = ids.tobytes(), self.dtype.itemsize, 0, self.feed if shift else b""
        for piece, end in zip(part, ends, strict=True):
            self.known[piece] = before + data[begin * width : end * width]
            begin = end + 1

    def _alone(self, piece: bytes) -> bytes:
        text = piece.decode()
        if self.blanks_count and _LINE.match(text):
            return self.feed + self._library(text[1:]).tobytes()
        return self._library(text).tobytes() if text else b""

    def _merged(self, piece: bytes) -> bytes:
        """Ids of a piece that is one word to the library."""
        if not self.blanks_count:
            piece = piece.decode().lower().encode()
        tokens = self.tokenizer.model.tokenize(piece.decode("latin-1").translate(self.letters))
        return array(self.code, [token.id for token in tokens]).tobytes()

    def _is_direct(self) -> bool:
        """Whether words of Latin letters are one piece of byte letters to this tokenizer, lower-cased if blanks do not count."""
        steps = json.loads(self.tokenizer.to_str())
        split = steps["pre_tokenizer"] or {}
        kinds = [s["type"] for s in [split, *split.get("pretokenizers", [])] if s]
        changes = steps["normalizer"] or {}
        lowers = any(s["type"] == "Lowercase" for s in [changes, *changes.get("normalizers", [])] if s)
        if "ByteLevel" not in kinds or lowers == self.blanks_count:
            return False
        sample = ["a", "Hello", "internationalisation", "École", "straßenÄhnlich", "ñandúes", "XYZ", "qqqq"]
        lead = " " if self.blanks_count else ""
        return all(self._merged((lead + w).encode()) == self._library(lead + w).tobytes() for w in sample)

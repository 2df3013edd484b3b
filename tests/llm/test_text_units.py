"""Word hashes, token ids, Elias-Fano codes, the chat grammar and curve keys, without Spark."""

from __future__ import annotations

import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from patronage.llm import bpe, chat, decontaminate, elias_fano, imatch, packing
from patronage.llm.common import text_bytes
from patronage.llm.words import hash_words, shingle_sets

PARTS = [" ", "  ", "\n", "\t", "\r", "a", "B", "é", "'s", "'", "12", "$$$", "...", "\x1c", "\x85", "<|endoftext|>", "\u0301",
         "İ", "ß", "漢字", "\U0001f600", "\x00", "|", "word", " word", "-"]


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_those_of_the_whole_text(name, blanks):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    encoder, draw = bpe.encoder(name, blanks), random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 14))) for _ in range(5000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_survive_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    encoder = bpe.TextEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    texts = ["some words here", "other words there\nand more", "some other words " + "y" * 100]
    first = [encoder.encode([t])[0] for t in texts]
    assert first == encoder.encode(texts) and all(first)


@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(gaps, first):
    values = first + np.cumsum(np.array(gaps, np.int64))
    code = elias_fano.EliasFano(elias_fano.encode(values))
    order = np.random.default_rng(0).permutation(len(values))
    assert code.select(order).astype(np.int64).tolist() == values[order].tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1500, 20_000))
    assert len(elias_fano.encode(values)) * 8 / len(values) < 13  # a plain table has 64
    with pytest.raises(IndexError):
        elias_fano.EliasFano(elias_fano.encode(values)).select(np.array([20_000]))


def test_words_are_runs_between_blanks():
    texts = ["Ab  c\td", None, "", "ab c D e", "É \x0bé", "x" * 2_000_000 + " " + "x" * 2_000_000]
    hashes, places = hash_words(*text_bytes(pa.array(texts)))
    assert np.diff(places).tolist() == [3, 0, 0, 4, 2, 2]
    assert (hashes[:3] == hashes[3:6]).all() and hashes[6] != hashes[7] + 1
    assert hashes[7] != hashes[8] and hashes[9] == hashes[10]  # only A-Z is lower-cased


def test_shingle_sets_match_tuples():
    draw = random.Random(2)
    texts = [" ".join(draw.choices("abcd", k=draw.randint(0, 12))) for _ in range(400)]
    sets = shingle_sets(*hash_words(*text_bytes(pa.array(texts))), 4)
    by_hash = {}
    for text, found in zip(texts, sets, strict=True):
        words = tuple(text.split())
        truth = {words[i : i + 4] for i in range(len(words) - 3)} if len(words) >= 4 else {words} - {()}
        assert len(found) == len(truth)
        assert by_hash.setdefault(frozenset(found.tolist()), truth) == truth


TEXTS = st.text(max_size=30) | st.lists(st.sampled_from([*chat.MARKERS, "\\", "\\\\", "<", "[", "a", "/", "|"]), max_size=9).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool"]) | TEXTS, TEXTS), max_size=5))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(turns):
    rendered = [chat.render(role, text) for role, text in turns]
    assert chat.parse("".join(piece for piece, _, _ in rendered)) == turns
    for (_, text), (piece, start, end) in zip(turns, rendered, strict=True):
        assert chat.unescape(piece[start:end]) == text


@pytest.mark.parametrize("broken", ["x", "[INST]a", "[INST]a</s>", "[/INST]", "<|role|>a<|end|>", "\\[INST]a[/INST]"])
def test_chat_parser_refuses_other_text(broken):
    with pytest.raises(ValueError):
        chat.parse(broken)


def test_hilbert_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    index = packing.hilbert_index(cells, 3)
    assert sorted(index.tolist()) == list(range(512))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_masks_hit_every_stretch():
    """All places of the substitutions. A stretch of 26 tokens or more has a part of 13 or more with the share."""
    masks = [(sum(1 << i for i, c in enumerate(mask) if c == "1"), len(mask)) for mask in decontaminate.MASKS]
    for n in range(13, 31):
        others = n // 5
        places = itertools.combinations(range(n), others)
        while some := list(itertools.islice(places, 1 << 17)):
            changed = (1 << np.array(some, np.int64)).sum(axis=1)
            hit = np.zeros(len(changed), bool)
            for mask, span in masks:
                for start in range(n - span + 1):
                    hit |= changed & (mask << start) == 0
            assert hit.all(), (n, some[int(np.argmin(hit))])


def test_longest_stretch():
    equal = np.array([1] * 10 + [0] + [1] * 5 + [0] * 30 + [1] * 20, bool)
    assert decontaminate.longest_stretch(equal, 13, 0.8) == (25, 20)
    assert decontaminate.longest_stretch(equal[:16], 13, 0.8) == (16, 15)
    assert decontaminate.longest_stretch(equal[:12], 13, 0.8) == (0, 0)


def test_likeness():
    a = imatch._fingerprint(np.arange(1, 200, dtype=np.uint64) * np.uint64(2**55 + 12345), np.zeros(0, np.uint64))
    assert imatch.likeness(a, a) == 1.0
    empty = imatch._fingerprint(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    assert imatch.likeness(a, empty) == 0.0 and imatch.likeness(empty, empty) == 1.0


@pytest.mark.parametrize("n", [300, 3000, 5000, 8000, 50_000, 300_000])
def test_likeness_of_long_texts(n):
    """An edit of a third of the terms leaves about the same likeness whatever the length."""
    draw, none = np.random.default_rng(n), np.zeros(0, np.uint64)

    def marks(*parts):
        return imatch._fingerprint(np.unique(np.concatenate(parts)), none)

    edited, other = [], []
    for _ in range(8):
        kept, own, new = (draw.integers(0, 2**63, size, np.uint64) for size in (n - n // 3, n // 3, n // 3))
        mark = marks(kept, own)
        edited.append(imatch.likeness(mark, marks(kept, new)))
        other.append(imatch.likeness(mark, marks(draw.integers(0, 2**63, n, np.uint64))))
    assert np.mean(edited) > 0.2 and min(edited) > 0 and max(other) < 0.05

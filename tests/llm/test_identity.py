"""Rows under null or repeated ids whose texts have one crc32 are rows of their own."""

from __future__ import annotations

import zlib

from patronage.llm import bpe, decontaminate, line_dedup

PAIR = [f"private line number {n} that only this document holds, truly" for n in ("09685295", "12060020")]
SHARED = "a line that many documents share and that is long enough"


def with_one_checksum():
    """Two texts of one crc32: the first lines have one, and what follows is the same."""
    texts = [f"{line}\n{SHARED}" for line in PAIR]
    assert len({zlib.crc32(t.encode()) for t in texts}) == 1
    return texts


def test_lines_of_texts_with_one_checksum_stay(spark):
    rows = [(None, t) for t in with_one_checksum()] + [(i, SHARED) for i in range(6)]
    judged = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in judged if r.doc.doc_id is None) == sorted(PAIR)
    assert sorted((r.doc.doc_id, r.text) for r in judged if r.doc.doc_id is not None) == [
        *((i, "") for i in range(5)), (5, SHARED)
    ]


def test_a_clean_text_with_the_checksum_of_a_leaking_one_stays(spark):
    leaking, clean = with_one_checksum()
    docs = spark.createDataFrame([(None, leaking), (None, clean)], "doc_id long, text string")
    words = leaking.split()
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    # The texts differ in one word only, which no rule would tell apart: look for the whole text.
    found = decontaminate.find_leaks(docs, items, min_tokens=len(words), min_share=0.99)
    assert found.count() == 1
    kept = decontaminate.with_keys(docs).join(found.select("row", "row2"), ["row", "row2"], "left_anti").collect()
    assert [r.text for r in kept] == [clean]


def test_long_overlaps_are_reported_whole(spark):
    """An overlap of 5,000 tokens with a damaged part has all its tokens counted."""
    item = [f"t{i}" for i in range(5000)]
    doc = item[:3000] + ["x"] * 20 + item[3020:]
    docs = spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    (row,) = decontaminate.find_leaks(docs, items).collect()
    assert (row.n_tokens, row.n_equal) == (5000, 4980)


def test_runs_of_one_token_are_judged_in_one_row(spark):
    docs = spark.createDataFrame([(1, "same " * 24_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same " * 30)], "item_id long, text string")
    (row,) = decontaminate.find_leaks(docs, items).collect()
    assert (row.n_tokens, row.n_equal) == (30, 30)


def test_pieces_are_cut_where_the_library_cuts():
    texts = [
        "", " ", " x", "  x", "\nx", "\n\nx", " \nx", "x ", "x\n", "a b  c", "a b", "　 z 　", "a | b || c|d", "a,b.c!? d;;e",
        "é,è. ñ! ×, ÷.", "I'm. don't, we'll!", "a.\n,b", ".a", "3.5, 4,000 x1.", "“q”, ok—no, ½.", "💥 a\n💥", "\t tab\x1cx \x85y",
        "<|endoftext|> <|startoftext|>", "word " * 500, "x" * 5000, "Ünï ßtraße ÀÉÎ. Ñ", "ǅ Ǆ. ŉ,", "é, é.",
    ]
    for name, blanks_count in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        text_encoder = bpe.encoder(name, blanks_count)
        assert text_encoder.direct
        for direct in (True, False):
            text_encoder.direct = direct
            text_encoder.known.clear()
            whole = [text_encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            width = text_encoder.dtype.itemsize
            found = [
                [int.from_bytes(b[i : i + width], "little") for i in range(0, len(b), width)]
                for b in text_encoder.encode(texts)
            ]
            assert found == whole
        text_encoder.direct = True

"""Periodic runs, importance resampling and suffix de-duplication against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from patronage.llm import periodic, queries, resampling, substrings
from patronage.llm.common import table

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_force(words, min_words=12):
    n, out = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if i > start and length >= max(min_words, 2 * p):
                inside = words[start : start + length]
                if all(inside[q:] != inside[:-q] for q in range(1, p)):
                    out.add((start, length, p))
            i += i == start
    return sorted(out, key=lambda run: (run[0], run[2]))


def periodic_words(rng):
    """Sequences full of squares: blocks repeated, cut, and repeated again."""
    words = []
    for _ in range(rng.randint(0, 5)):
        block = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 9))]
        words += (block * 9)[: rng.randint(1, 40)]
        if rng.random() < 0.4:
            words += words[-rng.randint(1, len(words)) :]
    return words * rng.randint(1, 3)


def test_runs_equal_all_pairs():
    rng = random.Random(5)
    numbers = np.random.default_rng(5).integers(1, 2**62, 8).astype(np.uint64)
    for _ in range(1500):
        words, least = periodic_words(rng), rng.choice([12, 12, 7, 4, 2])
        assert periodic.find_runs(numbers[np.array(words, int)], least) == runs_by_force(words, least), (words, least)


def test_seeds_stay_linear():
    """Pairs of seeds per place, for texts whose k-grams all overlap themselves."""
    for words in (np.zeros(40_000, int), np.tile([0] * 60 + [1], 600), np.tile(np.arange(200) % 90, 150)):
        hashes = (words + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        k, pairs, grams = 6, 0, periodic._gram_ids(hashes, 6)
        while grams is not None:
            pairs += len(periodic._seeds(*grams, k, 1 if k == 6 else k)[0])
            grams, k = periodic._double(*grams, k), 2 * k
        assert pairs < 8 * len(words)


def test_periodic_runs_query(spark, sf):
    """op11 on a whole table, against all diagonals (short documents) and the stated texts."""
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: r for r in queries.op11(spark, sf).collect()}
    assert got.keys() == docs.keys()
    met = 0
    for doc_id, text in docs.items():
        words = BLANKS.findall(text)
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 700:
            continue
        row, runs = got[doc_id], runs_by_force(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed.encode()).hexdigest()
        best = max(runs, key=lambda run: (run[1], -run[0], -run[2]), default=(None, None, None))
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        met += bool(runs)
    assert met > 5


def test_periodic_runs_of_odd_texts(odd_docs, no_docs):
    rows = periodic.periodic_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [[(r.start, r.length, r.period) for r in row.runs] for row in rows if row.runs] == [
        [(0, 60_000, 1)],
        [(0, 42, 14)],
    ]
    assert all(row.collapsed == "" for row in rows if not row.n_words)
    assert "word" in {row.collapsed for row in rows}
    assert periodic.periodic_runs(no_docs).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(no_docs, min_words=1)


def test_words_of_unlike_case_are_unlike(make_docs):
    rows = periodic.periodic_runs(make_docs(["go Go " * 8, "go go " * 8])).orderBy("doc_id").collect()
    assert [[run.period for run in row.runs] for row in rows] == [[2], [1]]


def features_by_force(text, max_n, buckets):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    grams = [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_resampling_against_force(spark, sf, odd_docs, max_n):
    """Weights, scores and ranks of whole tables, with odd texts, null and repeated ids among the documents."""
    buckets = 500
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    target = table(spark, sf, "benchmark")
    scored = resampling.score_documents(docs, target, max_n, buckets)
    got = resampling.draw(scored, percent=25, min_words=20).collect()
    rows = [(r.doc_id, *features_by_force(r.text, max_n, buckets)) for r in docs.collect()]
    here = Counter(b for _, _, found in rows for b in found)
    there = Counter(b for r in target.collect() for b in features_by_force(r.text, max_n, buckets)[1])
    s, t = sum(here.values()) + buckets, sum(there.values()) + buckets
    gain = [math.floor(1000 * math.log(float((there[b] + 1) * s) / float((here[b] + 1) * t))) for b in range(buckets)]
    expected = []
    for doc_id, n_words, found in rows:
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        expected.append((doc_id, n_words, len(found), weight, score))
    expected.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    fit = [r for r in expected if r[1] >= 20]
    drawn = [(*r, i + 1) for i, r in enumerate(fit[: 25 * len(fit) // 100])]
    as_rows = sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=str)
    assert as_rows == sorted(expected, key=str)
    ranked = sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got if r["rank"]), key=lambda r: r[5])
    assert ranked == drawn and len(drawn) > 30


def test_resampling_keeps_equal_rows_apart(spark, make_docs):
    """A row repeated many times is dealt over the blocks; all ranks occur once."""
    many = spark.range(5000).selectExpr("cast(7 as long) doc_id", "repeat('alpha beta ', 15) text", "'x' AS `rank`")
    docs = many.select("doc_id", "text").unionByName(make_docs(["gamma " * 30] * 50, first=100)).repartition(7)
    scored = resampling.score_documents(docs, make_docs(["alpha alpha beta"]))
    drawn = resampling.draw(scored, percent=50)
    ranks = sorted(r["rank"] for r in drawn.filter("rank is not null").collect())
    assert ranks == list(range(1, 2526)) and drawn.count() == 5050
    texts = resampling.drawn_documents(many, drawn).collect()
    assert [r.doc_id for r in texts] == [7]


def test_resampling_of_nothing(no_docs, odd_docs, make_docs):
    assert resampling.draw(resampling.score_documents(no_docs, odd_docs)).collect() == []
    rows = resampling.draw(resampling.score_documents(odd_docs, no_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["rank"] is None for r in resampling.draw(resampling.score_documents(make_docs(["a b"]), no_docs)).collect())


def removed_by_force(texts, length):
    data = [(t or "").encode() for t in texts]
    met = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if met[hash(d[i : i + length])] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(gone[:-1] & ~np.append(False, gone[:-2]))) if len(d) else 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out.append((len(d), int(gone.sum()), spans, kept))
    return out


def compare_removed(make_docs, texts, length, bucket_rows):
    got = substrings.remove_repeats(make_docs(texts), length, bucket_rows).orderBy("doc_id").collect()
    expected = removed_by_force(texts, length)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == expected
    return sum(r.n_removed for r in got)


@pytest.mark.parametrize("bucket_rows", [512, 3])
def test_repeated_strings_against_force(make_docs, bucket_rows):
    """Passages cut at any place, edited copies, periodic and uniform texts; small buckets force all rounds."""
    rng = random.Random(bucket_rows)
    letters = "abcdefghijklmnop \nö"
    fresh = lambda n: "".join(rng.choices(letters, k=n))
    passage, texts = fresh(400), []
    for _ in range(60):
        a, b = sorted(rng.sample(range(400), 2))
        texts.append(fresh(rng.randint(0, 150)) + passage[a:b] + fresh(rng.randint(0, 150)))
    long = fresh(1500)
    for _ in range(12):
        edited = list(long)
        for place in rng.sample(range(1500), rng.randint(0, 25)):
            edited[place] = rng.choice(letters)
        texts.append("".join(edited))
    texts += [long, long, "", None, "x" * 900, "ab" * 300, "ab" * 40, "short", fresh(63), fresh(64)]
    assert compare_removed(make_docs, texts, 64, bucket_rows) > 10_000
    assert compare_removed(make_docs, texts, 101, bucket_rows) > 5_000


def test_one_text_and_none(make_docs, no_docs):
    assert compare_removed(make_docs, ["y" * 500], 400, 512) == 500
    assert compare_removed(make_docs, ["y" * 400], 400, 512) == 0
    assert substrings.remove_repeats(no_docs).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(no_docs, 63)


def test_odd_texts_keep_their_rows(odd_docs):
    rows = substrings.remove_repeats(odd_docs).collect()
    expected = removed_by_force([r.text for r in odd_docs.collect()], 400)
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert sorted(((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=key) == sorted(expected, key=key)


def test_suffix_dedup_query(spark, sf):
    """op13 on a whole table."""
    docs = table(spark, sf, "documents").orderBy("doc_id").collect()
    got = queries.op13(spark, sf).orderBy("doc_id").collect()
    expected = removed_by_force([r.text for r in docs], 400)
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == [
        (d.doc_id, n, gone, spans, hashlib.sha256(kept).hexdigest())
        for d, (n, gone, spans, kept) in zip(docs, expected, strict=True)
    ]
    assert sum(r.n_removed for r in got) > 0

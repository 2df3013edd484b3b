"""Each operator against a brute-force version, and on odd and empty tables."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from patronage.llm import (
    chat, decontaminate, imatch, line_dedup, near_dedup, packing, quality_fm, queries, sharding, token_files, url_filter,
)


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def words_of(draw, n, vocabulary=4000):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


# ---------------------------------------------------------------- 1 sharding


def shards_of(sharded):
    out = collections.defaultdict(list)
    for r in sharded.collect():
        out[r.shard].append((r.slot, r.doc.asDict()))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}


def test_shards_hold_every_row_once(spark, odd_docs):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    for docs, size in ((many, 20_000), (odd_docs, 100_000)):
        shards = shards_of(sharding.shuffle_shards(docs, 4, seed=2, bucket_bytes=size))
        counts = [len(v) for v in shards.values()]
        assert max(counts) - min(counts) <= 1
        assert all([s for s, _ in v] == list(range(len(v))) for v in shards.values())
        got = sorted(str(sorted(r.items())) for v in shards.values() for _, r in v)
        assert got == sorted(str(sorted(r.asDict().items())) for r in docs.collect())
    again = shards_of(sharding.shuffle_shards(many.repartition(5), 4, seed=2, bucket_bytes=20_000))
    first = shards_of(sharding.shuffle_shards(many, 4, seed=2, bucket_bytes=20_000))
    assert again == first != shards_of(sharding.shuffle_shards(many, 4, seed=3, bucket_bytes=20_000))


def test_repeated_rows_scatter(spark):
    same = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("text"))
    sharded = sharding.shuffle_shards(same, 3, bucket_bytes=100_000)
    rows = sharded.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"))
    assert sorted((r.n, r.slots, r.last + 1) for r in rows.collect()) == [(6666,) * 3, (6667,) * 3, (6667,) * 3]
    assert sharding.shuffle_shards(same.limit(0), 3).count() == 0


def test_written_shards(spark, make_docs, tmp_path):
    sharding.write_shards(sharding.shuffle_shards(make_docs(["a", "b", "c"]), 2), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.columns) == ["doc_id", "shard", "slot", "text"] and back.count() == 3


# ---------------------------------------------------------------- 2 near copies


def components_by_force(docs, size, percent=80):
    sets = {}
    for doc_id, text in docs:
        w = text.encode().lower().split()
        shingles = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        sets[doc_id] = shingles
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(draw, base, n, edits):
    """Copies of ``base`` that each differ from it in up to ``edits`` words."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("cell", [1024, 5])
def test_near_copies_match_all_pairs(make_docs, monkeypatch, cell):
    draw = random.Random(8)
    texts = [" ".join(words_of(draw, draw.randint(0, 60))) for _ in range(40)]
    texts += family(draw, words_of(draw, 120), 70, 9) + family(draw, words_of(draw, 30), 20, 2)
    texts += [texts[50]] * 15 + [texts[0].upper(), "One two", "one TWO\n", "one two three", "", "Ä b", "ä b"]
    draw.shuffle(texts)
    monkeypatch.setattr(near_dedup, "CELL", cell)
    truth = components_by_force(list(enumerate(texts)), 4)
    rows = near_dedup.near_duplicates(make_docs(texts), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == truth
    assert len(rows) == len(texts) and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_copies_of_odd_texts(odd_docs, no_docs):
    rows = near_dedup.near_duplicates(odd_docs, 5).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[9].component_id == 8 and by_id[8].kept and not by_id[9].kept
    assert by_id[1].n_shingles == 0 and by_id[1].kept
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_dedup.near_duplicates(no_docs).count() == 0


# ---------------------------------------------------------------- 3 URLs


def judge_by_force(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].encode().lower().decode()
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    draw = random.Random(4)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("com", "", "block"), ("a.com", "/x/y", "allow")]
    rules += [(f"h{i}.org", "/" * (i % 3), "block") for i in range(500)]
    urls = [None, "", "no scheme", "http://", "http:///p", "HTTP://EXAMPLE.net/EN/", "x://a://b.net/q", "http://net", "http://É.net/"]
    hosts = ["example.net", "www.example.net", "notexample.net", "a.com", "b.a.com", "h7.org", "s.h8.org", "h9999.org", "Com", "x..net"]
    urls += [f"http://{draw.choice(hosts)}{draw.choice(['', '/', '/en/', '/en', '/x/y/z', '//', '?q=/en/', '#/en/'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i % 200, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((str(r.page.url), r.host, r.path, str(r.rule), r.verdict) for r in url_filter.judge_urls(pages, listed).collect())
    assert got == sorted((str(u), *map(str, judge_by_force(u, rules))) for u in urls)
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, listed.limit(0)).collect()} == {"allow"}


def test_bloom_blocks_lose_no_rule(spark, monkeypatch):
    rules = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    places = rules.select("host", "path").unionByName(
        spark.range(5000).select(F.concat(F.lit("o"), "id").alias("host"), F.lit("/").alias("path"))
    )
    hits = url_filter.possible_hits(places, rules).select("host").distinct()
    assert hits.filter("host like 'h%'").count() == 5000 and hits.filter("host like 'o%'").count() < 250
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 3)  # far too small a filter: slower, not wrong
    pages = places.select(F.concat(F.lit("http://"), "host", "path").alias("url"))
    assert url_filter.judge_urls(pages, rules).filter("verdict = 'block'").count() == 5000


# ---------------------------------------------------------------- 4 fingerprints


def test_edits_and_likeness(make_docs, odd_docs, no_docs):
    draw = random.Random(6)
    texts = [" ".join(words_of(draw, draw.randint(0, 400), 3000)) for _ in range(150)]
    docs = make_docs([*texts, texts[3], "é" * 10, "", "ab"])
    terms = imatch.lexicon(docs, 2.0, 5.0)
    rows = {r.doc_id: r for r in imatch.compare_with_edits(docs, terms).collect()}
    ordered = sorted(pairs(docs), reverse=True)
    for i, (doc_id, text) in enumerate(ordered):
        after, n, r = ordered[(i + 1) % len(ordered)][1], len(text), rows[doc_id]
        edited = text[: n - n // 3] + after[: n // 3]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == imatch.likeness(r.fingerprint, rows[ordered[(i + 1) % len(ordered)][0]].fingerprint)
        assert r.near_edited == imatch.likeness(r.fingerprint, r.edited_fingerprint)
    assert rows[3].fingerprint == rows[150].fingerprint != rows[4].fingerprint
    long = [r for r in rows.values() if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.2 > 0.05 > np.mean([r.near_next for r in long])
    odd = imatch.compare_with_edits(odd_docs, terms).collect()
    assert len(odd) == odd_docs.count()
    assert imatch.compare_with_edits(no_docs, imatch.lexicon(no_docs)).count() == 0


def test_edits_of_long_texts(make_docs):
    docs = make_docs([" ".join(f"d{i}w{j}" for j in range(n)) for i, n in enumerate((5000, 8000, 20_000, 50_000))])
    rows = imatch.compare_with_edits(docs, np.zeros(0, np.uint64)).collect()
    assert len(rows) == 4 and all(r.near_edited > 0.15 and r.near_next < 0.05 for r in rows)


def test_lexicon_is_the_band_over_all_documents(make_docs):
    texts = [f"all {'some' if i < 30 else ''} {'few' if i < 3 else ''} own{i}" for i in range(100)]
    docs = make_docs(texts)
    band = imatch.lexicon(docs, np.log(2), np.log(20))
    assert len(band) == 1  # "some": 30 of 100
    marks = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs, band).collect()}
    assert marks[0] == marks[29] != marks[30]


# ---------------------------------------------------------------- 5 token files


def test_token_files_read_back(odd_docs, no_docs, make_docs):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(1)
    docs = make_docs([" ".join(words_of(draw, draw.randint(0, 80))) for _ in range(200)], first=-50)
    segments = token_files.write_token_segments(docs, "byte_bpe_50k.json", 2, segment_ids=700)
    assert segments.count() > 10
    rows = {r.doc_id: r for r in token_files.read_token_index(segments).collect()}
    start = 0
    for doc_id, text in sorted(pairs(docs)):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        r = rows[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd = token_files.read_token_index(token_files.write_token_segments(odd_docs, "byte_bpe_50k.json", 2)).collect()
    odd = sorted(odd, key=lambda r: r.start)
    assert len(odd) == odd_docs.count() and [r.doc_id for r in odd][:2] == [None, None]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(odd, odd[1:], strict=False))
    empty = token_files.write_token_segments(no_docs, "byte_bpe_50k.json", 2)
    assert token_files.read_token_index(empty).count() == 0


# ---------------------------------------------------------------- 6 chat


def test_conversations_read_back(spark):
    rows = [(1, 0, "system", "be kind", 9), (1, 1, "user", "hi [INST]", 9), (1, 2, "assistant", "</s>\\", 9), (1, 3, "assistant", None, 9),
            (None, 0, "user", "x", 9), (2, None, None, "tool [/INST]", 9), (3, 1, "assistant", "a" * 400_000, 9), (3, 1, "assistant", "b", 9),
            (4, 0, "user", "same", 9), (4, 0, "user", "same", 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece long")
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_turns(turns)).collect()}
    groups = collections.defaultdict(list)
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        groups[conv].append((role or "", text or ""))
    assert set(got) == set(groups)
    for conv, said in groups.items():
        loss, r = "".join(t for role, t in said if role == "assistant"), got[conv]
        assert r.n_turns == len(said) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.render(a, t)[0]) for a, t in said)
    assert chat.read_conversations(chat.format_turns(turns.limit(0))).count() == 0


# ---------------------------------------------------------------- 7 decontamination


def test_leaks_survive_substitutions(spark, make_docs, odd_docs, no_docs):
    draw = random.Random(3)
    items = [words_of(draw, n) for n in (13, 20, 40, 60, 10)]
    listed = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(5, None, 1), (None, "", 1)], "item_id long, text string, row long")

    def planted(words, every=0):
        words = [f"other{i}" if every and i % every == every - 1 else w for i, w in enumerate(words)]
        return " ".join([*words_of(draw, 50), *words, *words_of(draw, 50)])

    texts = [planted(items[0]), planted(items[1], 6), planted(items[2], 6), planted(items[3], 5), planted(items[3][20:40]),
             planted(items[4]), planted(items[2][:9]), planted(items[2], 2), " ".join(words_of(draw, 500)),
             planted(items[1]).upper().replace(" ", ", "), planted(items[2]) + " " + planted(items[3])]
    docs = make_docs(texts)
    found = {(r.id, r.item_id): (r.n_tokens, r.n_equal) for r in decontaminate.find_leaks(docs, listed).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (9, 1), (10, 2), (10, 3)}
    assert found[0, 0] == (16, 13) or found[0, 0][1] >= 13
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, listed).collect()) == [5, 6, 7, 8]
    assert decontaminate.without_leaks(odd_docs, listed).count() == odd_docs.count()
    assert decontaminate.without_leaks(odd_docs, listed).columns == odd_docs.columns
    assert decontaminate.find_leaks(no_docs, listed).count() == decontaminate.find_leaks(docs, listed.limit(0)).count() == 0


def leaks_by_force(docs, items, min_tokens=13, share=0.8):
    """(doc, item) pairs by the rule itself: each item laid beside each document at every shift."""
    out = set()
    for d, doc in docs:
        for i, item in items:
            if any(
                decontaminate.longest_stretch(np.array([a == b for a, b in zip(item[max(0, -s) :], doc[max(0, s) :], strict=False)], bool), min_tokens, share)[0]
                for s in range(1 - len(item), len(doc))
            ):
                out.add((d, i))
    return out


def test_leaks_match_the_rule_by_force(spark, make_docs):
    draw = random.Random(11)
    items = [words_of(draw, n) for n in (13, 13, 14, 15, 15, 16, 18, 20, 25, 30)]
    docs = []
    for item in items * 8:
        words, n = list(item), len(item) // 5 + draw.randint(0, 1)
        for place in draw.sample(range(len(words)), n):
            words[place] = f"other{place}"
        docs.append([*words_of(draw, draw.randint(0, 20)), *words[draw.choice((0, 0, 2)) :], *words_of(draw, 5)])
    docs.append(["x", "other1", "other2", *items[0][3:], "y"])
    docs.append([items[0][0], "other1", "other2", *items[0][3:]])
    listed = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.id, r.item_id) for r in decontaminate.find_leaks(make_docs([" ".join(d) for d in docs]), listed).collect()}
    expected = leaks_by_force(list(enumerate(docs)), list(enumerate(items)))
    assert found == expected and 20 < len(found) < len(docs)
    with pytest.raises(ValueError):
        decontaminate.find_leaks(make_docs(["a"]), listed, min_share=0.7)


def test_short_items_leak_as_a_whole(spark, make_docs, odd_docs):
    draw = random.Random(5)
    items = [words_of(draw, n) for n in (1, 4, 10, 11, 12)]
    texts = [" ".join([*words_of(draw, 30), *w, *words_of(draw, 30)]) for w in items]
    texts += [" ".join([*w[:-1], "other", *words_of(draw, 30)]) for w in items[1:]] + [" ".join(items[2]), " ".join(items[2][1:])]
    texts += ["前文。水是由氢和氧组成的吗?后文", "水是由氢和氮组成的吗", "前文这个城市的人口在过去十年里增长了多少倍后文", "其他"]
    chinese = ["水是由氢和氧组成的吗", "这个城市的人口在过去二年里增长了多少倍"]
    rows = [(i, t) for i, t in enumerate([*(" ".join(w).upper() for w in items), *chinese])]
    listed = spark.createDataFrame([*rows, (7, ""), (8, None)], "item_id long, text string")
    docs = make_docs(texts)
    found = {(r.id, r.item_id): (r.n_tokens, r.n_equal) for r in decontaminate.find_leaks(docs, listed, short_items=True).collect()}
    expected = {(i, j): (len(w),) * 2 for i, t in enumerate(texts[:11]) for j, w in enumerate(items)
                if f" {' '.join(w)} " in f" {t} "}
    assert found == expected | {(11, 5): (10, 10), (13, 6): (19, 18)}
    assert {(i, i) for i in range(5)} | {(9, 2)} <= set(found) and (5, 1) not in found
    kept = {r.doc_id for r in decontaminate.without_leaks(docs, listed, short_items=True).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in found}
    assert decontaminate.without_leaks(odd_docs, listed, short_items=True).count() == odd_docs.count()


def test_op7_and_the_pipeline_look_for_short_items(spark, make_docs, tmp_path):
    docs = make_docs(["one two three four five", "one two four three five", None]).selectExpr(
        "doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Two, three, four!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.QUERIES["op7_decontamination"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(0, 1, 3, 3)]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()) == [1, 2]


# ---------------------------------------------------------------- 8 lines


def lines_by_force(docs, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(line_dedup.BLANKS).encode().lower()

    holders = collections.defaultdict(set)
    for doc_id, text in docs:
        for line in text.split("\n"):
            if len(line.strip(line_dedup.BLANKS)) >= min_chars:
                holders[key(line)].add(doc_id)
    last = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    return {d: "\n".join(x for x in t.split("\n") if last.get(key(x), d) == d) for d, t in docs}


def test_lines_match_brute_force(make_docs, spark):
    draw = random.Random(7)
    common = [f"a line that is quite long enough to be a key, number {i}" for i in range(30)]
    spell = [lambda s: s, lambda s: f" \t{s}\r", str.upper, lambda s: s[:39], lambda s: "\u00a0" + s]
    texts = ["\n".join(draw.choice(spell)(draw.choice(common[: draw.randint(1, 30)])) for _ in range(draw.randint(0, 12))) for _ in range(300)]
    texts = [t + "\n" + common[0] if i % 3 else t for i, t in enumerate(texts)]  # a line of most documents
    docs = make_docs(texts).repartition(6)
    truth = lines_by_force(pairs(docs))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = line_dedup.dedup_lines(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.doc.doc_id: r.text for r in rows} == truth
    assert sum(r.n_dropped for r in rows) > 300 and all(r.n_lines == texts[r.doc.doc_id].count("\n") + 1 for r in rows)


def test_lines_of_odd_texts(odd_docs, no_docs):
    rows = line_dedup.dedup_lines(odd_docs, min_docs=1).collect()
    assert len(rows) == odd_docs.count() and all((r.text or "") == (r.doc.text or "") for r in rows)
    rows = line_dedup.dedup_lines(odd_docs.union(odd_docs.selectExpr("doc_id + 100", "text", "lang", "block", "`keep`", "`doc`")), min_docs=2).collect()
    kept = {r.doc.doc_id: r for r in rows if r.doc.text and r.doc.text.startswith("Same")}
    assert kept[6].n_dropped == 3 and kept[6].text == "" and kept[106].n_dropped == 0
    assert line_dedup.dedup_lines(no_docs).count() == 0


# ---------------------------------------------------------------- 9 packing


def check_packing(rows, docs, length):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in docs:
        ids = [*whole.encode(text, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces.pop(doc_id), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    ends = []
    for _, parts in sorted(sequences.items()):
        ends.append(0)
        for offset, n in sorted(parts):
            assert offset == ends[-1]
            ends[-1] += n
    assert sorted(sequences) == list(range(len(ends))) and set(ends[:-1]) <= {length} and ends[-1] <= length


def test_packing_covers_every_id(make_docs, odd_docs, no_docs):
    draw = random.Random(11)
    docs = make_docs([" ".join(words_of(draw, draw.randint(0, 300))) for _ in range(80)] + ["same text"] * 60)
    check_packing(packing.pack_documents(docs, "word_bpe_49k.json", 1, length=256).collect(), pairs(docs), 256)
    rows = packing.pack_documents(odd_docs, "word_bpe_49k.json", 1, length=64).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}
    assert packing.pack_documents(no_docs, "word_bpe_49k.json", 1).count() == 0


# ---------------------------------------------------------------- 10 quality


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc.doc_id: r for r in quality_fm.score_quality(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    truth = [(r.quality, rows[r.doc_id]) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([q == r.predicted for q, r in truth]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_quality_of_odd_texts(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, 1), (8, 1), (7, 0), (1, None), (0, 7), (None, 1)], "doc_id long, quality int")
    rows = quality_fm.score_quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc.text == "one two three"}) == 1
    assert quality_fm.score_quality(no_docs, labels).count() == 0
    assert {r.score for r in quality_fm.score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}

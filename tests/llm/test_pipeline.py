"""The pipeline against its stages done by force."""

from __future__ import annotations

import corpus_pipeline
from patronage.llm import quality_fm
from patronage.llm.common import store
from tests.llm.test_text_operators import check_packing, components_by_force, lines_by_force

SF = "/root/testdata/sf0.001"


def words(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in text).split(" ")


def leaks(text: str, items: list[str], shortest: int = 13) -> bool:
    """Whether some 13 words of an item stand in the text one after the other."""
    mine = [w for w in words(text) if w]
    runs = {tuple(mine[i : i + shortest]) for i in range(len(mine) - shortest + 1)}
    for item in items:
        theirs = [w for w in words(item) if w]
        if any(tuple(theirs[i : i + shortest]) in runs for i in range(len(theirs) - shortest + 1)):
            return True
    return False


def test_pipeline_matches_stages_by_force(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    now = {r.doc.doc_id: r.doc.text or "" for r in quality_fm.score_quality(docs, labels).filter("score >= 0.3").collect()}
    assert 100 < len(now) < docs.count()
    stages = {"quality classifier": set(now)}
    now = lines_by_force(list(now.items()))
    groups = components_by_force(list(now.items()), 5)
    now = {d: t for d, t in now.items() if groups[d][1] == d}
    stages["MinHash near-dedup"] = set(now)
    questions = [r.text for r in items.collect()]
    now = {d: t for d, t in now.items() if not leaks(t, questions)}
    stages["benchmark decontamination"] = set(now)

    found = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = store(stage(spark, found, SF))
        assert found.columns == docs.columns
        if name in stages:
            assert {r.doc_id for r in found.select("doc_id").collect()} == stages[name], name
    assert {r.doc_id: r.text or "" for r in found.collect()} == now
    assert all(len(r.text or "") == r.n_chars for r in found.collect())
    check_packing(corpus_pipeline.run(spark, SF).collect(), list(now.items()), 2048)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"
    ]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Repeats of a kept id and copies without id are rows like others; an id comes before none."""
    prose = [" ".join(f"w{n}x{i}" for i in range(60)) for n in range(4)]
    near = prose[0].replace("w0x30", "other")
    rows = [(1, prose[0]), (1, prose[0]), (None, prose[0]), (None, near), (2, near), (None, prose[1]), (None, prose[1]),
            (7, prose[2]), (7, prose[3]), (None, ""), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.keep_one_of_near_copies(spark, docs.repartition(5), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(
        [(1, prose[0]), (None, prose[1]), (7, prose[2]), (7, prose[3]), (None, ""), (None, None), (3, "")], key=str
    )

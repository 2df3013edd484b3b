"""From raw documents to packed training sequences: five operators of ``patronage.llm`` one after the other.

Each stage takes (spark, docs, sf_dir), works on every document that the stage before kept, and
returns the columns of ``documents`` (the last returns pieces of packed sequences). Between stages the documents are
written to the shared folder and read again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import decontaminate, line_dedup, near_dedup, packing, quality_fm
from patronage.llm.common import store, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = quality_fm.score_quality(docs.select(COLUMNS), labels)
    return scored.filter("predicted = 1").select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one of them; ``n_chars`` follows the text. No row goes: a document
    all of whose lines are elsewhere has an empty text."""
    judged = line_dedup.dedup_lines(docs.select(COLUMNS))
    changed = F.col("n_dropped") > 0
    return judged.select(
        "doc.doc_id",
        F.when(changed, F.col("text")).otherwise(F.col("doc.text")).alias("text"),
        "doc.lang",
        "doc.source",
        F.when(changed, F.length("text").cast("long")).otherwise(F.col("doc.n_chars")).alias("n_chars"),
    )


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity of 0.8 or more): that with the smallest doc_id, null ids
    last, of equal ids any. Rows are linked by a number of their own, so null and repeated ids are rows like others."""
    numbered = store(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    judged = near_dedup.near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text"), shingle_words=5, percent=80)
    groups = judged.select(F.col("doc_id").alias("_row"), "component_id")
    ids = numbered.select("_row", "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("first")
    # Groups of one need no more than themselves; the others are few columns.
    stays = ids.join(groups.hint("shuffle_hash"), "_row").groupBy("component_id").agg(first).select("first._row")
    return numbered.join(stays.hint("shuffle_hash"), "_row", "left_semi").select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item, and no short item as a whole."""
    return decontaminate.without_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), short_items=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids along the Hilbert curve."""
    return packing.pack_documents(docs, "word_bpe_49k.json", end_id=1).drop("ids")


STAGES = [
    ("quality classifier", keep_good_text),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: A fitted classifier and tokenizer ids are beyond SQL; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Text quality by a factorisation machine.

Inputs are hashed words (shares of 4096 buckets, scaled to length one) and structure statistics of the text (shares of
capitals, signs, repeated words and the like; its length as metadata). The machine weighs each
input and, by a vector of ``FACTORS`` numbers per input, each pair of inputs; the sum over pairs is half of (square of
the sum - sum of squares) of those vectors, so scoring is linear in the inputs present. Fitting and
scoring are Spark ML's; nothing of it runs in Python.

The fit takes about ``max_rows`` labelled rows, drawn by a hash of doc_id (all rows if there are
fewer); everything else covers all documents. Rows whose crc32(doc_id as text) is divisible by ``folds`` are held
out. Labels, lang, source and doc_id are no inputs.

Nulls: a null text is the empty text; unlabelled rows are scored only; several labels of one document count as the
highest. Without labels of both kinds every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import store

MAX_ROWS, FOLDS, THRESHOLD = 20_000, 5, 0.3
BUCKETS, FACTORS = 4096, 4

_BLANKS = r"[\x20\x09-\x0D]+"


def held_out(folds: int = FOLDS) -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name) % folds == 0


def score_quality(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD, label: str = "quality"
) -> DataFrame:
    """(doc, held_out, score, predicted) for each row of ``docs`` (``doc``: the row as a struct).

    ``labels``: doc_id and the 0/1 column ``label``."""
    known = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    training = known.filter(~held_out())
    n = training.count()
    if n > max_rows:
        drawn = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) < int(max_rows / n * (1 << 30))
        training = training.filter(drawn)
    # About max_rows rows of two numbers: small enough to send everywhere, so texts are not shuffled.
    sample = docs.select("doc_id", "text").join(F.broadcast(training), "doc_id")
    sample = store(_inputs(sample.select("label", F.col("text").alias("_text")), "_text"))
    counts = dict(sample.groupBy("label").count().collect())
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        held_out().alias("held_out"),
        F.col("text").alias("_text"),
    )
    if len(counts) < 2:
        score = F.lit(next(iter(counts), 0.5)).cast("double")
        scored = rows.withColumn("score", score)
    else:
        machine = FMClassifier(
            featuresCol="inputs", labelCol="label", factorSize=FACTORS, maxIter=60, stepSize=0.05, regParam=1e-4,
            initStd=0.05, seed=10, solver="adamW",
        )
        model = machine.fit(sample.coalesce(8))
        scored = model.transform(_inputs(rows, "_text"))
        scored = scored.withColumn("score", vector_to_array("probability").getItem(1))
    return scored.select("doc", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _inputs(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the vector ``inputs`` in place of the text ``column``."""
    text = F.coalesce(F.col(column), F.lit(""))
    trimmed = F.btrim(F.lower("_whole"), F.lit(" \t\n\v\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANKS))
    split = rows.withColumn("_whole", text).withColumn("_words", words)
    names = []
    for name, value in _structure().items():
        split = split.withColumn(f"_{name}", value)
        names.append(f"_{name}")
    hashed = HashingTF(numFeatures=BUCKETS, inputCol="_words", outputCol="_counts").transform(split)
    scaled = Normalizer(p=2.0, inputCol="_counts", outputCol="_shares").transform(hashed)
    out = VectorAssembler(inputCols=[*names, "_shares"], outputCol="inputs").transform(scaled)
    return out.drop(column, "_whole", "_words", "_counts", "_shares", *names)


def _structure() -> dict[str, Column]:
    """Statistics of the text, each from 0 to 1."""
    whole, words = F.col("_whole"), F.col("_words")
    chars = F.greatest(F.length(whole), F.lit(1))
    count = F.greatest(F.size(words), F.lit(1))

    def share(rest: Column) -> Column:
        """Share of the characters that ``rest`` lacks."""
        return (F.length(whole) - F.length(rest)) / chars

    repeats = F.filter(words, lambda word, i: word == F.get(words, i + 1))
    return {
        "capitals": share(F.regexp_replace(whole, r"\p{Lu}+", "")),
        "signs": share(F.regexp_replace(whole, r"[^\p{L}\p{N}\s]+", "")),
        "digits": share(F.translate(whole, "0123456789", "")),
        "shouts": share(F.translate(whole, "!?", "")),
        "bars": share(F.translate(whole, "|", "")),
        "marks": share(F.translate(whole, "#$%&*", "")),
        "blanks": share(F.translate(whole, " \t\n\r", "")),
        "lines": share(F.translate(whole, "\n", "")),
        "distinct": F.size(F.array_distinct(words)) / count,
        "repeats": F.size(repeats) / count,
        "word_length": F.least(F.length(whole) / count / 40, F.lit(1.0)),
        "length": F.least(F.log2(chars + 1.0) / 32, F.lit(1.0)),
    }

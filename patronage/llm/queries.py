"""The registered queries of this package and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from patronage.llm import (
    chat, decontaminate, imatch, line_dedup, near_dedup, packing, periodic, quality_fm, resampling, sharding,
    substrings, token_files, url_filter,
)
from patronage.llm.common import NULL_ID, store, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


@query(
    "op8_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents),
    keyed AS (
      SELECT doc_id, line, pos,
             translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM lines),
    repeated AS (
      SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    judged AS (
      SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
      FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")
    )


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = token_files.write_token_segments(
        table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2
    )
    return token_files.read_token_index(segments)


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1)
    return pieces.drop("ids")


@query("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shuffle_shards(table(spark, sf_dir, "documents"), shards=8, seed=1)
    text = F.coalesce("doc.text", F.lit(""))
    return sharded.select(
        "doc.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op4_imatch")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return imatch.compare_with_edits(docs, imatch.lexicon(docs))


RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query(
    "op3_url_filter",
    r"""
    WITH rules(rule_host, rule_path, rule_verdict) AS (
      VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
             ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    rests AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    parts AS (
      SELECT page_id,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
      FROM rests),
    ranked AS (
      SELECT p.*, r.*, row_number() OVER (
               PARTITION BY page_id ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST) AS place
      FROM parts p LEFT JOIN rules r
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
    FROM ranked WHERE place = 1
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


@query(
    "op6_chat_format",
    """
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
    sized AS (
      SELECT *, CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
                          ELSE 22 + length(role) END + length(text) + CASE WHEN conv_id = -1 THEN 3 ELSE 0 END AS chars
      FROM turns)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    clash = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", clash), (-1, 1, "assistant", clash)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_conversations(store(chat.format_turns(turns)))


@query("op10_quality_fm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_fm.score_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    )
    return scored.select("doc.doc_id", "held_out", "score", "predicted")


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_equal): the benchmark items that each document leaks."""
    leaks = decontaminate.find_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True
    )
    doc_id = F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id")
    return leaks.select(doc_id, "item_id", "n_tokens", "n_equal")


@query("op2_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): from a place that the id decides, every tenth document repeats its words with a period."""
    digest = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    cut = docs.select("doc_id", "text", F.when(digest % 10 == 0, words).alias("words"), (digest / 10).cast("long").alias("g"))
    sized = cut.select("*", F.size("words").alias("n")).select("*", (F.col("g") % F.nullif("n", F.lit(0))).alias("a"))
    sized = sized.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    planted = F.expr("""
        array_join(concat(slice(words, 1, int(a)),
          slice(flatten(array_repeat(slice(words, int(a) + 1, p), int((n - a) div p + 1))), 1, int(n - a))), ' ')""")
    return sized.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), min_words=12)
    longest = F.expr("""
        aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>),
                  (best, run) -> if(best is null or run.length > best.length, run, best))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(
    "op12_resampling",
    r"""
    WITH bits AS (SELECT range AS i, range::UBIGINT AS v FROM range(256)),
    t1 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END AS v FROM bits),
    t2 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END AS v FROM t1),
    t3 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END AS v FROM t2),
    t4 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END AS v FROM t3),
    t5 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END AS v FROM t4),
    t6 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END AS v FROM t5),
    t7 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END AS v FROM t6),
    t8 AS (SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END AS v FROM t7),
    steps AS (SELECT list(v ORDER BY i) AS tab FROM t8),
    texts AS (
      SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL
      SELECT 't', row_number() OVER (), text FROM benchmark),
    words AS (
      SELECT side, id, unnest(regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
      FROM texts),
    hexed AS (SELECT word, lower(hex(encode(word))) AS h FROM (SELECT DISTINCT word FROM words)),
    bytes AS (
      SELECT word, list_transform(range(length(h) // 2),
        lambda i: ((instr('0123456789abcdef', substr(h, (2 * i + 1)::INT, 1)) - 1) * 16
          + instr('0123456789abcdef', substr(h, (2 * i + 2)::INT, 1)) - 1)::UBIGINT) AS b
      FROM hexed),
    crcs AS (
      SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, b),
        lambda c, x: xor(c // 256, tab[(xor(c % 256, x) + 1)::INT])), 4294967295::UBIGINT) % 10000 AS bucket
      FROM bytes, steps),
    found AS (SELECT side, id, bucket, count(*) AS n FROM words JOIN crcs USING (word) GROUP BY ALL),
    sums AS (
      SELECT bucket, sum(n) FILTER (WHERE side = 'd') AS s, sum(n) FILTER (WHERE side = 't') AS t FROM found GROUP BY bucket),
    totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM sums),
    gains AS (
      SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000))
                                   / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
      FROM sums, totals),
    weights AS (
      SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
      FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
    scored AS (
      SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((
               ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
      FROM documents d LEFT JOIN weights USING (doc_id)),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
             count(*) FILTER (WHERE n_features >= 20) OVER () AS n
      FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
    FROM ranked
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resampling.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return resampling.draw(scored, percent=10, min_words=20).select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_suffix_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)

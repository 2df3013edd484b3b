"""URL rules: a blocked Bloom filter of the listed prefixes, then an exact hash join.

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it and whose path starts with
the rule's; the longest fitting rule gives the verdict, a URL that none fits is allowed. Each
URL is looked up under every suffix of its host and every length of a listed path. The lookups go
through a blocked Bloom filter: the filter is a table of 256-bit blocks, a lookup tests four
bits of one block, and what passes is joined with the rules by value, which removes false positives.

The filter never has more than ``MAX_BLOCKS`` blocks (40 bytes each), so it can always be broadcast: a longer
list makes it less selective, not larger. Equal (host, path) pairs are looked up once, so a host that a
third of all pages share is no hot key of the lookups.

Nulls: a null URL, or one without ``://``, has an empty host and path and fits no rule. Rows with equal
ids, and null ids, are kept. Several verdicts for one rule: ``block`` counts. Empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 18

#: Rules per block: 256 bits for 16 rules of four bits each let about 0.4 % of other lookups pass.
RULES_PER_BLOCK = 16

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, without query and fragment."""
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, F.substr(known, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _A_TO_Z, _A_TO_Z.lower())
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(page, host, path, rule, verdict) for each row of ``pages`` (``page``: the row as a struct).

    ``rules``: host (lower case), path (may be empty), verdict (``allow`` or ``block``)."""
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    host, path = split_url(F.col("page").getField(url))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"))
    rows = rows.select("page", host.alias("host"), path.alias("path"))
    places = rows.select("host", "path").filter("host <> ''").distinct()
    best = exact_matches(possible_hits(places, rules), rules)
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select("page", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def possible_hits(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Lookups (host, path, rule_host, rule_path) of each (host, path) that pass the Bloom filter."""
    n = rules.count()
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().limit(MAX_BLOCKS).collect()]
    blocks = max(1, min(MAX_BLOCKS, -(-n // RULES_PER_BLOCK)))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    # Only as many starts of a path as there are lengths of listed paths.
    starts = F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(lengths)])
    lookups = (
        places.withColumn("rule_host", F.explode(suffixes))
        .withColumn("rule_path", F.explode(F.filter(starts, lambda p: p.isNotNull())) if lengths else F.lit(None))
        .select("host", "path", "rule_host", "rule_path", *_places("rule_host", "rule_path", blocks))
    )
    passed = lookups.join(F.broadcast(bloom_blocks(rules, blocks)), "block")
    all_set = [F.col(f"word{i}").bitwiseAND(F.col(f"bit{i}")) == F.col(f"bit{i}") for i in range(4)]
    return passed.filter(all_set[0] & all_set[1] & all_set[2] & all_set[3]).select(
        "host", "path", "rule_host", "rule_path"
    )


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, word0..word3): the filter's blocks that have a rule, at most ``blocks`` rows."""
    placed = rules.select(*_places("host", "path", blocks))
    return placed.groupBy("block").agg(*[F.bit_or(f"bit{i}").alias(f"word{i}") for i in range(4)])


def exact_matches(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict): the longest rule that truly fits."""
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    length = (F.length("rule_host") + F.length("rule_path")).alias("length")
    rule = F.struct(length, F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = hits.join(named, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(rule).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def _places(host: str, path: str, blocks: int) -> list[Column]:
    """Block of a (host, path) and one bit in each of the block's four 64-bit words."""
    first, second = F.xxhash64(F.lit(1), host, path), F.xxhash64(F.lit(2), host, path)
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(second, 6 * i), F.lit(64)).cast("int"))
        for i in range(4)
    ]
    return [F.pmod(first, F.lit(blocks)).alias("block"), *[b.alias(f"bit{i}") for i, b in enumerate(bits)]]

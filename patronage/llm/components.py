"""Connected components of links between numbers, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import store


def connected(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a long, b long); component is the smallest id reachable.

    A step is an aggregation to minima, which combines before the shuffle, and a join, whose hot
    keys Spark can split; no task gathers a node's neighbours. After about log(n) steps all ids
    point to the smallest one. Only two numbers a step reach the driver."""
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = _state(edges)
    while True:
        edges = store(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return ids.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mark).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node point to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, point to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

"""Running sums, minima and maxima that can split one group over many tasks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How two partial results combine; minima and maxima skip nulls.
COMBINE = {
    "sum": lambda here, before: here + F.coalesce(before, F.lit(0)),
    "min": lambda here, before: F.least(here, before),
    "max": lambda here, before: F.greatest(here, before),
}
FUNCTIONS = {"sum": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    measures: dict[str, tuple[str, Column]],
    block: str | None = None,
    backward: bool = False,
) -> DataFrame:
    """Add aggregates over the rows of the group up to and including each row in ``order``.

    ``measures`` maps a new column to ``(sum | min | max, expression)``. ``backward`` says that
    ``order`` runs against time. With ``block``, a column that never decreases in time order, a
    group is cut into its blocks: each block runs in a task of its own and only one row per block
    carries the results of the blocks before it, so no single task ever sees a whole hot group.
    """
    parts = keys if block is None else [*keys, block]
    so_far = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({n: FUNCTIONS[kind](e).over(so_far) for n, (kind, e) in measures.items()})
    if block is None:
        return local
    totals = df.groupBy(*parts).agg(
        *[FUNCTIONS[kind](e).alias(f"_{n}_total") for n, (kind, e) in measures.items()]
    )
    sequence = F.desc(block) if backward else F.asc(block)
    earlier = W.partitionBy(*keys).orderBy(sequence).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *parts,
        *[
            FUNCTIONS[kind](f"_{n}_total").over(earlier).alias(f"_{n}_before")
            for n, (kind, _) in measures.items()
        ],
    )
    # The first block of a group, often the only one, has nothing before it.
    before = [F.col(f"_{n}_before").isNotNull() for n in measures]
    joined = local.join(carried.where(reduce(or_, before)), parts, "left")
    combined = {n: COMBINE[kind](F.col(n), F.col(f"_{n}_before")) for n, (kind, _) in measures.items()}
    return joined.withColumns(combined).drop(*[f"_{n}_before" for n in measures])


def group_total(
    df: DataFrame, keys: list[str], name: str, value: Column, block: str | None = None
) -> DataFrame:
    """Add the sum of ``value`` over the whole group."""
    if block is None:
        return df.withColumn(name, F.sum(value).over(W.partitionBy(*keys)))
    # Salting by block: the partial sums are formed per (group, block) before they meet.
    parts = df.groupBy(*keys, block).agg(F.sum(value).alias("_part"))
    whole = W.partitionBy(*keys)
    totals = parts.select(*keys, block, F.sum("_part").over(whole).alias(name))
    return df.join(totals, [*keys, block], "left")

"""Exact ranks, percentiles and cut points without a global sort.

Both helpers rest on counting. ``value_ranks`` counts distinct values, adds up coarse bins (their
number is bounded by the value range, not by the row count) and ranks values inside each bin in
parallel. ``keys_at_ranks`` finds the rows at a few given ranks of a total order by counting rows
between sampled pivots and sorting only the slices that contain a wanted rank.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One octave of values is split into this many bins: a bin spans 0.017 % of its value, so for
# amounts in cents it holds at most value * 0.017 distinct amounts.
BINS_PER_OCTAVE = 4096


def _bin(value: Column) -> Column:
    magnitude = F.floor(F.log2(1 + F.abs(value)) * BINS_PER_OCTAVE)
    return (F.signum(value) * magnitude).cast("bigint")


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct non-null ``value`` per ``by`` with ``n``, ``n_below``, ``n_upto`` and ``total``."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_bin", _bin(F.col(value)))
    )
    groups = W.partitionBy(*by)
    bins = (
        counts.groupBy(*by, "_bin")
        .agg(F.sum("n").alias("_bin_n"))
        .withColumn("_upto", F.sum("_bin_n").over(groups.orderBy("_bin")))
        .withColumn("total", F.sum("_bin_n").over(groups))
        .select(*by, "_bin", (F.col("_upto") - F.col("_bin_n")).alias("_offset"), "total")
    )
    in_bin = W.partitionBy(*by, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (
        counts.join(bins, [*by, "_bin"])
        .withColumn("n_upto", F.col("_offset") + F.sum("n").over(in_bin))
        .withColumn("n_below", F.col("n_upto") - F.col("n"))
        .select(*by, value, "n", "n_below", "n_upto", "total")
    )


def exact_percentiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linearly interpolated percentiles of ``value`` per ``by``, one column per name in ``probs``."""
    ranked = value_ranks(df, by, value)
    last = F.col("total") - 1
    bounds, finals = [], []
    for name, p in probs.items():
        position = last * F.lit(float(p))
        lower, upper = F.floor(position) + 1, F.ceil(position) + 1
        bounds += [
            F.min(F.when(F.col("n_upto") >= lower, F.col(value))).alias(f"_{name}_lo"),
            F.min(F.when(F.col("n_upto") >= upper, F.col(value))).alias(f"_{name}_hi"),
            F.max(position - F.floor(position)).alias(f"_{name}_w"),
        ]
        low, high, weight = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_w")
        finals.append((low + (high - low) * weight).alias(name))
    return ranked.groupBy(*by).agg(*bounds).select(*by, *finals)


def unpivot_metrics(df: DataFrame, keep: list[str], metrics: list[str]) -> DataFrame:
    """Long form ``(*keep, metric, value)`` of numeric columns."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.metric", "_p.value")


# Slices are cut until each holds at most this many rows, which one task sorts; pivots per cut.
SLICE_ROWS, PIVOTS = 50_000, 255


def keys_at_ranks(
    df: DataFrame,
    orders: dict[str, Column],
    ranks: dict[str, list[int]],
    rows: int,
    slice_rows: int = SLICE_ROWS,
) -> dict[str, dict[int, Column]]:
    """Sort keys standing at 1-based ``ranks`` of each total order in ``orders``.

    ``orders`` maps a series name to a struct Column (the same struct type for all) whose ascending
    order is total; ``rows`` is the row count of ``df``. Slices of the order that hold a wanted rank are
    cut at sampled pivots again and again until they are small, so no task sorts more than ``slice_rows`` rows
    whatever the size of the table. What reaches the driver is samples of a fixed size, one count
    per slice and the wanted keys themselves, returned as literals.
    """
    key_type = df.select(next(iter(orders.values())).alias("k")).schema["k"].dataType

    def literal(key) -> Column:
        parts = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, key_type.fields)]
        return F.struct(*parts)

    # Each wanted (series, rank) to its slice (above a key, up to a key), the slice's size and the rank in it.
    wanted = {(name, rank): ((None, None), rows, rank) for name, found in ranks.items() for rank in found}
    while any(size > slice_rows for _, size, _ in wanted.values()):
        wide = {(name, span): size for (name, _), (span, size, _) in wanted.items() if size > slice_rows}
        cuts = _cut_points(df, orders, wide, literal)
        counts = _slice_sizes(df, orders, cuts, literal)
        for target, (span, size, rank) in wanted.items():
            edges = cuts.get((target[0], span))
            if not edges:
                continue
            for low, high in zip([span[0], *edges], [*edges, span[1]]):
                inside = counts.get((target[0], (low, high)), 0)
                if rank <= inside:
                    wanted[target] = ((low, high), inside, rank)
                    break
                rank -= inside

    spans = sorted({(name, span) for (name, _), (span, _, _) in wanted.items()}, key=repr)
    number = {span: i for i, span in enumerate(spans)}
    entries = [
        F.when(_inside(orders[name], span, literal), F.struct(F.lit(i).alias("slice"), orders[name].alias("key")))
        for (name, span), i in number.items()
    ]
    long = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    in_slice = W.partitionBy("slice").orderBy("key")
    places = {target: (number[target[0], span], left) for target, (span, _, left) in wanted.items()}
    is_wanted = F.array_contains(
        F.array(*[F.struct(F.lit(i).alias("slice"), F.lit(left).alias("pos")) for i, left in set(places.values())]),
        F.struct("slice", "pos"),
    )
    found = long.withColumn("pos", F.row_number().over(in_slice)).where(is_wanted).collect()
    result: dict[str, dict[int, Column]] = {name: {} for name in orders}
    keys = {(row["slice"], row["pos"]): row["key"] for row in found}
    for (name, rank), place in places.items():
        result[name][rank] = literal(keys[place])
    return result


def _inside(key: Column, span: tuple, literal) -> Column:
    low, high = span
    test = F.lit(True) if low is None else key > literal(low)
    return test if high is None else test & (key <= literal(high))


def _cut_points(df: DataFrame, orders: dict[str, Column], wide: dict, literal) -> dict:
    """Some keys inside each slice, from a sample of about 80 per pivot."""
    out = {}
    for (name, span), size in wide.items():
        part = df.select(orders[name].alias("key")).where(_inside(F.col("key"), span, literal))
        drawn = part.sample(min(1.0, 80 * PIVOTS / size), seed=42).collect()
        keys = sorted(tuple(row["key"]) for row in drawn)
        step = max(1, len(keys) // (PIVOTS + 1))
        # Keys are distinct, so a slice with two drawn keys or more gets smaller.
        out[name, span] = keys[step - 1 : -1 : step][:PIVOTS]
    return out


def _edges_below(edges: Column, count: int, key: Column) -> Column:
    """How many of ``count`` ascending ``edges`` lie below ``key``, found by halving: a few comparisons a row."""
    steps = [1 << i for i in reversed(range(count.bit_length()))]

    def on(place: Column, step: Column) -> Column:
        # Past the last edge is null, which is not below anything.
        return F.when(F.get(edges, place + step - 1) < key, place + step).otherwise(place)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), on)


def _slice_sizes(df: DataFrame, orders: dict[str, Column], cuts: dict, literal) -> dict:
    """Rows between neighbouring cut points, all slices in one pass."""
    numbered = list(cuts.items())
    key_type = df.select(next(iter(orders.values())).alias("k")).schema["k"].dataType
    names, key_array = key_type.names, T.ArrayType(key_type)
    entries = []
    for i, ((name, span), edges) in enumerate(numbered):
        # One text for all edges: hundreds of nested literals would keep the driver busy for longer than the tasks.
        listed = F.from_json(F.lit(json.dumps([dict(zip(names, edge)) for edge in edges])), key_array)
        below = _edges_below(listed, len(edges), orders[name]) if edges else F.lit(0)
        entries.append(
            F.when(_inside(orders[name], span, literal), F.struct(F.lit(i).alias("cut"), below.alias("part")))
        )
    long = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    sizes = {}
    for row in long.groupBy("cut", "part").agg(F.count(F.lit(1)).alias("n")).collect():
        (name, span), edges = numbered[row["cut"]]
        bounds = [span[0], *edges, span[1]]
        sizes[name, (bounds[row["part"]], bounds[row["part"] + 1])] = row["n"]
    return sizes

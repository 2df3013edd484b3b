"""K-Means fits for many cluster counts and starts at once, and a Euclidean silhouette that is linear in the rows.

Every pass over the points serves all fits that still move: tasks assign their points to the centres of each fit and
add up, and one row per (fit, cluster) is shuffled. Fits that have settled drop out; the cheapest of each k then moves on
until it rests. Centres to start from come from a few thousand points, drawn by their squared distance to those drawn
before (k-means||) and weighed by how many others are nearest to them: k-means++ and steps among these, per (k, start).

Equal points are one row with a weight. Draws depend on a hash of the point, so a repeated task draws the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.session import materialize

# Most Lloyd steps of all fits and of the best ones, movement of all centres (sum of squares, by the
# features' mean variance) below which a fit has settled and the best one rests, points drawn per round, rounds,
# points so few that all are drawn, tries of k-means++ per start.
MAX_STEPS, MAX_LAST_STEPS = 25, 40
SETTLED, REST = 1e-4, 1e-7
DRAWN, ROUNDS = 1000, 2
FEW_POINTS = 2000
TRIES = 4

#: Points that stand for the clusters in a silhouette, of all clusters together; smaller tables are compared whole.
REFERENCES = 8192
#: Parts of the references that are compared with each other for the error.
REPLICATES = 16


@dataclass(frozen=True)
class KMeansFit:
    """Centres and the sum of squared distances of all rows to the nearest of them."""

    centers: list[list[float]]
    cost: float

    def clusterCenters(self) -> list[list[float]]:  # noqa: N802  named as in Spark ML
        return self.centers


def weighted_points(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """Distinct points (and values of ``more``) with their number ``w``, stored in as many parts as the session shuffles into."""
    distinct = df.groupBy(*more, *[F.col(c).cast("double").alias(c) for c in columns]).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return materialize(distinct.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def fit_many(
    points: DataFrame, columns: list[str], k_values: list[int], starts: int, seed: int
) -> dict[tuple[int, int], KMeansFit]:
    """A fit for every (k, start) of ``points`` as :func:`weighted_points` returns them; that of the cheapest start of each
    k has moved until it rests."""
    points = points.select(*columns, "w").persist()
    try:
        drawn, weight = _draw_seeds(points, columns, seed)
        variance = float(np.average((drawn - np.average(drawn, 0, weight)) ** 2, 0, weight).mean()) or 1.0
        jobs = [(k, start) for start in range(starts) for k in k_values]
        centers = [_spread(drawn, weight, k, np.random.default_rng([seed, k, start])) for k, start in jobs]
        everything = range(len(jobs))
        costs = _move(points, columns, centers, everything, MAX_STEPS, SETTLED * variance)
        best = [min((i for i in everything if jobs[i][0] == k), key=lambda i: costs[i]) for k in k_values]
        _move(points, columns, centers, best, MAX_LAST_STEPS, REST * variance)
        for i, (_, cost, _) in zip(best, _assign(points, columns, [centers[i] for i in best])):
            costs[i] = float(cost.sum())
    finally:
        points.unpersist()
    return {job: KMeansFit(c.tolist(), cost) for job, c, cost in zip(jobs, centers, costs)}


def _move(
    points: DataFrame, columns: list[str], centers: list[np.ndarray], which: Iterable[int], most: int, rest: float
) -> list[float]:
    """Move the centres of fits ``which`` to the means of their points until they move less than ``rest``. Returns the cost
    of every fit before its last step."""
    moving, costs = list(which), [np.inf] * len(centers)
    for _ in range(most):
        still = []
        for i, (n, cost, total) in zip(moving, _assign(points, columns, [centers[i] for i in moving])):
            fresh = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers[i])
            if np.square(fresh - centers[i]).sum() > rest:
                still.append(i)
            centers[i], costs[i] = fresh, float(cost.sum())
        moving = still
        if not moving:
            break
    return costs


def best_fits(fits: dict[tuple[int, int], KMeansFit]) -> dict[int, KMeansFit]:
    """The cheapest start of each k; of equal ones the first."""
    best: dict[int, KMeansFit] = {}
    for (k, _), fit in sorted(fits.items()):
        if k not in best or fit.cost < best[k].cost:
            best[k] = fit
    return best


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each point, and the squared distance to it."""
    away = (centers**2).sum(1) - 2 * (x @ centers.T)
    label = away.argmin(1)
    return label, np.square(x - centers[label]).sum(1)


def _assign(
    points: DataFrame, columns: list[str], centers: list[np.ndarray]
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each set of centres: rows, squared distances and sums of coordinates of each cluster, in one pass."""
    sizes = [len(c) for c in centers]
    first = np.cumsum([0, *sizes])
    d = len(columns)
    chunk = max(256, min(4096, (1 << 21) // max(sizes)))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((first[-1], 2 + d))
        for batch in batches:
            everything, weights = _matrix(batch, columns), batch.column("w").to_numpy(zero_copy_only=False)
            for begin in range(0, batch.num_rows, chunk):
                x, w = everything[begin : begin + chunk], weights[begin : begin + chunk]
                measures = np.column_stack([w, w, x * w[:, None]])
                for low, high, at in zip(first[:-1], first[1:], centers):
                    label, square = _nearest(x, at)
                    measures[:, 1] = w * square
                    for column in range(2 + d):
                        totals[low:high, column] += np.bincount(label, measures[:, column], high - low)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(first[-1]), pa.int32()), *[pa.array(totals[:, i].copy()) for i in range(2 + d)]],
            ["place", "n", "cost", *[f"s{i}" for i in range(d)]],
        )

    measured = ["n", "cost", *[f"s{i}" for i in range(d)]]
    parts = points.mapInArrow(add_up, "place int, " + ", ".join(f"{m} double" for m in measured))
    out = np.zeros((first[-1], 2 + d))
    for row in parts.groupBy("place").agg(*[F.sum(m).alias(m) for m in measured]).collect():
        out[row["place"]] = [row[m] for m in measured]
    return [(p[:, 0], p[:, 1], p[:, 2:]) for p in (out[a:b] for a, b in zip(first[:-1], first[1:]))]


def _uniform(columns: list[str], *salt: Column | int) -> Column:
    """A number in (0, 1) that the point and ``salt`` decide."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns, *[s if isinstance(s, Column) else F.lit(s) for s in salt]), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def _draw_seeds(points: DataFrame, columns: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Drawn points and how many rows are nearest to each: all points if they are few."""
    few = points.limit(FEW_POINTS + 1).collect()
    if len(few) <= FEW_POINTS:
        few.sort(key=lambda row: [row[c] for c in columns])
        return np.array([[row[c] for c in columns] for row in few]), np.array([row["w"] for row in few])
    # The first with equal chances for all rows: the smallest of exponential numbers.
    race = points.select("*", (-F.log(_uniform(columns, seed)) / F.col("w")).alias("rank"))
    first = race.agg(F.min_by(F.struct(*columns), F.struct("rank", *columns)).alias("p")).first()["p"]
    drawn = np.array([list(first)])
    for step in range(ROUNDS):
        ((_, cost, _),) = _assign(points, columns, [drawn])
        if not cost.sum():
            break
        drawn = np.unique(np.vstack([drawn, _draw(points, columns, drawn, DRAWN / cost.sum(), seed + 1 + step)]), axis=0)
    ((n, _, _),) = _assign(points, columns, [drawn])
    return drawn, n


def _draw(points: DataFrame, columns: list[str], drawn: np.ndarray, rate: float, seed: int) -> np.ndarray:
    """Points by chances of ``rate`` times their weighted squared distance to what is drawn."""
    keyed = points.select(*columns, "w", _uniform(columns, seed).alias("u"))
    schema = keyed.select(*columns).schema

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, w = _matrix(batch, columns), batch.column("w").to_numpy(zero_copy_only=False)
            square = np.concatenate([_nearest(x[i : i + 1024], drawn)[1] for i in range(0, len(x), 1024)] or [w])
            chosen = batch.column("u").to_numpy(zero_copy_only=False) < -np.expm1(-rate * w * square)
            yield batch.select(columns).filter(pa.array(chosen))

    # About DRAWN points, whatever the table.
    rows = keyed.mapInArrow(choose, schema).collect()
    return np.array([list(row) for row in rows]).reshape(-1, len(columns))


def _spread(at: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The best of some tries of k-means++ on weighted points, moved among them until it rests."""
    tries = [_steps(at, weight, _plus_plus(at, weight, k, rng), 3) for _ in range(TRIES)]
    best = min(tries, key=lambda centers: float(weight @ _nearest(at, centers)[1]))
    return _steps(at, weight, best, 50)


def _plus_plus(at: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    chosen = [int(rng.choice(len(at), p=weight / weight.sum()))]
    square = np.square(at - at[chosen[0]]).sum(1)
    while len(chosen) < min(k, len(at)):
        chance = weight * square
        if chance.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(at), p=chance / chance.sum())))
        square = np.minimum(square, np.square(at - at[chosen[-1]]).sum(1))
    return at[chosen].copy()


def _steps(at: np.ndarray, weight: np.ndarray, centers: np.ndarray, most: int) -> np.ndarray:
    for _ in range(most):
        label = _nearest(at, centers)[0]
        n = np.bincount(label, weight, len(centers))
        total = np.column_stack([np.bincount(label, weight * at[:, i], len(centers)) for i in range(at.shape[1])])
        fresh = np.where(n[:, None] > 0, total / np.where(n > 0, n, 1)[:, None], centers)
        if np.abs(fresh - centers).max() < 1e-3:
            return fresh
        centers = fresh
    return centers


def euclidean_silhouette(
    df: DataFrame, features: list[str], cluster: str = "cluster", references: int = REFERENCES, seed: int = 0
) -> DataFrame:
    """One row ``k, n, silhouette, std_error``: the mean silhouette of Euclidean distances over all rows.

    A row's mean distance to a cluster is estimated from ``references`` / k points of it, drawn by weight and distance to
    the cluster's centre and weighed by the inverse of their chance. A cluster of fewer points is compared whole, so
    small tables are exact and have no error. ``std_error`` comes from parts of the references.
    """
    coords = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    names = [f"x{i}" for i in range(len(features))]
    points = weighted_points(df.select(F.col(cluster).alias("label"), *coords), names, F.col("label"))
    centers = points.groupBy("label").agg(
        F.sum("w").alias("size"), *[(F.sum(F.col(n) * F.col("w")) / F.sum("w")).alias(f"c{i}") for i, n in enumerate(names)]
    )
    labels = sorted(centers.limit(references // 8 + 1).collect(), key=lambda row: row["label"])
    k, n = len(labels), int(sum(row["size"] for row in labels))
    schema = "k int, n bigint, silhouette double, std_error double"
    if k < 2:
        return df.sparkSession.createDataFrame([(k, n, 0.0, 0.0)], schema)
    if k > references // 8:
        raise ValueError(f"More clusters than the {references // 8} that {references} points can stand for.")
    number = F.array_position(F.array(*[F.lit(row["label"]) for row in labels]), F.col("label")).cast("int") - 1
    at = F.array(*[F.array(*[F.lit(row[f"c{i}"]) for i in range(len(names))]) for row in labels])
    own = F.element_at(at, F.col("_c") + 1)
    square = sum(((F.col(name) - own[i]) ** 2 for i, name in enumerate(names)), F.lit(0.0))
    placed = points.withColumn("_c", number).withColumn("_away", F.sqrt(square))
    spread = {row["_c"]: row["s"] for row in placed.groupBy("_c").agg(F.sum(F.col("w") * F.col("_away")).alias("s")).collect()}
    sizes = np.array([row["size"] for row in labels])
    share = F.element_at(F.array(*[F.lit(0.5 / s) for s in sizes]), F.col("_c") + 1)
    far = F.element_at(F.array(*[F.lit(0.5 / spread[c] if spread[c] > 0 else 0.5 / sizes[c]) for c in range(k)]), F.col("_c") + 1)
    leaning = F.when(F.element_at(F.array(*[F.lit(spread[c] > 0) for c in range(k)]), F.col("_c") + 1), F.col("_away")).otherwise(1.0)
    chance = F.least(F.lit(1.0), F.lit(references / k) * F.col("w") * (share + far * leaning))
    keyed = placed.withColumn("_chance", chance)
    chosen = keyed.where(_uniform(names, F.col("_c"), seed) < F.col("_chance")).select(
        "_c", *names, (F.col("w") / F.col("_chance")).alias("weight"), (F.col("_chance") < 1).alias("sampled"),
        F.pmod(F.xxhash64(*names, F.lit(seed + 1)), F.lit(REPLICATES)).cast("int").alias("part"),
    ).collect()  # about ``references`` rows
    measure = _widths([r for r in chosen], names, sizes)
    parts = placed.select("_c", "w", *names).mapInArrow(measure, "part int, total double")
    totals = {row["part"]: row["s"] for row in parts.groupBy("part").agg(F.sum("total").alias("s")).collect()}
    error = 0.0
    if any(row["sampled"] for row in chosen):
        means = np.array([totals[p] / n for p in range(REPLICATES)])
        error = float(means.std(ddof=1) / np.sqrt(REPLICATES))
    return df.sparkSession.createDataFrame([(k, n, round(totals[-1] / n, 4), round(error, 6))], schema)


def _widths(references: list, names: list[str], sizes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum of silhouette widths of the rows of a task: with all references (part -1), and with each part of them."""
    k = len(sizes)
    order = sorted(references, key=lambda r: (r["_c"], r["part"], [r[n] for n in names]))
    at = np.array([[r[n] for n in names] for r in order])
    weight = np.array([r["weight"] for r in order])
    group = np.array([r["_c"] * REPLICATES + r["part"] for r in order])
    edges = np.searchsorted(group, np.arange(k * REPLICATES + 1))
    weights = np.bincount(group, weight, k * REPLICATES).reshape(k, REPLICATES)
    all_weights, lengths = weights.sum(1), (at**2).sum(1)

    def width(away: np.ndarray, label: np.ndarray) -> np.ndarray:
        """``away``: mean distance of each row to all members of each cluster, itself included."""
        rows, size = np.arange(len(label)), sizes[label]
        inside = away[rows, label] * size / np.maximum(size - 1, 1)
        others = away.copy()
        others[rows, label] = np.inf
        outside = others.min(1)
        longer = np.maximum(inside, outside)
        return np.where((size > 1) & (longer > 0), (outside - inside) / np.where(longer > 0, longer, 1), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(REPLICATES + 1)
        for batch in batches:
            everything = _matrix(batch, names)
            labels, rows = batch.column("_c").to_numpy(zero_copy_only=False), batch.column("w").to_numpy(zero_copy_only=False)
            for begin in range(0, batch.num_rows, 256):
                x, label, w = (part[begin : begin + 256] for part in (everything, labels, rows))
                square = np.maximum((x**2).sum(1)[:, None] - 2 * (x @ at.T) + lengths, 0.0)
                sums = np.add.reduceat(np.pad(np.sqrt(square) * weight, ((0, 0), (0, 1))), edges[:-1], axis=1)
                sums[:, edges[:-1] == edges[1:]] = 0
                sums = sums.reshape(len(x), k, REPLICATES)
                # Divided by the weights as they add up, which the number drawn cancels from.
                whole = sums.sum(2) / all_weights
                total[-1] += w @ width(whole, label)
                for part in range(REPLICATES):
                    held = weights[:, part]
                    away = np.where(held > 0, sums[:, :, part] / np.where(held > 0, held, 1), whole)
                    total[part] += w @ width(away, label)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(REPLICATES), -1], pa.int32()), pa.array(total)], ["part", "total"]
        )

    return run

"""Feature scaling, K-Means segments, their quality, profiles and stable numbering."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.functions.order_stats import exact_percentiles, unpivot_metrics
from patronage.functions.text import exact_mean, exact_sum, round_to
from patronage.operators.kmeans import KMeansFit, best_fits, euclidean_silhouette, fit_many, weighted_points
from patronage.schema import RFM_FEATURES, require_columns
from patronage.session import materialize

# Cluster counts tried, smallest table worth clustering, seed, starts per fit and the
# spread below which features count as constant.
K_MIN, K_MAX = 2, 8
MIN_CUSTOMERS = 10
SEED = 42
STARTS = 10
LOW_SPREAD = 0.01
MAX_CLUSTERS = 1000


def z(feature: str) -> str:
    return f"z_{feature}"


@dataclass(frozen=True)
class Scaler:
    """``(log1p(max(x, 0)) - center) / scale`` per feature; ``flat`` maps everything to 0."""

    features: tuple[str, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    flat: bool = False

    def sql(self) -> dict[str, str]:
        """Scaled column name to SQL text, for use in a saved transformer."""
        out = {}
        for f, c, s in zip(self.features, self.center, self.scale):
            log = f"log1p(greatest(cast(`{f}` as double), 0D))"
            out[z(f)] = "0D" if self.flat else f"({log} - {c!r}D) / {s!r}D"
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[F.expr(e).alias(name) for name, e in self.sql().items()])


def fit_scaler(
    rfm: DataFrame,
    features: list[str] = RFM_FEATURES,
    scaler_type: str = "standard",
    guard: bool = True,
) -> Scaler:
    """Centre and spread of the log features: mean and population deviation, or median and IQR."""
    require_columns(rfm, features, "scaling")
    logs = rfm.select(
        *[F.log1p(F.greatest(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in features]
    )
    stats = logs.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"mean_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"std_{f}") for f in features],
    ).first()
    if stats["n"] < MIN_CUSTOMERS:
        raise ValueError(
            f"The table holds {stats['n']} customers; clusters need {MIN_CUSTOMERS} or more."
        )
    center = [stats[f"mean_{f}"] for f in features]
    spread = [stats[f"std_{f}"] for f in features]
    if guard and max(spread) < LOW_SPREAD:
        return Scaler(tuple(features), tuple(center), (1.0,) * len(features), flat=True)
    if scaler_type.lower() == "robust":
        long = unpivot_metrics(logs, [], list(features))
        quartiles = exact_percentiles(
            long, ["metric"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}
        ).collect()
        by_metric = {r["metric"]: r for r in quartiles}
        center = [by_metric[f]["q2"] for f in features]
        spread = [by_metric[f]["q3"] - by_metric[f]["q1"] for f in features]
    # Rounding noise of a constant column counts as no spread at all.
    tiny = 10 * np.finfo(float).eps
    scale = [s if s > tiny * max(1.0, abs(c)) else 1.0 for s, c in zip(spread, center)]
    return Scaler(tuple(features), tuple(center), tuple(scale))


def preprocess_rfm(
    rfm: DataFrame, features: list[str] = RFM_FEATURES, scaler_type: str = "standard"
) -> tuple[DataFrame, Scaler]:
    scaler = fit_scaler(rfm, features, scaler_type)
    return scaler.transform(rfm), scaler


def _fits(scaled: DataFrame, columns: list[str], k_values: list[int], seed: int, starts: int) -> dict[int, KMeansFit]:
    """The best of several seeded starts for each k."""
    return best_fits(fit_many(weighted_points(scaled, columns), columns, k_values, starts, seed))


def label_by_centers(scaled: DataFrame, columns: list[str], centers: list[list[float]]) -> DataFrame:
    """Add ``cluster``, the number of the nearest centre."""
    away, nearest = nearest_center_sql(centers, columns)
    return scaled.withColumn("_away", F.expr(away)).withColumn("cluster", F.expr(nearest)).drop("_away")


def run_kmeans(
    scaled: DataFrame,
    k: int,
    features: list[str] = RFM_FEATURES,
    seed: int = SEED,
    starts: int = STARTS,
) -> tuple[DataFrame, KMeansFit]:
    """Best of several seeded K-Means starts on scaled features; labels in ``cluster``."""
    n = scaled.count()
    if k < 2 or k >= n:
        raise ValueError(f"k={k} is not between 2 and {n - 1}.")
    columns = [z(f) for f in features]
    fit = _fits(scaled, columns, [k], seed, starts)[k]
    return label_by_centers(scaled, columns, fit.centers), fit


def cluster_centers(df: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """Size and mean of ``features`` per cluster: one row each."""
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).cast("double")).alias(f) for f in features]
    )


def _squared_distance(features: list[str], at: Column) -> Column:
    return sum(((F.col(f) - at[i]) ** 2 for i, f in enumerate(features)), F.lit(0.0))


def cluster_validity(df: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """One row: ``k, n, inertia, silhouette, calinski_harabasz, davies_bouldin`` of given labels.

    Two aggregations over all customers. The silhouette is the one of squared distances: the mean
    squared distance of a customer to a cluster follows from that cluster's size, mean and mean square, so no
    pairs of customers are formed and none are left out.
    """
    square = sum((F.col(f).cast("double") ** 2 for f in features), F.lit(0.0))
    centers = (
        df.groupBy(cluster)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(F.col(f).cast("double")).alias(f) for f in features],
            F.avg(square).alias("_square"),
        )
        .limit(MAX_CLUSTERS + 1)
        .collect()
    )
    if len(centers) > MAX_CLUSTERS:
        raise ValueError(f"More clusters than the {MAX_CLUSTERS} that can be compared.")
    centers.sort(key=lambda row: row[cluster])
    k, n = len(centers), sum(row["n"] for row in centers)
    away = F.array(
        *[
            F.struct(
                F.lit(row[cluster]).alias("cluster"),
                F.lit(row["n"]).alias("n"),
                _squared_distance(features, [F.lit(float(row[f])) for f in features]).alias("to_center"),
                (square + F.lit(row["_square"]) - 2 * _dot(features, row)).alias("to_members"),
            )
            for row in centers
        ]
    )
    placed = df.select(cluster, away.alias("_away")).select(
        cluster,
        F.element_at(F.filter("_away", lambda c: c["cluster"] == F.col(cluster)), 1).alias("_own"),
        F.array_min(
            F.transform(F.filter("_away", lambda c: c["cluster"] != F.col(cluster)), lambda c: c["to_members"])
        ).alias("_outside"),
    )
    outside = F.greatest(F.col("_outside"), F.lit(0.0))
    inside = F.greatest(F.col("_own.to_members"), F.lit(0.0)) * F.col("_own.n") / (F.col("_own.n") - 1)
    width = F.when(
        F.col("_own.n") > 1, F.coalesce(F.try_divide(outside - inside, F.greatest(outside, inside)), F.lit(0.0))
    ).otherwise(0.0)
    spread = (
        placed.groupBy(cluster)
        .agg(
            F.sum("_own.to_center").alias("within"),
            F.avg(F.sqrt("_own.to_center")).alias("mean_distance"),
            F.sum(width).alias("widths"),
        )
        .collect()
    )
    within = sum(row["within"] for row in spread)
    if k < 2:
        indices = (0.0, 0.0, 99.0)
    else:
        points = np.array([[row[f] for f in features] for row in centers], dtype=float)
        sizes = np.array([row["n"] for row in centers], dtype=float)
        mean = (points * sizes[:, None]).sum(0) / n
        between = float((sizes * ((points - mean) ** 2).sum(1)).sum())
        calinski = 1.0 if within == 0 else (between / (k - 1)) / (within / max(n - k, 1))
        gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
        scatter = {row[cluster]: row["mean_distance"] for row in spread}
        s = np.array([scatter[row[cluster]] for row in centers])
        np.fill_diagonal(gaps, np.inf)
        gaps[gaps == 0] = np.inf
        davies = float(((s[:, None] + s[None]) / gaps).max(1).mean())
        indices = (sum(row["widths"] for row in spread) / n, calinski, davies)
    row = (k, n, round(within, 2), round(indices[0], 4), round(indices[1], 2), round(indices[2], 4))
    return df.sparkSession.createDataFrame(
        [row],
        "k int, n bigint, inertia double, silhouette double, calinski_harabasz double, "
        "davies_bouldin double",
    )


def _dot(features: list[str], center) -> Column:
    return sum((F.col(f).cast("double") * F.lit(float(center[f])) for f in features), F.lit(0.0))


def evaluate_clusters(
    scaled: DataFrame,
    k_values: list[int] | None = None,
    features: list[str] = RFM_FEATURES,
    seed: int = SEED,
    starts: int = STARTS,
) -> DataFrame:
    """One row per k: indices and centres of the best of ``starts`` fits, ``low_variance`` and a ``warning`` if any.

    All fits run together. ``silhouette`` is the mean over Euclidean distances (see :func:`euclidean_silhouette`),
    ``silhouette_squared`` that of :func:`cluster_validity`."""
    table = materialize(scaled.select(*[z(f) for f in features]))
    zs = [z(f) for f in features]
    n = table.count()
    if k_values is None:
        top = min(K_MAX, n - 1)
        k_values = list(range(min(K_MIN, top), top + 1))
    else:
        k_values = [k for k in k_values if 2 <= k < n]
        if not k_values:
            raise ValueError(f"None of the cluster counts lies between 2 and {n - 1}.")
    # Spread of all scaled cells together, around their common mean.
    cells = sum((F.col(c) for c in zs), F.lit(0.0))
    squares = sum((F.col(c) ** 2 for c in zs), F.lit(0.0))
    total = table.agg(F.avg(cells).alias("s"), F.avg(squares).alias("q")).first()
    mean = total["s"] / len(zs)
    spread = max(total["q"] / len(zs) - mean * mean, 0.0) ** 0.5

    spark = table.sparkSession
    schema = (
        "k int, inertia double, silhouette double, calinski_harabasz double, "
        "davies_bouldin double, low_variance boolean, warning string, silhouette_squared double, "
        "centers array<array<double>>"
    )
    if spread < LOW_SPREAD:
        warning = (
            "All customers have almost the same metrics; clusters of them mean little."
        )
        return spark.createDataFrame(
            [(k, 0.0, 0.0, None, None, True, warning, 0.0, None) for k in k_values], schema
        )
    fits = _fits(table, zs, k_values, seed, starts)

    def indices(k: int) -> tuple:
        labeled = label_by_centers(table, zs, fits[k].centers)
        v, width = cluster_validity(labeled, zs).first(), euclidean_silhouette(labeled, zs, seed=seed).first()
        return (k, round(fits[k].cost, 2), width["silhouette"], v["calinski_harabasz"], v["davies_bouldin"], False, None,
                v["silhouette"], fits[k].centers)

    with ThreadPoolExecutor(max_workers=4) as pool:
        rows = list(pool.map(indices, k_values))
    return spark.createDataFrame(rows, schema)


def best_k(evaluation: DataFrame) -> DataFrame:
    """One row: best k by silhouette, Calinski-Harabasz and Davies-Bouldin; ties to the smallest."""
    k = F.col("k")
    return evaluation.agg(
        F.max_by("k", F.struct(F.col("silhouette"), -k)).alias("best_k"),
        F.max("silhouette").alias("best_silhouette"),
        F.max_by("k", F.when(F.col("calinski_harabasz").isNotNull(),
                             F.struct(F.col("calinski_harabasz"), -k))).alias("best_k_calinski"),
        F.min_by("k", F.when(F.col("davies_bouldin").isNotNull(),
                             F.struct(F.col("davies_bouldin"), k))).alias("best_k_davies"),
    )


def adjusted_rand(one: DataFrame, other: DataFrame, key: str, cluster: str = "cluster") -> float:
    """How alike two groupings of the rows in both are: 1 for equal ones, about 0 for unrelated ones. The groups meet in a
    table of counts, one row for each pair of clusters."""
    cells = (
        one.select(key, F.col(cluster).alias("_a"))
        .join(other.select(key, F.col(cluster).alias("_b")), key)
        .groupBy("_a", "_b")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )

    def pairs(counts) -> float:
        return sum(n * (n - 1) / 2 for n in counts)

    rows, columns = {}, {}
    for cell in cells:
        rows[cell["_a"]] = rows.get(cell["_a"], 0) + cell["n"]
        columns[cell["_b"]] = columns.get(cell["_b"], 0) + cell["n"]
    together, in_rows, in_columns = pairs(c["n"] for c in cells), pairs(rows.values()), pairs(columns.values())
    all_pairs = pairs([sum(rows.values())])
    expected = in_rows * in_columns / all_pairs if all_pairs else 0.0
    most = (in_rows + in_columns) / 2
    return 1.0 if most == expected else (together - expected) / (most - expected)


def cluster_profiles(clustered: DataFrame) -> DataFrame:
    """Size, revenue, mean and median metrics and shares per cluster."""
    require_columns(clustered, ["cluster", *RFM_FEATURES], "cluster profiles")
    sums = clustered.groupBy("cluster").agg(
        F.count("customer_id").alias("customer_count"),
        exact_sum(F.col("monetary")).alias("revenue"),
        *[exact_mean(F.col(f)).alias(f"mean_{f}") for f in RFM_FEATURES],
    )
    long = unpivot_metrics(clustered, ["cluster"], RFM_FEATURES)
    medians = (
        exact_percentiles(long, ["cluster", "metric"], "value", {"median": 0.5})
        .groupBy("cluster")
        .agg(*[F.max(F.when(F.col("metric") == f, F.col("median"))).alias(f"median_{f}")
               for f in RFM_FEATURES])
    )
    everything = W.partitionBy()
    revenue = F.col("revenue").cast("double")
    all_revenue = F.sum("revenue").over(everything).cast("double")
    share = F.when(all_revenue > 0, F.try_divide(revenue, all_revenue) * 100).otherwise(0.0)
    heads = F.col("customer_count") / F.sum("customer_count").over(everything) * 100
    return sums.join(medians, "cluster").select(
        "cluster",
        "customer_count",
        round_to(revenue, 2).alias("total_revenue"),
        *[round_to(F.col(f"{s}_{f}"), 2).alias(f"{s}_{f}") for f in RFM_FEATURES for s in ("mean", "median")],
        round_to(heads, 1).alias("customer_share_pct"),
        round_to(share, 1).alias("revenue_share_pct"),
    )


def align_centroids(
    centroids: np.ndarray, anchors: np.ndarray | None = None
) -> tuple[np.ndarray, dict[int, int]]:
    """Stable cluster numbers: cheapest pairing with ``anchors``, else rank by ``-R + F + M``.

    Works on the k centroids only; ``relabel_clusters`` applies the numbering to the customers.
    """
    centroids = np.asarray(centroids, dtype=float)
    if anchors is not None and np.shape(anchors) == centroids.shape:
        distance = np.sqrt(((centroids[:, None] - np.asarray(anchors, float)[None]) ** 2).sum(-1))
        numbers = cheapest_pairing(distance)
    else:
        signs = [-1, 1, 1] if centroids.shape[1] >= 3 else [1] * centroids.shape[1]
        health = centroids[:, : len(signs)] @ np.array(signs, dtype=float)
        numbers = np.argsort(np.argsort(health, kind="stable"), kind="stable")
    return centroids[np.argsort(numbers)], dict(enumerate(numbers.tolist()))


def cheapest_pairing(cost: np.ndarray) -> np.ndarray:
    """Column for each row of a square table, each used once, at the least total cost (Hungarian method)."""
    k = len(cost)
    row_price, column_price = np.zeros(k), np.zeros(k)
    owner = np.full(k, -1)
    for row in range(k):
        # Grow a tree of cheapest alternating paths from this row until it meets a free column.
        slack, reached_from, done = np.full(k, np.inf), np.full(k, -1), np.zeros(k, bool)
        column, current = -1, row
        while True:
            gap = cost[current] - row_price[current] - column_price
            better = ~done & (gap < slack)
            slack[better], reached_from[better] = gap[better], column
            following = int(np.where(done, np.inf, slack).argmin())
            step = slack[following]
            row_price[row] += step
            row_price[owner[done]] += step
            column_price[done] -= step
            slack[~done] -= step
            done[following] = True
            column = following
            if owner[column] < 0:
                break
            current = owner[column]
        while column >= 0:
            before = reached_from[column]
            owner[column] = owner[before] if before >= 0 else row
            column = before
    return np.argsort(owner)


def relabel_clusters(clustered: DataFrame, mapping: dict[int, int]) -> DataFrame:
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    return clustered.withColumn(
        "cluster", F.try_element_at(F.create_map(*pairs), F.col("cluster").cast("int"))
    )


def mark_whales(rfm: DataFrame, quantile: float = 0.995) -> DataFrame:
    """Add ``is_whale``: frequency or spend strictly above its quantile; nobody below 50 rows."""
    require_columns(rfm, ["frequency", "monetary"], "whale isolation")
    long = unpivot_metrics(rfm, [], ["frequency", "monetary"])
    n = rfm.count()
    found = exact_percentiles(long, ["metric"], "value", {"q": quantile}).collect()
    if n < 50:
        return rfm.withColumn("is_whale", F.lit(False))
    limits = {r["metric"]: r["q"] for r in found}
    whale = (F.col("frequency") > limits["frequency"]) | (F.col("monetary") > limits["monetary"])
    return rfm.withColumn("is_whale", whale)


def isolate_whales(rfm: DataFrame, quantile: float = 0.995) -> tuple[DataFrame, DataFrame]:
    """Retail core and whales as two DataFrames."""
    marked = mark_whales(rfm, quantile)
    return (
        marked.where(~F.col("is_whale")).drop("is_whale"),
        marked.where("is_whale").drop("is_whale"),
    )


def boundary_confidence(
    scaled: DataFrame, centroids: list[list[float]], features: list[str]
) -> DataFrame:
    """Add ``confidence``: 1 - nearest / second nearest centroid distance, within [0, 1]."""
    if len(centroids) < 2:
        return scaled.withColumn("confidence", F.lit(1.0))
    distances = F.array_sort(
        F.array(
            *[
                F.sqrt(_squared_distance(features, [F.lit(float(x)) for x in c]))
                for c in centroids
            ]
        )
    )
    ratio = distances[0] / F.greatest(distances[1], F.lit(1e-6))
    return scaled.withColumn(
        "confidence", F.least(F.greatest(1.0 - ratio, F.lit(0.0)), F.lit(1.0))
    )


@dataclass(frozen=True)
class SegmentModel:
    """Raw metrics to ``cluster`` (the nearest of ``centers`` in scaled space) in plain SQL stages."""

    pipeline: PipelineModel
    k: int
    inertia: float | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)


def nearest_center_sql(centers: list[list[float]], columns: list[str]) -> tuple[str, str]:
    """SQL for the squared distances to all centres, and for the number of the nearest in ``_away``."""
    distances = [
        " + ".join(f"power(`{c}` - ({float(v)!r}D), 2)" for c, v in zip(columns, center)) for center in centers
    ]
    return f"array({', '.join(distances)})", "cast(array_position(_away, array_min(_away)) - 1 AS int)"


def segment_model(scaler: Scaler, centers: list[list[float]], inertia: float | None = None) -> SegmentModel:
    """Model from known centres, such as those of a fit or of an earlier version."""
    columns = [z(f) for f in scaler.features]
    scaled = ", ".join(f"{e} AS {name}" for name, e in scaler.sql().items())
    away, nearest = nearest_center_sql(centers, columns)
    stages = [
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        SQLTransformer(statement=f"SELECT *, {away} AS _away FROM __THIS__"),
        SQLTransformer(statement=f"SELECT * EXCEPT (_away), {nearest} AS cluster FROM __THIS__"),
    ]
    return SegmentModel(PipelineModel(stages=stages), len(centers), inertia)


def inertia_of(scaled: DataFrame, centers: list[list[float]], columns: list[str]) -> float:
    """Sum of squared distances to the nearest centre."""
    away, _ = nearest_center_sql(centers, columns)
    return scaled.agg(F.sum(F.expr(f"array_min({away})"))).first()[0]


def fit_rfm_pipeline(
    rfm: DataFrame,
    k: int,
    features: list[str] = RFM_FEATURES,
    seed: int = SEED,
    scaler_type: str = "standard",
    starts: int = STARTS,
) -> tuple[SegmentModel, DataFrame]:
    """One model from raw metrics to ``cluster``, and the labeled input."""
    table = materialize(rfm)
    scaler = fit_scaler(table, features, scaler_type, guard=False)
    columns = [z(f) for f in features]
    fit = _fits(scaler.transform(table), columns, [k], seed, starts)[k]
    model = segment_model(scaler, fit.centers, fit.cost)
    return model, model.transform(table).drop(*columns)

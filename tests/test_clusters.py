from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.operators import clusters
from patronage.operators import kmeans
from patronage.operators.clusters import (
    adjusted_rand,
    align_centroids,
    best_k,
    boundary_confidence,
    cheapest_pairing,
    cluster_profiles,
    cluster_validity,
    evaluate_clusters,
    fit_rfm_pipeline,
    isolate_whales,
    preprocess_rfm,
    relabel_clusters,
    run_kmeans,
)
from patronage.operators.personas import (
    classify,
    label_segments,
    persona_mapping,
    with_persona_details,
)
from patronage.schema import RFM_FEATURES
from tests.conftest import by, one

ZS = [clusters.z(f) for f in RFM_FEATURES]
CLUSTERED = "customer_id string, recency double, frequency double, monetary double, cluster int"


def moments(df):
    row = one(df.agg(*[F.avg(z).alias(f"m{z}") for z in ZS], *[F.stddev_pop(z).alias(f"s{z}") for z in ZS]))
    return [row[f"m{z}"] for z in ZS], [row[f"s{z}"] for z in ZS]


def test_standard_scaling(rfm_base):
    means, spreads = moments(preprocess_rfm(rfm_base)[0])
    assert means == pytest.approx([0, 0, 0], abs=1e-9) and spreads == pytest.approx([1, 1, 1])


def test_robust_scaling(rfm_base):
    scaled, _ = preprocess_rfm(rfm_base, scaler_type="robust")
    logs = np.log1p(np.array([[r[f] for f in RFM_FEATURES] for r in scaled.collect()], float))
    found = np.array([[r[z] for z in ZS] for r in scaled.collect()])
    q1, q2, q3 = np.percentile(logs, [25, 50, 75], axis=0)
    assert found == pytest.approx((logs - q2) / (q3 - q1))


def test_constant_features_scale_to_zero(spark):
    rows = [(str(i), 10 + i * 1e-5, 2, 100 + i * 1e-5) for i in range(20)]
    df = spark.createDataFrame(rows, "customer_id string, recency double, frequency int, monetary double")
    scaled, scaler = preprocess_rfm(df)
    assert scaler.flat and moments(scaled)[1] == [0, 0, 0]
    evaluation = evaluate_clusters(scaled)
    assert evaluation.count() == 7
    first = one(evaluation.orderBy("k"))
    assert first["low_variance"] and first["calinski_harabasz"] is None and "almost the same" in first["warning"]
    assert one(best_k(evaluation))["best_k"] == 2


def test_too_few_customers_and_missing_features(rfm_base):
    with pytest.raises(ValueError, match="need 10"):
        preprocess_rfm(rfm_base.limit(9))
    with pytest.raises(ValueError, match="spend"):
        preprocess_rfm(rfm_base, ["recency", "spend"])


def test_kmeans_finds_the_groups(rfm_base):
    scaled, _ = preprocess_rfm(rfm_base)
    labeled, model = run_kmeans(scaled, 3, starts=3)
    groups = labeled.select(F.split("customer_id", "_")[1].alias("g"), "cluster").distinct().collect()
    assert len(groups) == 3 and len({r["cluster"] for r in groups}) == 3
    for k in (1, 30):
        with pytest.raises(ValueError, match="not between"):
            run_kmeans(scaled, k)


def test_evaluation(rfm_base):
    scaled, _ = preprocess_rfm(rfm_base)
    table = evaluate_clusters(scaled, [2, 3, 4, 40], starts=3)
    rows = table.orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3, 4]
    inertias = [r["inertia"] for r in rows]
    assert inertias == sorted(inertias, reverse=True)
    assert one(best_k(table))["best_silhouette"] == max(r["silhouette"] for r in rows)
    with pytest.raises(ValueError, match="None of the cluster counts"):
        evaluate_clusters(scaled, [1, 100])


def points(seed, n, spark):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) + rng.integers(0, 3, size=(n, 1)) * 2.5
    label = rng.integers(0, 4, size=n)
    rows = [(str(i), float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, label))]
    return x, label, spark.createDataFrame(rows, "customer_id string, u double, v double, cluster int")


def test_validity_equals_direct_formulas(spark):
    x, label, df = points(1, 150, spark)
    found = one(cluster_validity(df, ["u", "v"]))
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    widths = []
    for i in range(len(x)):
        own = [j for j in range(len(x)) if label[j] == label[i] and j != i]
        inside = distance[i, own].mean()
        outside = min(distance[i, label == c].mean() for c in set(label) - {label[i]})
        widths.append((outside - inside) / max(inside, outside))
    centers = np.array([x[label == c].mean(0) for c in range(4)])
    within = sum(((x[label == c] - centers[c]) ** 2).sum() for c in range(4))
    between = sum((label == c).sum() * ((centers[c] - x.mean(0)) ** 2).sum() for c in range(4))
    spread = [np.sqrt(((x[label == c] - centers[c]) ** 2).sum(1)).mean() for c in range(4)]
    davies = np.mean([
        max((spread[a] + spread[b]) / np.linalg.norm(centers[a] - centers[b]) for b in range(4) if b != a)
        for a in range(4)
    ])
    assert found["silhouette"] == pytest.approx(np.mean(widths), abs=1e-4)
    assert found["inertia"] == pytest.approx(within, abs=0.01)
    assert found["calinski_harabasz"] == pytest.approx(between / 3 / (within / (150 - 4)), abs=0.01)
    assert found["davies_bouldin"] == pytest.approx(davies, abs=1e-4)


def test_silhouette_sees_every_row(spark):
    x, label, df = points(2, 2500, spark)
    label = np.where(np.arange(2500) == 7, 9, label)  # a cluster of one has width 0
    df = df.withColumn("cluster", F.when(F.col("customer_id") == "7", 9).otherwise(F.col("cluster")))
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    names, owner = np.unique(label, return_inverse=True)
    sums, sizes, rows = distance @ np.eye(len(names))[owner], np.bincount(owner), np.arange(len(x))
    inside, outside = sums[rows, owner] / np.maximum(sizes[owner] - 1, 1), sums / sizes
    outside[rows, owner] = np.inf
    width = (outside.min(1) - inside) / np.maximum(inside, outside.min(1))
    width[sizes[owner] == 1] = 0
    assert one(cluster_validity(df, ["u", "v"]))["silhouette"] == pytest.approx(width.mean(), abs=1e-4)


def euclidean_widths(x, label):
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    names, owner = np.unique(label, return_inverse=True)
    sums, sizes, rows = distance @ np.eye(len(names))[owner], np.bincount(owner), np.arange(len(x))
    inside, outside = sums[rows, owner] / np.maximum(sizes[owner] - 1, 1), sums / sizes
    outside[rows, owner] = np.inf
    width = (outside.min(1) - inside) / np.maximum(inside, outside.min(1))
    width[sizes[owner] == 1] = 0
    return width


def test_euclidean_silhouette_is_exact_on_small_tables(spark):
    x, label, df = points(5, 900, spark)
    again = df.unionByName(df.where("cluster = 1"))  # equal rows count as often as they occur
    x2, label2 = np.vstack([x, x[label == 1]]), np.append(label, label[label == 1])
    for table, at, of in ((df, x, label), (again, x2, label2)):
        found = one(kmeans.euclidean_silhouette(table, ["u", "v"]))
        assert (found["k"], found["n"], found["std_error"]) == (4, len(at), 0.0)
        assert found["silhouette"] == pytest.approx(euclidean_widths(at, of).mean(), abs=1e-4)
    alone = one(kmeans.euclidean_silhouette(df.withColumn("cluster", F.lit(1)), ["u", "v"]))
    assert (alone["k"], alone["silhouette"]) == (1, 0.0)
    single = df.withColumn("cluster", F.when(F.col("customer_id") == "7", 9).otherwise(F.col("cluster")))
    width = euclidean_widths(x, np.where(np.arange(900) == 7, 9, label)).mean()
    assert one(kmeans.euclidean_silhouette(single, ["u", "v"]))["silhouette"] == pytest.approx(width, abs=1e-4)


def test_sampled_silhouette_stays_within_its_error(spark):
    """Fitted groups of unlike size and spread, a few references of them, several draws."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 1, (3000, 2)), rng.normal(5, 0.3, (500, 2)), rng.standard_t(3, (400, 2)) + [9, -4]])
    label = np.repeat([0, 1, 2], [3000, 500, 400])
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, label)], "u double, v double, cluster int")
    exact = euclidean_widths(x, label).mean()
    for seed in range(3):
        found = one(kmeans.euclidean_silhouette(df, ["u", "v"], references=600, seed=seed))
        assert 0 < found["std_error"] < 0.02
        assert abs(found["silhouette"] - exact) <= max(0.005, 4 * found["std_error"])
    larger = one(kmeans.euclidean_silhouette(df, ["u", "v"], references=4000))
    assert abs(larger["silhouette"] - exact) < 0.005


def test_all_fits_in_few_passes_and_as_good_as_spark_ml(spark, monkeypatch):
    """At most a hundred passes for all k and starts; no k costs more than the best of as many starts of Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(rng.uniform(-4, 4, 3), rng.uniform(0.2, 1), (500, 3)) for _ in range(6)])
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], "a double, b double, c double")
    passes = []
    assign = kmeans._assign
    monkeypatch.setattr(kmeans, "_assign", lambda *args: passes.append(len(args[2])) or assign(*args))
    fits = kmeans.fit_many(kmeans.weighted_points(df, ["a", "b", "c"]), ["a", "b", "c"], [2, 4, 6], 5, 42)
    assert len(fits) == 15 and len(passes) <= 100
    # One set of drawn points at first, then all fits, at last the best of each k.
    assert passes[0] == 1 and 15 in passes and passes[-1] == 3
    best = kmeans.best_fits(fits)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    for k, fit in best.items():
        costs = [KMeans(k=k, seed=s, maxIter=100).fit(vectors).summary.trainingCost for s in range(5)]
        assert fit.cost <= min(costs) * (1 + 1e-5)
        centers = np.array(fit.centers)
        label = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        assert np.allclose([x[label == c].mean(0) for c in range(k)], centers, atol=1e-3)
    again = kmeans.fit_many(kmeans.weighted_points(df.repartition(7), ["a", "b", "c"]), ["a", "b", "c"], [4], 2, 42)
    assert {job: pytest.approx(fit.cost) for job, fit in again.items()} == {
        job: fit.cost for job, fit in kmeans.fit_many(
            kmeans.weighted_points(df, ["a", "b", "c"]), ["a", "b", "c"], [4], 2, 42).items()}


def test_fits_of_few_and_of_equal_points(spark):
    df = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)] * 3 + [(9.0,)], "a double")
    fits = kmeans.best_fits(kmeans.fit_many(kmeans.weighted_points(df, ["a"]), ["a"], [2, 3, 5], 3, 1))
    assert sorted(c[0] for c in fits[3].centers) == [1.0, 2.0, 9.0] and fits[3].cost == 0
    assert len(fits[5].centers) == 3 and fits[2].cost == pytest.approx(8 * 0.234375, abs=1e-9)


def test_too_many_clusters_are_refused_early(spark):
    with pytest.raises(ValueError, match="1000"):
        cluster_validity(spark.range(1500).selectExpr("id AS cluster", "id AS u"), ["u"])


def test_single_cluster_has_no_quality(spark):
    _, _, df = points(3, 30, spark)
    row = one(cluster_validity(df.withColumn("cluster", F.lit(0)), ["u", "v"]))
    assert (row["silhouette"], row["calinski_harabasz"], row["davies_bouldin"]) == (0.0, 0.0, 99.0)


def test_alignment_to_anchors():
    anchors = [[-1, 1.5, 2], [0, 0, 0], [1.5, -1, -1]]
    fresh = [[1.52, -0.98, -1.01], [-0.99, 1.48, 2.02], [0.01, -0.02, 0.03]]
    aligned, mapping = align_centroids(fresh, anchors)
    assert mapping == {0: 2, 1: 0, 2: 1} and aligned[2].tolist() == fresh[0]


def test_alignment_by_health():
    assert align_centroids([[-1, 2, 2], [1, -1, -1], [0, 0.5, 0.5]])[1] == {1: 0, 2: 1, 0: 2}
    assert align_centroids([[5.0], [1.0]])[1] == {1: 0, 0: 1}


@pytest.mark.parametrize("k", [1, 2, 5, 7, 40])
def test_pairing_is_the_cheapest(k):
    cost = np.random.default_rng(k).random((k, k)).round(1)
    found = cheapest_pairing(cost)
    assert sorted(found.tolist()) == list(range(k))
    if k <= 7:
        best = min(cost[range(k), list(p)].sum() for p in permutations(range(k)))
        assert cost[range(k), found].sum() == pytest.approx(best)
    anchors = np.random.default_rng(1).random((k, 3)) * 100
    order = np.random.default_rng(2).permutation(k)
    assert align_centroids(anchors[order] + 0.01, anchors)[1] == dict(enumerate(order.tolist()))


def test_relabel(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1)], "customer_id string, cluster int")
    assert {r["customer_id"]: r["cluster"] for r in relabel_clusters(df, {0: 1, 1: 0}).collect()} == {"a": 1, "b": 0}


def test_whales(spark):
    rows = [(str(i), 1 + i % 5, 100.0 + i) for i in range(99)] + [("whale", 500, 100000.0)]
    df = spark.createDataFrame(rows, "customer_id string, frequency int, monetary double")
    core, whales = isolate_whales(df, 0.98)
    assert "whale" in {r["customer_id"] for r in whales.collect()} and core.count() + whales.count() == 100
    assert isolate_whales(df.limit(49))[1].isEmpty()


def test_confidence(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0)], "x double, y double")
    near, middle = boundary_confidence(df, [[0, 0], [10, 10]], ["x", "y"]).orderBy("x").collect()
    assert near["confidence"] > 0.99 and middle["confidence"] < 0.05
    assert one(boundary_confidence(df, [[0, 0]], ["x", "y"]))["confidence"] == 1.0


def test_fitted_model_equals_the_separate_steps(rfm_base):
    model, labeled = fit_rfm_pipeline(rfm_base, 3, starts=3)
    scaled, _ = preprocess_rfm(rfm_base)
    separate, _ = run_kmeans(scaled, 3, starts=3)
    pairs = labeled.select("customer_id", "cluster").join(
        separate.select("customer_id", F.col("cluster").alias("other")), "customer_id")
    assert pairs.select("cluster", "other").distinct().count() == 3
    assert set(labeled.columns) == {*rfm_base.columns, "cluster"}


def test_stability_under_resampling(spark, sf):
    """Adjusted Rand index between the whole table and 90 % subsamples."""
    from catalog.inputs import rfm

    table = rfm(spark, sf)
    scaled, _ = preprocess_rfm(table)
    base = run_kmeans(scaled, 3, starts=5)[0]
    scores = []
    for seed in (1, 2):
        part, _ = preprocess_rfm(table.sample(0.9, seed=seed))
        other = run_kmeans(part, 3, starts=5)[0]
        scores.append(adjusted_rand(base, other, "customer_id"))
    assert np.mean(scores) >= 0.8


def test_adjusted_rand(spark):
    rows = [(str(i), i % 3, (i % 3 + 1) % 3, i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, a int, b int, c int")
    of = lambda c: df.select("k", F.col(c).alias("cluster"))
    assert adjusted_rand(of("a"), of("b"), "k") == pytest.approx(1)
    assert abs(adjusted_rand(of("a"), of("c"), "k")) < 0.02
    assert adjusted_rand(of("a"), of("a").limit(0), "k") == 1


def test_profiles(spark):
    rows = [("a", 1.0, 1.0, 10.0, 0), ("b", 2.0, 3.0, 30.0, 0), ("c", 9.0, 1.0, 60.0, 1)]
    found = by(cluster_profiles(spark.createDataFrame(rows, CLUSTERED)), "cluster")
    assert found[0]["customer_count"] == 2 and found[0]["total_revenue"] == 40.0
    assert (found[0]["mean_monetary"], found[0]["median_frequency"]) == (20.0, 2.0)
    assert (found[0]["customer_share_pct"], found[1]["revenue_share_pct"]) == (66.7, 60.0)
    free = spark.createDataFrame([("a", 1.0, 1.0, 0.0, 0)], CLUSTERED)
    assert one(cluster_profiles(free))["revenue_share_pct"] == 0.0


@pytest.mark.parametrize("r, f, m, name", [
    (0.9, 0.8, 0.85, "Champions"), (0.45, 0.8, 0.7, "Loyal Customers"), (0.2, 0.8, 0.8, "At Risk"),
    (0.8, 0.2, 0.2, "New Customers"), (0.8, 0.2, 0.6, "Promising"), (0.1, 0.1, 0.1, "Lost / Dormant"),
])
def test_persona_rules(spark, r, f, m, name):
    row = spark.range(1).select(classify(F.lit(r), F.lit(f), F.lit(m)).alias("p")).first()
    assert row["p"] == name


def ten_clusters(spark):
    rows = [(f"{c}-{i}", 5.0 + 25 * c, max(1.0, 20.0 - 2 * c), max(10.0, 5000.0 - 450 * c), c)
            for c in range(10) for i in range(5)]
    return spark.createDataFrame(rows, CLUSTERED)


def test_names_are_unique(spark):
    names = [r["segment"] for r in persona_mapping(ten_clusters(spark)).collect()]
    assert len(set(names)) == 10 and any("(Tier 2)" in n for n in names)
    labeled, mapping = label_segments(ten_clusters(spark))
    assert labeled.count() == 50 and mapping.count() == 10


def test_one_cluster_is_everybody(spark):
    only = ten_clusters(spark).where("cluster = 3")
    assert one(persona_mapping(only))["segment"] == "All Customers"


def test_persona_details(spark):
    names = [("Champions",), ("Champions (Tier 2)",), ("All Customers",), (None,)]
    found = by(with_persona_details(spark.createDataFrame(names, "segment string")), "segment")
    assert found["Champions (Tier 2)"]["description"] == found["Champions"]["description"] + " (Champions (Tier 2))"
    assert found["Champions (Tier 2)"]["color"] == found["Champions"]["color"] == "#1f77b4"
    assert found["All Customers"]["color"] == "#7f7f7f"
    assert found["All Customers"]["action"].startswith("Tailor")

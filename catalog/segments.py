"""Clusters (K), personas (P), backtests (B) and saved models (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    CLUSTERS,
    EVENTS,
    GROSS,
    LABELED,
    LABELS,
    RFM,
    SCORED,
    TX,
    clustered,
    events,
    gross,
    labeled,
    mapping_cte,
    mean,
    persona_sql,
    r,
    rfm,
    rfm_cte,
    scored,
    scored_cte,
    scratch,
    sql,
)
from catalog.registry import query
from patronage.functions.text import round_to
from patronage.operators import backtest, clusters, personas, scoring
from patronage.operators.rfm import compute_rfm_quintiles
from patronage.plans.segmentation import segment_customers
from patronage.plans.validation import backtest_segments
from patronage.schema import RFM_FEATURES
from patronage.session import materialize

ZS = [clusters.z(f) for f in RFM_FEATURES]

# ---------------------------------------------------------------- clusters


def scaled_cte(source: str, name: str = "scaled", robust: bool = False) -> str:
    def scale(f: str) -> str:
        log = f"ln(1 + {f})"
        if robust:
            spread = f"(quantile_cont({log}, 0.75) OVER () - quantile_cont({log}, 0.25) OVER ())"
            return f"({log} - quantile_cont({log}, 0.5) OVER ()) / {spread} AS z_{f}"
        return f"({log} - avg({log}) OVER ()) / stddev_pop({log}) OVER () AS z_{f}"

    return f"{name} AS (SELECT *, {', '.join(scale(f) for f in RFM_FEATURES)} FROM {source})"


def rounded_z(digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in ZS)


@query("K1_standard_scaling", sql(*RFM, scaled_cte("rfm"), f"SELECT customer_id, {rounded_z()} FROM scaled"))
def k1(spark, d):
    scaled, _ = clusters.preprocess_rfm(materialize(rfm(spark, d)))
    return scaled.select("customer_id", *[round_to(F.col(c), 6).alias(c) for c in ZS])


@query(
    "K1_robust_scaling",
    sql(*RFM, scaled_cte("rfm", robust=True), f"SELECT customer_id, {rounded_z()} FROM scaled"),
)
def k1_robust(spark, d):
    scaled, _ = clusters.preprocess_rfm(materialize(rfm(spark, d)), scaler_type="robust")
    return scaled.select("customer_id", *[round_to(F.col(c), 6).alias(c) for c in ZS])


def scaled_clusters(spark, d):
    return clusters.preprocess_rfm(clustered(spark, d))[0]


def _distance(a: str, b: str) -> str:
    return " + ".join(f"pow({a}.{c} - {b}.{c}, 2)" for c in ZS)


def _square(alias: str = "") -> str:
    dot = f"{alias}." if alias else ""
    return " + ".join(f"pow({dot}{c}, 2)" for c in ZS)


# The silhouette from all pairs of customers, which the engine does without.
VALIDITY = f"""centers AS (SELECT cluster, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in ZS)}
  FROM scaled GROUP BY cluster),
overall AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in ZS)} FROM scaled),
own AS (SELECT s.cluster, {_distance('s', 'c')} AS d2 FROM scaled s JOIN centers c USING (cluster)),
within_ AS (SELECT sum(d2) AS w FROM own),
between_ AS (SELECT sum(n * ({_distance('c', 'o')})) AS b FROM centers c, overall o),
scatter AS (SELECT cluster, avg(sqrt(d2)) AS s FROM own GROUP BY cluster),
worst AS (SELECT a.cluster, max((x.s + y.s) / sqrt({_distance('a', 'b')})) AS m
  FROM centers a JOIN centers b ON a.cluster <> b.cluster JOIN scatter x ON x.cluster = a.cluster
  JOIN scatter y ON y.cluster = b.cluster GROUP BY a.cluster),
pairs AS (SELECT p.customer_id, p.cluster, q.cluster AS other, sum({_distance('p', 'q')}) AS total,
  count(*) AS n FROM scaled p, scaled q GROUP BY ALL),
sides AS (SELECT customer_id, min(total / n) FILTER (other <> cluster) AS outside,
  min(total / nullif(n - 1, 0)) FILTER (other = cluster) AS inside FROM pairs GROUP BY customer_id),
widths AS (SELECT coalesce((outside - inside) / greatest(outside, inside), 0) AS width FROM sides)"""

INDICES = f"""SELECT CAST((SELECT count(*) FROM centers) AS INTEGER) AS k, count(*) AS n,
  {r('(SELECT w FROM within_)', 2)} AS inertia, {r('(SELECT avg(width) FROM widths)', 4)} AS silhouette,
  {r("""(SELECT b FROM between_) / ((SELECT count(*) FROM centers) - 1)
    / ((SELECT w FROM within_) / (count(*) - (SELECT count(*) FROM centers)))""", 2)} AS calinski_harabasz,
  {r('(SELECT avg(m) FROM worst)', 4)} AS davies_bouldin FROM scaled"""


@query("K2bcd_validity", sql(*CLUSTERS, scaled_cte("clustered"), VALIDITY, INDICES))
def k2_validity(spark, d):
    return clusters.cluster_validity(materialize(scaled_clusters(spark, d)), ZS)


# Silhouette of Euclidean distances from all pairs of customers.
EUCLIDEAN = f"""pairs AS (SELECT p.customer_id, p.cluster, q.cluster AS other, sum(sqrt({_distance('p', 'q')})) AS total,
  count(*) AS n FROM scaled p, scaled q GROUP BY ALL),
sides AS (SELECT customer_id, min(total / n) FILTER (other <> cluster) AS outside,
  min(total / nullif(n - 1, 0)) FILTER (other = cluster) AS inside FROM pairs GROUP BY customer_id)"""


@query(
    "K2b_euclidean_silhouette",
    sql(
        *CLUSTERS, scaled_cte("clustered"), EUCLIDEAN,
        f"""SELECT CAST((SELECT count(DISTINCT cluster) FROM scaled) AS INTEGER) AS k, count(*) AS n,
        {r('avg(coalesce((outside - inside) / greatest(outside, inside), 0))', 4)} AS silhouette, true AS within_error
        FROM sides""",
    ),
)
def k2b(spark, d):
    """The silhouette of all references the tables allow, and one of 400 that must lie within its error of it."""
    scaled = materialize(scaled_clusters(spark, d))
    exact = clusters.euclidean_silhouette(scaled, ZS)
    few = clusters.euclidean_silhouette(scaled, ZS, references=400).first()
    gap = F.abs(F.col("silhouette") - few["silhouette"]) <= max(0.01, 6 * few["std_error"])
    return exact.select("k", "n", "silhouette", gap.alias("within_error"))


def checked_evaluation(spark, d):
    """All fits that evaluate_clusters makes by default, each held against what a good fit must show.

    ``total_square``: inertia and the between-cluster part of Calinski-Harabasz add up to all squares. ``centers_are_means``
    of the customers nearest to them. ``beats_scores``: as many groups made from quintile scores are no better.
    """
    scaled, _ = clusters.preprocess_rfm(materialize(scored(spark, d)))
    scaled = materialize(scaled)
    n = scaled.count()
    evaluation = materialize(clusters.evaluate_clusters(scaled))
    checks = []
    for row in evaluation.collect():
        k, centers = row["k"], row["centers"]
        away, nearest = clusters.nearest_center_sql(centers, ZS)
        near = scaled.withColumn("_away", F.expr(away)).withColumn("cluster", F.expr(nearest))
        means = {r["cluster"]: r for r in clusters.cluster_centers(near, ZS).collect()}
        gap = max(abs(means[i][c] - v) for i, center in enumerate(centers) for c, v in zip(ZS, center))
        # k groups: spend scores, the upper ones split by recency beyond five.
        upper = F.expr(f"if(m_score > {10 - k} and r_score >= 3, 5, 0)")
        group = F.least("m_score", F.lit(k)) - 1 + (upper if k > 5 else F.lit(0))
        by_score = clusters.cluster_centers(scaled.withColumn("cluster", group), ZS).collect()
        square = sum(r["n"] * sum(r[c] ** 2 for c in ZS) for r in by_score)
        total = scaled.agg(F.sum(sum((F.col(c) ** 2 for c in ZS), F.lit(0.0)))).first()[0]
        between = row["inertia"] * row["calinski_harabasz"] * (k - 1) / (n - k)
        checks.append((k, round(row["inertia"] + between), gap < 0.01, row["inertia"] <= total - square))
    table = spark.createDataFrame(checks, "k int, total_square bigint, centers_are_means boolean, beats_scores boolean")
    return evaluation.join(F.broadcast(table), "k")  # seven rows


TOTAL_SQUARE = f"(SELECT CAST(round(sum({_square()})) AS BIGINT) FROM scaled) AS total_square"


@query(
    "K2a_evaluate_k",
    sql(
        *RFM, scaled_cte("rfm"),
        f"""SELECT CAST(k AS INTEGER) AS k, {TOTAL_SQUARE}, false AS low_variance, true AS separated,
        true AS centers_are_means, true AS beats_scores FROM range(2, 9) AS t(k)""",
    ),
)
def k2a(spark, d):
    """Each fitted k, see ``checked_evaluation``."""
    separated = (F.col("silhouette") > 0) & (F.col("silhouette_squared") > F.col("silhouette"))
    return checked_evaluation(spark, d).select(
        "k", "total_square", "low_variance", separated.alias("separated"), "centers_are_means", "beats_scores"
    )


def score_evaluation_cte() -> str:
    """Indices of two to five clusters made by merging the best spend scores."""
    parts = [
        f"""(WITH scaled AS (SELECT * EXCLUDE (cluster), least(m_score, {k}) - 1 AS cluster FROM all_scaled),
        {VALIDITY} {INDICES})"""
        for k in range(2, 6)
    ]
    return f"{scaled_cte('clustered', 'all_scaled')}, evaluation AS ({' UNION ALL '.join(parts)})"


def score_evaluation(spark, d):
    scaled = materialize(scaled_clusters(spark, d))
    parts = [
        clusters.cluster_validity(scaled.withColumn("cluster", F.least("m_score", F.lit(k)) - 1), ZS)
        for k in range(2, 6)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "K2e_best_k",
    sql(
        *CLUSTERS, score_evaluation_cte(),
        """SELECT (SELECT k FROM evaluation ORDER BY silhouette DESC, k LIMIT 1) AS best_k,
        (SELECT max(silhouette) FROM evaluation) AS best_silhouette,
        (SELECT k FROM evaluation ORDER BY calinski_harabasz DESC, k LIMIT 1) AS best_k_calinski,
        (SELECT k FROM evaluation ORDER BY davies_bouldin, k LIMIT 1) AS best_k_davies""",
    ),
)
def k2e(spark, d):
    return clusters.best_k(score_evaluation(spark, d))


@query(
    "K2e_best_k_fitted",
    sql(
        *RFM, scaled_cte("rfm"),
        f"""SELECT criterion, {TOTAL_SQUARE}, true AS is_best, true AS centers_are_means, true AS beats_scores
        FROM (VALUES ('silhouette'), ('calinski_harabasz'), ('davies_bouldin')) AS t(criterion)""",
    ),
)
def k2e_fitted(spark, d):
    """The best k of fitted clusters by each criterion: no other k is better, nor as good and smaller."""
    evaluation = materialize(checked_evaluation(spark, d))
    best = clusters.best_k(evaluation).first()
    rows = {row["k"]: row for row in evaluation.collect()}
    found = []
    for criterion, column, sign in (
        ("silhouette", "best_k", -1), ("calinski_harabasz", "best_k_calinski", -1), ("davies_bouldin", "best_k_davies", 1)
    ):
        first = min(rows, key=lambda k: (sign * rows[k][criterion], k))
        is_best = best[column] == first and best["best_silhouette"] == max(row["silhouette"] for row in rows.values())
        chosen = rows[best[column]]
        found.append((criterion, chosen["total_square"], is_best, chosen["centers_are_means"], chosen["beats_scores"]))
    return spark.createDataFrame(
        found,
        "criterion string, total_square bigint, is_best boolean, centers_are_means boolean, beats_scores boolean",
    )


# Fixed centroids in scaled space, so that both engines measure the same distances.
CENTROIDS = [[1.2, -1.0, -1.1], [0.1, 0.0, 0.2], [-0.9, 0.9, 0.8], [-1.5, 1.8, 2.0]]


def nearest_cte(source: str, name: str, centers: list[list[float]] = CENTROIDS) -> str:
    """``source`` without its scaled columns, with the number of the nearest centre."""
    squares = [" + ".join(f"pow({c} - ({v}), 2)" for c, v in zip(ZS, center)) for center in centers]
    return f"""{name} AS (SELECT * EXCLUDE ({', '.join(ZS)}, away),
      CAST(list_position(away, list_min(away)) - 1 AS INTEGER) AS cluster
      FROM (SELECT *, [{', '.join(squares)}] AS away FROM {source}))"""


NEAREST = [*RFM, scaled_cte("rfm"), nearest_cte("scaled", "clustered")]


@query(
    "K3_kmeans_quality",
    sql(
        *RFM, scaled_cte("rfm"),
        f"""SELECT count(*) AS n, CAST(round(sum({_square()})) AS BIGINT) AS total_square, true AS labels_are_nearest,
        true AS centers_are_means, true AS beats_spend_scores FROM scaled""",
    ),
)
def k3(spark, d):
    """A fit with all its starts, held against what any good fit must show."""
    scaled, _ = clusters.preprocess_rfm(materialize(scored(spark, d)))
    scaled = materialize(scaled)
    labeled_rows, model = clusters.run_kmeans(scaled, 4)
    centers = [[float(v) for v in c] for c in model.clusterCenters()]
    away, nearest = clusters.nearest_center_sql(centers, ZS)
    wrong = labeled_rows.withColumn("_away", F.expr(away)).where(f"cluster <> {nearest}").count()
    means = {row["cluster"]: row for row in clusters.cluster_centers(labeled_rows, ZS).collect()}
    gap = max(abs(means[i][c] - v) for i, center in enumerate(centers) for c, v in zip(ZS, center))
    by_score = clusters.cluster_validity(scaled.withColumn("cluster", F.least("m_score", F.lit(4)) - 1), ZS).first()
    found = clusters.cluster_validity(labeled_rows, ZS).first()
    between = found["inertia"] * found["calinski_harabasz"] * 3 / (found["n"] - 4)
    return spark.createDataFrame(
        [(found["n"], round(found["inertia"] + between), wrong == 0, gap < 0.05, found["inertia"] <= by_score["inertia"])],
        "n bigint, total_square bigint, labels_are_nearest boolean, centers_are_means boolean, "
        "beats_spend_scores boolean",
    )


@query(
    "K3_resampling_stability",
    sql(
        *RFM,
        "SELECT CAST(seed AS INTEGER) AS seed, (SELECT count(*) FROM rfm) AS customers, true AS stable FROM range(1, 6) AS t(seed)",
    ),
)
def k3_stability(spark, d):
    """Three clusters of all customers against those of five draws of 90 %: the mean adjusted Rand index is 0.80 or more."""
    table = materialize(rfm(spark, d))
    base = clusters.run_kmeans(clusters.preprocess_rfm(table)[0], 3)[0].select("customer_id", "cluster")
    base = materialize(base)
    scores = []
    for seed in range(1, 6):
        drawn = table.where(F.pmod(F.xxhash64("customer_id", F.lit(seed)), F.lit(10)) > 0)
        other = clusters.run_kmeans(clusters.preprocess_rfm(drawn)[0], 3)[0]
        scores.append(clusters.adjusted_rand(base, other, "customer_id"))
    stable = sum(scores) / len(scores) >= 0.8
    return spark.createDataFrame(
        [(seed, table.count(), stable) for seed in range(1, 6)], "seed int, customers bigint, stable boolean"
    )


@query("K4_labeled_customers", sql(*NEAREST, "SELECT customer_id, cluster FROM clustered"))
def k4(spark, d):
    """Labels by given centres; K3 holds the fitted ones to the same rule."""
    scaled, _ = clusters.preprocess_rfm(materialize(rfm(spark, d)))
    away, nearest = clusters.nearest_center_sql(CENTROIDS, ZS)
    return scaled.withColumn("_away", F.expr(away)).select("customer_id", F.expr(nearest).alias("cluster"))


@query(
    "K5_cluster_profiles",
    sql(
        *CLUSTERS,
        f"""SELECT cluster, count(*) AS customer_count, {r('sum(monetary)', 2)} AS total_revenue, """
        + ", ".join(
            f"{r(mean(f), 2)} AS mean_{f}, {r(f'quantile_cont(CAST({f} AS DOUBLE), 0.5)', 2)} AS median_{f}"
            for f in RFM_FEATURES
        )
        + f""", {r('count(*) / sum(count(*)) OVER () * 100', 1)} AS customer_share_pct,
        {r('sum(monetary) / sum(sum(monetary)) OVER () * 100', 1)} AS revenue_share_pct
        FROM clustered GROUP BY cluster""",
    ),
)
def k5(spark, d):
    return clusters.cluster_profiles(clustered(spark, d))


HEALTH = """centers AS (SELECT cluster, avg(z_recency) AS zr, avg(z_frequency) AS zf, avg(z_monetary) AS zm
  FROM scaled GROUP BY cluster),
health AS (SELECT cluster, row_number() OVER (ORDER BY -zr + zf + zm) - 1 AS aligned FROM centers)"""


@query(
    "K6_align_by_health",
    sql(
        *SCORED, "clustered AS (SELECT *, (m_score * 3) % 5 AS cluster FROM scored)",
        scaled_cte("clustered"), HEALTH,
        """SELECT customer_id, CAST(aligned AS INTEGER) AS cluster FROM scaled JOIN health USING (cluster)""",
    ),
)
def k6_health(spark, d):
    shuffled = clustered(spark, d).withColumn("cluster", (F.col("m_score") * 3) % 5)
    scaled, _ = clusters.preprocess_rfm(shuffled)
    centers = clusters.cluster_centers(scaled, ZS).orderBy("cluster").collect()
    _, mapping = clusters.align_centroids([[row[c] for c in ZS] for row in centers])
    return clusters.relabel_clusters(scaled, mapping).select("customer_id", "cluster")


@query(
    "K6_align_to_anchors",
    sql(*CLUSTERS, "SELECT customer_id, cluster FROM clustered"),
)
def k6_anchors(spark, d):
    """Cluster numbers shuffled and brought back by pairing with the centroids before."""
    table = materialize(scaled_clusters(spark, d))
    anchors = clusters.cluster_centers(table, ZS).orderBy("cluster").collect()
    renamed = table.withColumn("cluster", (F.col("cluster") * 2 + 3) % 5)
    fresh = clusters.cluster_centers(renamed, ZS).orderBy("cluster").collect()
    _, mapping = clusters.align_centroids(
        [[row[c] for c in ZS] for row in fresh], [[row[c] for c in ZS] for row in anchors]
    )
    return clusters.relabel_clusters(renamed, mapping).select("customer_id", "cluster")


TWELVE = "((r_score - 1) * 5 + m_score - 1) % 12"


@query(
    "K6_align_twelve",
    sql(*SCORED, f"SELECT customer_id, CAST({TWELVE} AS INTEGER) AS cluster FROM scored"),
)
def k6_twelve(spark, d):
    """More clusters than could be paired by trying all orders."""
    table = materialize(clusters.preprocess_rfm(scored(spark, d).withColumn("cluster", F.expr(TWELVE)))[0])
    anchors = clusters.cluster_centers(table, ZS).orderBy("cluster").collect()
    renamed = table.withColumn("cluster", (F.col("cluster") * 5 + 3) % 12)
    fresh = clusters.cluster_centers(renamed, ZS).orderBy("cluster").collect()
    _, mapping = clusters.align_centroids(
        [[row[c] for c in ZS] for row in fresh], [[row[c] for c in ZS] for row in anchors]
    )
    return clusters.relabel_clusters(renamed, mapping).select("customer_id", "cluster")


@query(
    "K7_whales",
    sql(
        *RFM,
        """SELECT *, frequency > (SELECT quantile_cont(CAST(frequency AS DOUBLE), 0.98) FROM rfm)
        OR monetary > (SELECT quantile_cont(monetary, 0.98) FROM rfm) AS is_whale FROM rfm""",
    ),
)
def k7(spark, d):
    return clusters.mark_whales(materialize(rfm(spark, d)), 0.98)


def _to_centroid(c: list[float]) -> str:
    return "sqrt(" + " + ".join(f"pow({z} - ({v}), 2)" for z, v in zip(ZS, c)) + ")"


@query(
    "K8_boundary_confidence",
    sql(
        *RFM, scaled_cte("rfm"),
        f"distances AS (SELECT customer_id, list_sort([{', '.join(map(_to_centroid, CENTROIDS))}]) AS d FROM scaled)",
        f"""SELECT customer_id, {r('least(greatest(1 - d[1] / greatest(d[2], 1e-6), 0), 1)', 6)} AS confidence
        FROM distances""",
    ),
)
def k8(spark, d):
    scaled, _ = clusters.preprocess_rfm(materialize(rfm(spark, d)))
    confident = clusters.boundary_confidence(scaled, CENTROIDS, ZS)
    return confident.select("customer_id", round_to(F.col("confidence"), 6).alias("confidence"))


def given_model(table, centers=CENTROIDS):
    """Model of given centres on the metrics' own scale, and the customers it labels."""
    scaler = clusters.fit_scaler(table, guard=False)
    model = clusters.segment_model(scaler, centers, clusters.inertia_of(scaler.transform(table), centers, ZS))
    return model, model.transform(table).drop(*ZS)


@query("K9_given_model_labels", sql(*NEAREST, "SELECT * FROM clustered"))
def k9(spark, d):
    return given_model(materialize(rfm(spark, d)))[1]


@query(
    "K9_fit_rfm_pipeline",
    sql(
        *RFM, scaled_cte("rfm"),
        f"""SELECT count(*) AS n, {TOTAL_SQUARE}, CAST(4 AS INTEGER) AS k, true AS inertia_is_that_of_labels,
        true AS labels_are_nearest, true AS beats_spend_scores FROM scaled""",
    ),
)
def k9_fit(spark, d):
    """A model fitted from raw metrics to labels, held against what its labels must show."""
    table = materialize(scored(spark, d))
    model, labels = clusters.fit_rfm_pipeline(table, 4)
    scaled = materialize(clusters.fit_scaler(table, guard=False).transform(labels))
    found = clusters.cluster_validity(scaled, ZS).first()
    between = found["inertia"] * found["calinski_harabasz"] * (found["k"] - 1) / (found["n"] - found["k"])
    means = [[row[c] for c in ZS] for row in clusters.cluster_centers(scaled, ZS).orderBy("cluster").collect()]
    away, nearest = clusters.nearest_center_sql(means, ZS)
    wrong = scaled.withColumn("_away", F.expr(away)).where(f"cluster <> {nearest}").count()
    by_score = clusters.cluster_validity(scaled.withColumn("cluster", F.least("m_score", F.lit(4)) - 1), ZS).first()
    return spark.createDataFrame(
        [(found["n"], round(found["inertia"] + between), found["k"],
          abs(found["inertia"] - model.inertia) <= 0.001 * found["inertia"], wrong <= 0.001 * found["n"],
          found["inertia"] <= by_score["inertia"])],
        "n bigint, total_square bigint, k int, inertia_is_that_of_labels boolean, labels_are_nearest boolean, "
        "beats_spend_scores boolean",
    )


# ---------------------------------------------------------------- personas

NORM_COLUMNS = ", ".join(f"{r(c, 6)} AS {c}" for c in ["r_norm", "f_norm", "m_norm", "composite"])


@query(
    "P1_cluster_scores",
    sql(*CLUSTERS, mapping_cte(), f"SELECT cluster, {NORM_COLUMNS}, clusters FROM mapping_base"),
)
def p1(spark, d):
    scores = personas.cluster_scores(clustered(spark, d))
    names = ["r_norm", "f_norm", "m_norm", "composite"]
    return scores.select("cluster", *[round_to(F.col(c), 6).alias(c) for c in names], "clusters")


RANKS = """ranks AS (SELECT customer_id, (r_score - 1) / 4 AS rr, (f_score - 1) / 4 AS fr,
  (m_score - 1) / 4 AS mr FROM scored)"""


@query(
    "P2_persona_rules",
    sql(*SCORED, RANKS, f"SELECT customer_id, {persona_sql('rr', 'fr', 'mr')} AS persona FROM ranks"),
)
def p2(spark, d):
    ranks = [(F.col(f"{s}_score") - 1) / 4 for s in "rfm"]
    return scored(spark, d).select("customer_id", personas.classify(*ranks).alias("persona"))


@query("P3_tiers", sql(*CLUSTERS, mapping_cte(), "SELECT * FROM mapping"))
def p3(spark, d):
    return personas.persona_mapping(clustered(spark, d))


# Twenty-five clusters by recency and frequency score: many share a persona.
FINE = "clustered AS (SELECT *, (r_score - 1) * 5 + f_score - 1 AS cluster FROM scored)"


@query("P3_many_tiers", sql(*SCORED, FINE, mapping_cte(), "SELECT * FROM mapping"))
def p3_many(spark, d):
    fine = scored(spark, d).withColumn("cluster", F.expr("(r_score - 1) * 5 + f_score - 1"))
    return personas.persona_mapping(fine)


@query("P4_labeled", sql(*LABELS, "SELECT * FROM labeled"))
def p4(spark, d):
    return labeled(spark, d)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


PERSONA_VALUES = ", ".join(f"({', '.join(map(_text, row))})" for row in personas.PERSONAS)
PERSONA_TABLE = f"personas AS (SELECT * FROM (VALUES {PERSONA_VALUES}) AS t(base, description, action, color))"
DETAILS = f"""detailed AS (SELECT x.*,
  CASE WHEN x.segment LIKE '%Tier%' THEN coalesce(p.description, {_text(personas.DEFAULT_DESCRIPTION)})
    || ' (' || x.segment || ')' ELSE coalesce(p.description, {_text(personas.DEFAULT_DESCRIPTION)}) END
    AS description,
  coalesce(p.action, {_text(personas.DEFAULT_ACTION)}) AS action,
  coalesce(p.color, '{personas.DEFAULT_COLOR}') AS color
  FROM {{source}} x LEFT JOIN personas p ON regexp_replace(x.segment, '\\s*\\(Tier \\d+\\)$', '') = p.base)"""


@query(
    "P5_persona_details",
    sql(
        *SCORED, FINE, mapping_cte(), PERSONA_TABLE, DETAILS.format(source="mapping"),
        "SELECT * FROM detailed",
    ),
)
def p5(spark, d):
    return personas.with_persona_details(p3_many(spark, d))


# ---------------------------------------------------------------- backtest

CUTOFF = "1999-06-30"
WINDOWS = [
    TX, GROSS,
    f"t1 AS (SELECT * FROM gross WHERE invoice_date <= TIMESTAMP '{CUTOFF}')",
    f"t2 AS (SELECT * FROM gross WHERE invoice_date > TIMESTAMP '{CUTOFF}')",
]
WINDOW_RFM = [
    *WINDOWS, rfm_cte("t1", "rfm1", snapshot=f"TIMESTAMP '{CUTOFF}'"), rfm_cte("t2", "rfm2"),
]


def window_labels() -> list[str]:
    """Both windows by spend score, named by the personas of the first."""
    return [
        *WINDOW_RFM, scored_cte("rfm1", "scored1"), scored_cte("rfm2", "scored2"),
        "c1 AS (SELECT *, m_score - 1 AS cluster FROM scored1)",
        "c2 AS (SELECT *, m_score - 1 AS cluster FROM scored2)",
        mapping_cte("c1"),
        "l1 AS (SELECT c1.*, segment FROM c1 JOIN mapping USING (cluster))",
        "l2 AS (SELECT c2.*, segment FROM c2 JOIN mapping USING (cluster))",
    ]


def windows(spark, d):
    one, two = (compute_rfm_quintiles(t) for t in backtest.windowed_rfm(gross(spark, d), CUTOFF))
    t1, mapping = personas.label_segments(one.withColumn("cluster", F.col("m_score") - 1))
    t2 = two.withColumn("cluster", F.col("m_score") - 1).join(mapping, "cluster")
    return t1, t2.select(t1.columns)


@query(
    "B1_window_split",
    sql(
        *WINDOWS,
        """SELECT 't1' AS part, count(*) AS n, max(invoice_date) AS last FROM t1 UNION ALL
        SELECT 't2', count(*), max(invoice_date) FROM t2""",
    ),
)
def b1(spark, d):
    parts = zip(["t1", "t2"], backtest.split_windows(gross(spark, d), CUTOFF))
    one, two = (
        part.agg(F.count(F.lit(1)).alias("n"), F.max("invoice_date").alias("last")).withColumn(
            "part", F.lit(name)
        )
        for name, part in parts
    )
    return one.unionByName(two)


@query(
    "B1_intraday_split",
    sql(
        EVENTS,
        """SELECT customer_id, count(*) AS n FROM ev WHERE invoice_date <= TIMESTAMP '2024-01-15' GROUP BY 1""",
    ),
)
def b1_intraday(spark, d):
    before, _ = backtest.split_windows(events(spark, d), "2024-01-15")
    return before.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "B2_windowed_rfm",
    sql(
        *WINDOW_RFM, "SELECT 't1' AS part, * FROM rfm1 UNION ALL SELECT 't2' AS part, * FROM rfm2"
    ),
)
def b2(spark, d):
    one, two = backtest.windowed_rfm(gross(spark, d), CUTOFF)
    return one.withColumn("part", F.lit("t1")).unionByName(two.withColumn("part", F.lit("t2")))


TRANSITIONS = """moves AS (SELECT l1.segment AS s1, coalesce(l2.segment, 'Churned (Inactive)') AS s2, count(*) AS n
  FROM l1 LEFT JOIN l2 USING (customer_id) GROUP BY ALL),
targets AS (SELECT DISTINCT segment AS s2 FROM l2 UNION SELECT 'Churned (Inactive)'),
cells AS (SELECT a.s1 AS segment_t1, t.s2 AS segment_t2, coalesce(m.n, 0) AS n FROM
  (SELECT DISTINCT segment AS s1 FROM l1) a CROSS JOIN targets t
  LEFT JOIN moves m ON m.s1 = a.s1 AND m.s2 = t.s2),
transitions AS (SELECT *, n / sum(n) OVER (PARTITION BY segment_t1) AS prob FROM cells)"""


@query(
    "B3_transition_counts",
    sql(*window_labels(), TRANSITIONS, "SELECT segment_t1, segment_t2, n FROM transitions"),
)
def b3(spark, d):
    return backtest.transition_matrix(*windows(spark, d)).drop("prob")


@query("B4_transition_probabilities", sql(*window_labels(), TRANSITIONS, "SELECT * FROM transitions"))
def b4(spark, d):
    return backtest.transition_matrix(*windows(spark, d))


@query(
    "B5_retention",
    sql(
        *window_labels(),
        "joined AS (SELECT l1.customer_id AS a, l2.customer_id AS b FROM l1 FULL JOIN l2 USING (customer_id))",
        f"""SELECT count(a) AS total_t1_customers, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS retained_count,
        count(*) FILTER (b IS NULL) AS churned_count, count(*) FILTER (a IS NULL) AS new_customers_count,
        {r('count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(a)', 4)} AS retention_rate,
        {r('count(*) FILTER (b IS NULL) / count(a)', 4)} AS churn_rate FROM joined""",
    ),
)
def b5(spark, d):
    return backtest.retention_summary(*windows(spark, d))


FORWARD = f"""SELECT segment, count(*) AS customer_count, count(b.customer_id) AS forward_active_count,
        {r('coalesce(sum(b.monetary), 0)', 2)} AS total_forward_spend,
        {r('coalesce(sum(CAST(b.monetary AS DECIMAL(18, 2))), 0) / count(*)', 2)} AS avg_forward_spend,
        {r('avg(coalesce(b.frequency, 0))', 2)} AS avg_forward_orders,
        {r('count(b.customer_id) / count(*) * 100', 2)} AS forward_retention_pct,
        coalesce({r('sum(CAST(b.monetary AS DECIMAL(18, 2))) / nullif(count(b.customer_id), 0)', 2)}, 0)
          AS avg_spend_active_buyers
        FROM l1 LEFT JOIN rfm2 b ON b.customer_id = l1.customer_id GROUP BY segment"""


@query("B6_forward_value", sql(*window_labels(), FORWARD))
def b6(spark, d):
    t1, t2 = windows(spark, d)
    return backtest.forward_value(t1, t2)


MIGRATION = """migration AS (SELECT l1.customer_id, l1.segment AS t1_segment, l1.monetary AS t1_spend,
  coalesce(l2.segment, 'Churned (Inactive)') AS t2_segment, coalesce(l2.monetary, 0) AS t2_spend,
  CASE WHEN l2.segment IS NULL THEN 'Churned' WHEN l1.segment = l2.segment THEN 'Retained (Stable)'
    ELSE 'Migrated' END AS migration_status FROM l1 LEFT JOIN l2 USING (customer_id))"""


@query("B7_migration", sql(*window_labels(), MIGRATION, "SELECT * FROM migration"))
def b7(spark, d):
    return backtest.migration_details(*windows(spark, d))


def _scaled_like(source: str, model: str, name: str) -> str:
    """``source`` scaled by the centre and spread of ``model``."""
    stats = ", ".join(f"avg(ln(1 + {f})) AS c_{f}, stddev_pop(ln(1 + {f})) AS s_{f}" for f in RFM_FEATURES)
    scaled = ", ".join(f"(ln(1 + {f}) - c_{f}) / s_{f} AS z_{f}" for f in RFM_FEATURES)
    return f"""{name}_stats AS (SELECT {stats} FROM {model}),
    {name} AS (SELECT x.*, {scaled} FROM {source} x, {name}_stats)"""


PROJECTED = [
    *WINDOW_RFM, scaled_cte("rfm1", "scaled1"), nearest_cte("scaled1", "c1"),
    _scaled_like("rfm2", "rfm1", "scaled2"), nearest_cte("scaled2", "c2"), mapping_cte("c1"),
    "l1 AS (SELECT c1.*, segment FROM c1 JOIN mapping USING (cluster))",
    "l2 AS (SELECT c2.*, coalesce(segment, 'Other') AS segment FROM c2 LEFT JOIN mapping USING (cluster))",
]


@query("B8_backtest_retention", sql(*PROJECTED, FORWARD))
def b8(spark, d):
    return backtest_segments(gross(spark, d), CUTOFF, centers=CENTROIDS).forward


@query("B9_projected_segments", sql(*PROJECTED, "SELECT * FROM l2"))
def b9(spark, d):
    return backtest_segments(gross(spark, d), CUTOFF, centers=CENTROIDS).t2


@query(
    "B8_fitted_backtest",
    sql(
        *WINDOW_RFM, scaled_cte("rfm1"),
        f"""SELECT (SELECT count(*) FROM rfm1) AS t1_customers, (SELECT count(*) FROM rfm2) AS t2_customers,
        (SELECT count(*) FROM rfm1 JOIN rfm2 USING (customer_id)) AS retained, {TOTAL_SQUARE},
        true AS labels_are_nearest, true AS centers_are_means, true AS t2_uses_t1_model, true AS rows_add_up""",
    ),
)
def b8_fitted(spark, d):
    """The backtest with its own fit on the first window: centres, labels of both windows by them, and row totals."""
    result = backtest_segments(gross(spark, d), CUTOFF)
    columns = [F.col(c) for c in ZS]
    scaler = clusters.fit_scaler(result.t1)
    t1, t2 = (materialize(scaler.transform(table)) for table in (result.t1, result.t2))
    centers = result.centers
    away, nearest = clusters.nearest_center_sql(centers, ZS)

    def wrong(table):
        return table.withColumn("_away", F.expr(away)).where(f"cluster <> {nearest}").count()

    means = {row["cluster"]: row for row in clusters.cluster_centers(t1, ZS).collect()}
    gap = max(abs(means[i][c] - v) for i, center in enumerate(centers) for c, v in zip(ZS, center))
    n1, n2 = t1.count(), t2.count()
    retention = result.retention.first()
    moved = result.transitions.agg(F.sum("n").alias("n")).first()["n"]
    forward = result.forward.agg(F.sum("customer_count").alias("n")).first()["n"]
    square = t1.agg(F.sum(sum((c**2 for c in columns), F.lit(0.0)))).first()[0]
    return spark.createDataFrame(
        [(n1, n2, retention["retained_count"], round(square), wrong(t1) == 0, gap < 0.01, wrong(t2) == 0,
          moved == n1 and forward == n1 and result.migration.count() == n1)],
        "t1_customers bigint, t2_customers bigint, retained bigint, total_square bigint, labels_are_nearest boolean, "
        "centers_are_means boolean, t2_uses_t1_model boolean, rows_add_up boolean",
    )


@query(
    "B10_default_cutoff",
    sql(
        EVENTS,
        "bounds AS (SELECT CAST(min(invoice_date) AS DATE) AS min_date, CAST(max(invoice_date) AS DATE) AS max_date FROM ev)",
        """SELECT *, CAST(max_date - min_date AS INTEGER) AS total_days, max_date - min_date >= 7 AS long_enough,
        min_date + CAST((max_date - min_date) // 2 AS INTEGER) AS cutoff_date FROM bounds""",
    ),
)
def b10(spark, d):
    return backtest.default_cutoff(events(spark, d))


@query(
    "B11_migration_filter",
    sql(
        *window_labels(), MIGRATION,
        "SELECT * FROM migration WHERE t1_segment = 'Champions' AND migration_status = 'Migrated'",
    ),
)
def b11(spark, d):
    details = backtest.migration_details(*windows(spark, d))
    return backtest.filter_migration(details, "Champions", "Migrated")


# ---------------------------------------------------------------- saved models


@query("M1_batch_scoring", sql(*NEAREST, mapping_cte(), LABELED, "SELECT * FROM labeled"))
def m1(spark, d):
    table = materialize(rfm(spark, d))
    model, rows = given_model(table)
    return scoring.score_customers(model, personas.persona_mapping(rows), table)


def two_versions(spark, d) -> str:
    """Versions of three and of four centres."""
    folder, table = scratch(spark, "models"), materialize(rfm(spark, d))
    for k in (3, 4):
        model, rows = given_model(table, CENTROIDS[:k])
        mapping = personas.persona_mapping(rows)
        scoring.save_model_version(
            model, mapping, folder, customer_count=table.count(), notes=f"k={k}"
        )
    return folder


def version_ctes() -> list[str]:
    parts = [*RFM, scaled_cte("rfm")]
    for k in (3, 4):
        parts += [nearest_cte("scaled", f"c{k}", CENTROIDS[:k]), mapping_cte(f"c{k}", f"m{k}")]
    return parts


def _inertia(k: int) -> str:
    squares = [" + ".join(f"pow({c} - ({v}), 2)" for c, v in zip(ZS, center)) for center in CENTROIDS[:k]]
    return r(f"(SELECT sum(list_min([{', '.join(squares)}])) FROM scaled)", 1)


def version_name():
    return F.regexp_extract("version_id", r"^(v\d+_k\d+)_\d{8}_\d{6}$", 1).alias("version")


@query(
    "M2_saved_versions",
    sql(*version_ctes(), "SELECT 'v1_k3' AS version, * FROM m3 UNION ALL SELECT 'v2_k4', * FROM m4"),
)
def m2(spark, d):
    versions = scoring.list_model_versions(spark, two_versions(spark, d))
    named = versions.select(version_name(), F.explode("cluster_map").alias("cluster", "segment"))
    return named.withColumn("cluster", F.col("cluster").cast("int"))


@query(
    "S9_version_catalog",
    sql(
        *version_ctes(),
        " UNION ALL ".join(
            f"""SELECT 'v{k - 2}_k{k}' AS version, {k} AS k, {_inertia(k)} AS inertia, count(*) AS customer_count,
            'k={k}' AS notes, '{','.join(RFM_FEATURES)}' AS features FROM rfm"""
            for k in (3, 4)
        ),
    ),
)
def s9(spark, d):
    versions = scoring.list_model_versions(spark, two_versions(spark, d))
    return versions.select(
        version_name(), "k", round_to(F.col("inertia"), 1).alias("inertia"), "customer_count", "notes",
        F.array_join("feature_names", ",").alias("features"),
    )


@query("M3_reloaded_model", sql(*NEAREST, mapping_cte(), LABELED, "SELECT * FROM labeled"))
def m3(spark, d):
    folder, table = scratch(spark, "models"), materialize(rfm(spark, d))
    model, rows = given_model(table)
    version = scoring.save_model_version(model, personas.persona_mapping(rows), folder)
    loaded, names, _ = scoring.load_model_version(spark, folder, version)
    return scoring.score_customers(loaded, names, table)


@query(
    "M4_compare_versions",
    sql(
        *version_ctes(),
        f"""SELECT 3 AS k_a, 4 AS k_b, 1 AS k_delta, {_inertia(3)} AS inertia_a, {_inertia(4)} AS inertia_b,
        0.0 AS silhouette_a, 0.0 AS silhouette_b, 0.0 AS silhouette_delta""",
    ),
)
def m4(spark, d):
    versions = scoring.list_model_versions(spark, two_versions(spark, d))
    newest, oldest = [row["version_id"] for row in versions.select("version_id").collect()]
    found = scoring.compare_versions(versions, oldest, newest).drop("inertia_delta")
    rounded = {c: round_to(F.col(c), 1) for c in ("inertia_a", "inertia_b")}
    return found.withColumns(rounded)


@query("segmentation_run")
def whole(spark, d):
    """Raw lines to labeled and scored customers in one call."""
    from catalog.inputs import raw_lines

    return segment_customers(raw_lines(spark, d)).labeled

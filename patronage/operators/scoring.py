"""Scoring with a fitted model, and a catalog of saved model versions."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.operators.clusters import SegmentModel
from patronage.schema import RFM_FEATURES
from patronage.session import small_lookup

UNCLASSIFIED = "Unclassified"
#: Folder next to the versions whose files say which numbers are taken.
CLAIMS = "_claims"
VERSION_SCHEMA = (
    "version_id string, created_at string, k int, inertia double, silhouette_score double, "
    "feature_names array<string>, customer_count bigint, cluster_map map<string,string>, "
    "eval_metrics array<struct<k:int,inertia:double,silhouette:double,"
    "calinski_harabasz:double,davies_bouldin:double>>, notes string"
)


def score_customers(
    model: SegmentModel,
    mapping: DataFrame,
    rfm: DataFrame,
    features: list[str] = RFM_FEATURES,
    unknown: str = UNCLASSIFIED,
) -> DataFrame:
    """Add ``cluster`` and ``segment`` from raw metrics; map-only apart from the tiny mapping."""
    for feature in features:
        if feature not in rfm.columns:
            raise ValueError(f"Scoring needs the column '{feature}'.")
    scored = model.transform(rfm).select(*rfm.columns, "cluster")
    named = scored.join(small_lookup(mapping.select("cluster", "segment")), "cluster", "left")
    return named.select(
        *rfm.columns, "cluster", F.coalesce("segment", F.lit(unknown)).alias("segment")
    )


def _entries(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Version names whose folder matches ``pattern``, on whatever file system ``folder`` is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    depth = pattern.count("/")
    names = []
    for status in found or []:
        entry = status.getPath()
        for _ in range(depth):
            entry = entry.getParent()
        names.append(entry.getName())
    return names


def _claim_number(spark: SparkSession, folder: str) -> int:
    """The next version number, claimed by creating a file that was not there: of savers at one time each gets another.

    Numbers of versions without a claim, from before, count as taken."""
    found = [re.match(r"v(\d+)(_|$)", name) for name in [*_entries(spark, folder, "*"), *_entries(spark, folder, f"{CLAIMS}/*")]]
    number = 1 + max([int(m.group(1)) for m in found if m], default=0)
    jvm = spark.sparkContext._jvm
    claims = jvm.org.apache.hadoop.fs.Path(f"{folder}/{CLAIMS}")
    system = claims.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(claims)
    local = system.getScheme() == "file"
    while True:
        path = jvm.org.apache.hadoop.fs.Path(claims, f"v{number}")
        try:
            if local:
                # Hadoop's local file system looks and then creates; this does both at once.
                open(path.toUri().getPath(), "xb").close()
            else:
                system.create(path, False).close()
            return number
        except (FileExistsError, Py4JJavaError) as error:
            if isinstance(error, Py4JJavaError) and not system.exists(path):
                raise
            number += 1


def save_model_version(
    model: SegmentModel,
    mapping: DataFrame,
    folder: str,
    evaluation: DataFrame | None = None,
    features: list[str] = RFM_FEATURES,
    customer_count: int | None = None,
    notes: str = "Auto-saved model",
) -> str:
    """Save model and metadata under the next ``v{n}_k{k}_{utc}`` and return that id.

    The metadata is written last, so an interrupted save never shows up in the catalog.
    """
    if not isinstance(model, SegmentModel):
        raise TypeError("Only a SegmentModel can be saved as a version.")
    spark = mapping.sparkSession
    number = _claim_number(spark, folder)
    now, k = datetime.now(timezone.utc), model.k
    version = f"v{number}_k{k}_{now:%Y%m%d_%H%M%S}"

    tried = [r.asDict() for r in evaluation.orderBy("k").collect()] if evaluation else []
    fields = ["k", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin"]
    metrics = [{f: r[f] for f in fields} for r in tried]
    own = next((m for m in metrics if m["k"] == k), None)
    best = max((m["silhouette"] for m in metrics), default=None)
    silhouette = own["silhouette"] if own else best
    inertia = model.inertia if model.inertia is not None else (own["inertia"] if own else 0.0)
    record = {
        "version_id": version,
        "created_at": now.isoformat(),
        "k": k,
        "inertia": round(inertia, 4),
        "silhouette_score": None if silhouette is None else round(silhouette, 4),
        "feature_names": list(features),
        "customer_count": customer_count,
        "cluster_map": {str(r["cluster"]): r["segment"] for r in mapping.collect()},
        "eval_metrics": metrics or None,
        "notes": notes,
    }
    model.pipeline.write().save(f"{folder}/{version}/model")
    text = spark.createDataFrame([(json.dumps(record),)], "value string")
    text.coalesce(1).write.text(f"{folder}/{version}/metadata")
    return version


def list_model_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Complete, readable versions, newest first."""
    complete = sorted(
        set(_entries(spark, folder, "*/model/metadata"))
        & set(_entries(spark, folder, "*/metadata/part-*"))
    )
    if not complete:
        return spark.createDataFrame([], VERSION_SCHEMA)
    stored = spark.read.schema(VERSION_SCHEMA).json([f"{folder}/{v}/metadata" for v in complete])
    readable = stored.where(F.col("version_id").isNotNull() & F.col("k").isNotNull())
    return readable.orderBy(F.coalesce("created_at", "version_id").desc())


def load_model_version(
    spark: SparkSession, folder: str, version: str
) -> tuple[SegmentModel, DataFrame, DataFrame]:
    """Model, ``cluster, segment`` mapping and the catalog row of a saved version."""
    for part in ("model/metadata", "metadata"):
        if not _entries(spark, folder, f"{version}/{part}"):
            raise FileNotFoundError(f"Version {version} in {folder} lacks {part}.")
    row = spark.read.schema(VERSION_SCHEMA).json(f"{folder}/{version}/metadata")
    mapping = row.select(F.explode("cluster_map").alias("cluster", "segment")).select(
        F.col("cluster").cast("int").alias("cluster"), "segment"
    )
    known = row.select("k", "inertia").first()
    model = SegmentModel(PipelineModel.load(f"{folder}/{version}/model"), known["k"], known["inertia"])
    return model, mapping, row


def best_version(versions: DataFrame) -> DataFrame:
    """One row: the version with the highest silhouette and how many versions there are."""
    score = F.coalesce("silhouette_score", F.lit(0.0))
    return versions.agg(
        F.count(F.lit(1)).alias("versions"),
        F.max_by("version_id", F.struct(score, "created_at")).alias("best_version"),
        F.max(score).alias("best_silhouette"),
    )


def compare_versions(versions: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """One row: k, silhouette and inertia of both versions and their differences."""

    def of(version: str, column: str):
        chosen = F.when(F.col("version_id") == version, F.coalesce(column, F.lit(0)))
        return F.max(chosen)

    figures = {"k": "k", "silhouette": "silhouette_score", "inertia": "inertia"}
    columns = []
    for name, column in figures.items():
        a, b = of(baseline, column), of(candidate, column)
        columns += [a.alias(f"{name}_a"), b.alias(f"{name}_b"), (b - a).alias(f"{name}_delta")]
    return versions.where(F.col("version_id").isin(baseline, candidate)).agg(*columns)

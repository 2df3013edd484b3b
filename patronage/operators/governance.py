"""Pseudonymous ids and erasure of customers from a clustered table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.hashing import hmac_sha256_hex
from patronage.functions.text import strip
from patronage.schema import RFM_FEATURES, require_columns
from patronage.session import materialize


def pseudonymize_customer_ids(df: DataFrame, salt: str, column: str = "customer_id") -> DataFrame:
    """Replace ids by ``usr_`` and 16 hex digits of their keyed hash; null stays null."""
    require_columns(df, [column], "pseudonymization")
    digest = hmac_sha256_hex(strip(F.col(column)), salt)
    return df.withColumn(column, F.concat(F.lit("usr_"), F.substring(digest, 1, 16)))


def erase_customers(
    clustered: DataFrame, ids: DataFrame, centroids: DataFrame, features: list[str] = RFM_FEATURES
) -> tuple[DataFrame, DataFrame]:
    """Remove the customers in ``ids`` and take them out of the cluster centroids.

    ``centroids`` has one row per ``cluster`` with the ``features`` in the space of ``clustered``.
    A centroid becomes ``(N * c - sum of erased) / (N - erased)``, or zeros for an emptied cluster.
    An id that matches nobody raises ``KeyError``.
    """
    wanted = ids.select(strip(F.col("customer_id")).alias("_id")).distinct()
    keyed = clustered.withColumn("_id", strip(F.col("customer_id")))
    # The customers are read and joined once; what is asked of them afterwards reads the stored result.
    marked = materialize(keyed.join(wanted.withColumn("_erased", F.lit(True)), "_id", "left"))
    matched = marked.where("_erased").select("_id").distinct()
    unknown = wanted.join(matched, "_id", "left_anti").limit(5).collect()
    if unknown:
        raise KeyError(f"No such customers: {[r['_id'] for r in unknown]}")
    remaining = marked.where("_erased is null").select(*clustered.columns)
    gone = F.col("_erased").isNotNull()
    effect = marked.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(gone, F.lit(1))).alias("_m"),
        *[F.sum(F.when(gone, F.col(f).cast("double"))).alias(f"_sum_{f}") for f in features],
    )
    n, m = F.col("_n"), F.col("_m")

    def moved(feature: str):
        kept = F.try_divide(n * F.col(feature) - F.col(f"_sum_{feature}"), n - m)
        new = F.when(n > m, kept).otherwise(0.0)
        return F.when(F.coalesce(m, F.lit(0)) == 0, F.col(feature)).otherwise(new).alias(feature)

    updated = centroids.join(effect, "cluster", "left").select(
        "cluster", *[moved(f) for f in features], (F.coalesce(m, F.lit(0)) > 0).alias("affected")
    )
    return remaining, updated

"""Readable personas for clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.schema import RFM_FEATURES, require_columns
from patronage.session import small_lookup

# Persona, description, recommended action, color.
PERSONAS = [
    ("Champions",
     "Bought recently, buy often, and spend the most. Your most valuable customers.",
     "Reward them with VIP perks, early product access, and referral incentives.", "#1f77b4"),
    ("Loyal Customers",
     "Consistent repeat purchasers with solid lifetime spend and recent engagement.",
     "Upsell higher-value products, offer loyalty program rewards, and ask for reviews.",
     "#2ca02c"),
    ("Potential Loyalists",
     "Recent customers with multiple purchases and growing spend.",
     "Offer memberships, personalized product recommendations, and engagement discounts.",
     "#17becf"),
    ("New Customers",
     "First-time or very recent buyers who have placed 1 or 2 orders.",
     "Send warm onboarding sequences, satisfaction check-ins, and a 2nd purchase incentive.",
     "#ff7f0e"),
    ("Promising",
     "Recent shoppers who spent an average amount but don't buy frequently yet.",
     "Increase brand awareness with targeted content and seasonal promotions.", "#bcbd22"),
    ("Needs Attention",
     "Above-average recency and moderate spend. Showing early signs of disengagement.",
     "Reactivate with limited-time discounts, new arrivals, and re-engagement campaigns.",
     "#9467bd"),
    ("About to Sleep",
     "Below-average recency, frequency, and spend. Will become lost if not re-engaged.",
     "Share popular products, discount vouchers, and reconnect before churn.", "#8c564b"),
    ("At Risk",
     "Spent big and bought frequently in the past, but haven't returned in a long time.",
     "Aggressive win-back campaigns, personal outreach, and exclusive return incentives.",
     "#e377c2"),
    ("Lost / Dormant",
     "Lowest recency, frequency, and monetary values. Inactive for an extended period.",
     "Run low-cost automated win-back campaigns or deprioritize marketing spend.", "#d62728"),
]
# What a segment without a persona of its own gets.
DEFAULT_DESCRIPTION = "Customer segment identified through behavioral clustering."
DEFAULT_ACTION = "Tailor marketing strategy based on RFM profile."
DEFAULT_COLOR = "#7f7f7f"

ALL_CUSTOMERS = "All Customers"
TIER_SUFFIX = r"\s*\(Tier \d+\)$"


def classify(r: Column, f: Column, m: Column) -> Column:
    """Persona of a cluster from its recency, frequency and spend scores in [0, 1]."""
    rules = [
        ((r >= 0.6) & (f >= 0.6) & (m >= 0.6), "Champions"),
        ((f >= 0.6) & (m >= 0.5) & (r >= 0.4), "Loyal Customers"),
        ((f >= 0.6) & (m >= 0.5), "At Risk"),
        ((m >= 0.7) & (r <= 0.4), "At Risk"),
        ((r >= 0.7) & (f <= 0.4) & (m >= 0.5), "Promising"),
        ((r >= 0.7) & (f <= 0.4), "New Customers"),
        ((r >= 0.5) & (f >= 0.4), "Potential Loyalists"),
        ((r >= 0.35) & (f >= 0.25), "Needs Attention"),
        ((r <= 0.35) & (f <= 0.35) & (m <= 0.35), "Lost / Dormant"),
        (r <= 0.4, "About to Sleep"),
    ]
    return F.coalesce(
        *[F.when(applies, F.lit(name)) for applies, name in rules], F.lit("Needs Attention")
    )


def cluster_scores(clustered: DataFrame) -> DataFrame:
    """Mean metrics per cluster, scaled to [0, 1] over the clusters (recency inverted)."""
    require_columns(clustered, ["cluster", *RFM_FEATURES], "personas")
    means = clustered.groupBy("cluster").agg(
        *[F.avg(F.col(f).cast("double")).alias(f) for f in RFM_FEATURES]
    )
    # The windows see one row per cluster.
    all_clusters = W.partitionBy()

    def scaled(feature: str) -> Column:
        low, high = F.min(feature).over(all_clusters), F.max(feature).over(all_clusters)
        return F.try_divide(F.col(feature) - low, high - low)

    r = F.coalesce(1.0 - scaled("recency"), F.lit(0.5))
    f = F.coalesce(scaled("frequency"), F.lit(0.5))
    m = F.coalesce(scaled("monetary"), F.lit(0.5))
    return means.select(
        "*",
        r.alias("r_norm"),
        f.alias("f_norm"),
        m.alias("m_norm"),
        F.count(F.lit(1)).over(all_clusters).alias("clusters"),
    ).withColumn(
        "composite", 0.35 * F.col("r_norm") + 0.35 * F.col("f_norm") + 0.30 * F.col("m_norm")
    )


def persona_mapping(clustered: DataFrame) -> DataFrame:
    """``cluster, segment``: unique names, later namesakes marked `` (Tier n)``."""
    scored = cluster_scores(clustered).withColumn(
        "base", classify(F.col("r_norm"), F.col("f_norm"), F.col("m_norm"))
    )
    strongest = W.partitionBy("base").orderBy(F.desc("composite"), "cluster")
    tier = F.row_number().over(strongest)
    named = F.when(F.col("tier") == 1, F.col("base")).otherwise(
        F.concat("base", F.lit(" (Tier "), F.col("tier").cast("string"), F.lit(")"))
    )
    segment = F.when(F.col("clusters") == 1, F.lit(ALL_CUSTOMERS)).otherwise(named)
    return scored.withColumn("tier", tier).select("cluster", segment.alias("segment"))


def label_segments(clustered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customers with their ``segment``, and the cluster-to-segment table."""
    mapping = small_lookup(persona_mapping(clustered))
    return clustered.join(mapping, "cluster", "left").select(*clustered.columns, "segment"), mapping


def persona_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PERSONAS, "base string, description string, action string, color string"
    )


def with_persona_details(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Add ``description``, ``action`` and ``color`` of each segment, tiers included."""
    name = F.col(segment)
    base = F.regexp_replace(name, TIER_SUFFIX, "")
    # Nine fixed rows.
    known = F.broadcast(persona_table(df.sparkSession)).withColumnRenamed("base", "_base")
    description = F.coalesce("description", F.lit(DEFAULT_DESCRIPTION))
    tiered = F.concat(description, F.lit(" ("), name, F.lit(")"))
    return df.join(known, base == F.col("_base"), "left").select(
        *df.columns,
        F.when(name.contains("Tier"), tiered).otherwise(description).alias("description"),
        F.coalesce("action", F.lit(DEFAULT_ACTION)).alias("action"),
        F.coalesce("color", F.lit(DEFAULT_COLOR)).alias("color"),
    )

"""Figures behind dashboards: filters, key figures, shares, rankings, lookups."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.functions.order_stats import exact_percentiles, unpivot_metrics, value_ranks
from patronage.functions.text import exact_mean, exact_sum, round_to, strip
from patronage.operators.personas import with_persona_details
from patronage.schema import RFM_FEATURES

# Silhouette score from which a separation verdict holds.
SEPARATION_VERDICTS = [(0.50, "strong"), (0.35, "moderate"), (0.20, "weak")]
FILES_PER_BUCKET = 4
HISTOGRAM_BINS = {"recency": 30, "frequency": 25, "monetary": 30}


def _percent_of_total(value: Column, digits: int | None = 1) -> Column:
    total = F.sum(value).over(W.partitionBy()).cast("double")
    share = F.when(total > 0, F.try_divide(value.cast("double"), total) * 100).otherwise(0.0)
    return share if digits is None else round_to(share, digits)


def filter_customers(
    labeled: DataFrame,
    segments: list[str],
    countries: list[str] | None = None,
    spend: tuple[float, float] | None = None,
) -> DataFrame:
    """Customers of the segments (none given: nobody), countries (none given: all) and spend."""
    kept = labeled.where(F.col("segment").isin(segments) if segments else F.lit(False))
    if countries and "country" in labeled.columns:
        kept = kept.where(F.col("country").isin(countries))
    return kept.where(F.col("monetary").between(*spend)) if spend else kept


def overview_kpis(labeled: DataFrame) -> DataFrame:
    revenue = exact_sum(F.col("monetary"))
    customers = F.count(F.lit(1))
    return labeled.agg(
        customers.alias("customers"),
        round_to(F.coalesce(revenue, F.lit(0)), 2).alias("revenue"),
        round_to(
            F.coalesce(F.try_divide(revenue.cast("double"), customers), F.lit(0.0)), 2
        ).alias("avg_spend"),
        F.countDistinct("segment").alias("segments"),
    )


def segment_playbook(labeled: DataFrame) -> DataFrame:
    """Per segment: size, revenue, shares, mean metrics and persona text; revenue descending."""
    grouped = labeled.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        exact_sum(F.col("monetary")).alias("revenue"),
        *[exact_mean(F.col(f)).alias(f"avg_{f}") for f in RFM_FEATURES],
    )
    figures = grouped.select(
        "segment",
        "customers",
        _percent_of_total(F.col("customers")).alias("customer_pct"),
        round_to(F.col("revenue"), 2).alias("revenue"),
        _percent_of_total(F.col("revenue")).alias("revenue_pct"),
        *[round_to(F.col(f"avg_{f}"), 2).alias(f"avg_{f}") for f in RFM_FEATURES],
    )
    return with_persona_details(figures).orderBy(F.desc("revenue"), "segment")


def segment_customers(labeled: DataFrame) -> DataFrame:
    counts = labeled.groupBy("segment").agg(F.count(F.lit(1)).alias("customer_count"))
    return counts.withColumn("percentage", _percent_of_total(F.col("customer_count")))


def segment_revenue(labeled: DataFrame) -> DataFrame:
    sums = labeled.groupBy("segment").agg(exact_sum(F.col("monetary")).alias("revenue"))
    return sums.select(
        "segment",
        F.col("revenue").cast("double").alias("revenue"),
        _percent_of_total(F.col("revenue")).alias("percentage"),
    )


def segment_shares(labeled: DataFrame) -> DataFrame:
    revenue, customers = exact_sum(F.col("monetary")), F.count(F.lit(1))
    return labeled.groupBy("segment").agg(
        customers.alias("customers"),
        round_to(revenue, 2).alias("revenue"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        round_to(revenue.cast("double") / customers, 2).alias("avg_spend_per_cust"),
    )


def chart_columns(labeled: DataFrame) -> DataFrame:
    """Plot-ready columns: floored spend, its decimal logarithm, marker size from CLV if present."""
    added = {
        "monetary_floor": F.greatest(F.col("monetary"), F.lit(0.01)),
        "log_monetary": F.log10(F.greatest(F.col("monetary"), F.lit(1.0))),
    }
    if "predicted_clv_6m" in labeled.columns:
        root = F.sqrt(F.greatest(F.col("predicted_clv_6m"), F.lit(1.0)))
        added["clv_marker_size"] = F.least(F.greatest(root, F.lit(3.0)), F.lit(20.0))
    return labeled.withColumns(added)


def rfm_histograms(rfm: DataFrame, bins: dict[str, int] = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histograms between the extremes; the last bin includes the maximum.

    ``metric, bin, lower, upper, n`` for every bin, empty ones with 0. Values are first counted per
    (metric, value), so the shuffle carries distinct values only.
    """
    metrics = list(bins)
    edges = rfm.agg(
        *[F.min(F.col(m).cast("double")).alias(f"min_{m}") for m in metrics],
        *[F.max(F.col(m).cast("double")).alias(f"max_{m}") for m in metrics],
    ).first()
    parts = []
    for m in metrics:
        low, high = edges[f"min_{m}"], edges[f"max_{m}"]
        if low is None:
            continue
        count = bins[m] if high > low else 1
        width = (high - low) / count if high > low else 0.0
        place = F.floor((F.col(m) - F.lit(low)) / F.lit(width)) if width else F.lit(0)
        parts.append(
            F.struct(
                F.lit(m).alias("metric"),
                F.least(place.cast("int"), F.lit(count - 1)).alias("bin"),
                F.lit(low).alias("low"),
                F.lit(width).alias("width"),
                F.lit(count).alias("bins"),
            )
        )
    counted = (
        rfm.select(F.explode(F.array(*parts)).alias("p"))
        .select("p.*")
        .groupBy("metric", "low", "width", "bins", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most one row per bin from here on.
    by_bin = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    full = counted.groupBy("metric", "low", "width", "bins").agg(by_bin.alias("by_bin"))
    filled = full.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    lower = F.col("low") + F.col("bin") * F.col("width")
    return filled.select(
        "metric",
        "bin",
        lower.alias("lower"),
        (lower + F.col("width")).alias("upper"),
        F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0)).alias("n"),
    )


def segment_radar(labeled: DataFrame) -> DataFrame:
    """Median metrics per segment against the global maximum, 0-100, recency inverted."""
    long = unpivot_metrics(labeled, ["segment"], RFM_FEATURES)
    medians = exact_percentiles(long, ["segment", "metric"], "value", {"median": 0.5})
    peaks = labeled.agg(*[F.max(f).alias(f) for f in RFM_FEATURES]).first()
    top = {f: float(peaks[f] or 1) or 1.0 for f in RFM_FEATURES}
    wide = medians.groupBy("segment").agg(
        *[F.max(F.when(F.col("metric") == f, F.col("median"))).alias(f) for f in RFM_FEATURES]
    )

    def ratio(f: str) -> Column:
        return F.col(f) / F.lit(top[f]) * 100

    return wide.select(
        "segment",
        F.greatest(100 - ratio("recency"), F.lit(0.0)).alias("recency_score"),
        F.least(ratio("frequency"), F.lit(100.0)).alias("frequency_score"),
        F.least(ratio("monetary"), F.lit(100.0)).alias("monetary_score"),
    )


def mean_scores(scored: DataFrame) -> DataFrame:
    return scored.agg(
        *[round_to(F.avg(f"{s}_score"), 2).alias(f"avg_{s}_score") for s in "rfm"],
        round_to(F.avg("rfm_total"), 1).alias("avg_rfm_total"),
    )


def top_scores(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most common score texts and their share; ties by text. At most 125 texts exist."""
    counts = scored.groupBy("rfm_score").agg(F.count(F.lit(1)).alias("customer_count"))
    share = _percent_of_total(F.col("customer_count"))
    return counts.withColumn("pct_of_base", share).orderBy(
        F.desc("customer_count"), "rfm_score"
    ).limit(k)


def separation_report(evaluation: DataFrame) -> DataFrame:
    """Validity table per k with a verdict on the separation."""
    score = F.col("silhouette")
    verdict = F.coalesce(
        *[F.when(score >= limit, F.lit(name)) for limit, name in SEPARATION_VERDICTS],
        F.lit("poor"),
    )
    return evaluation.withColumn("separation", verdict)


def order_timeline(transactions: DataFrame) -> DataFrame:
    """Orders of every customer: total, items and distinct products per invoice and time."""
    products = (
        F.countDistinct("description")
        if "description" in transactions.columns
        else F.count("invoice_no")
    )
    return transactions.groupBy("customer_id", "invoice_no", "invoice_date").agg(
        round_to(exact_sum(F.col("quantity") * F.col("unit_price")), 2).alias("order_total"),
        F.sum("quantity").alias("item_count"),
        products.alias("distinct_products"),
    )


def customer_timeline(transactions: DataFrame, customer_id: str) -> DataFrame:
    own = transactions.where(F.col("customer_id") == F.lit(customer_id))
    return order_timeline(own).orderBy("invoice_date", "invoice_no")


def customer_percentiles(rfm: DataFrame) -> DataFrame:
    """Share of customers each customer equals or beats, per metric, one digit.

    Distinct values of all metrics are ranked by counting in one job, so no window spans all customers. With one digit there
    are at most 1001 shares a metric: the values where they change go to the driver, and each customer's share is
    found among them without a shuffle, however many customers have one value.
    """
    ranks = value_ranks(unpivot_metrics(rfm, [], list(RFM_FEATURES)), ["metric"], "value")
    beaten = F.when(F.col("metric") == "recency", F.col("total") - F.col("n_below")).otherwise(F.col("n_upto"))
    percent = round_to(beaten / F.col("total") * 100, 1).alias("share")
    steps: dict[str, list[tuple[float, float]]] = {metric: [] for metric in RFM_FEATURES}
    found = ranks.select("metric", "value", percent).groupBy("metric", "share").agg(F.min("value").alias("from"))
    for row in found.collect():
        steps[row["metric"]].append((row["from"], row["share"]))
    result = rfm
    for metric, name in zip(RFM_FEATURES, ["recency_pct", "frequency_pct", "monetary_pct"]):
        result = _with_share(result, metric, name, sorted(steps[metric]))
    return result


def _with_share(df: DataFrame, metric: str, name: str, steps: list[tuple[float, float]]) -> DataFrame:
    """Add the share of the last step that is not above the metric."""
    known = F.col(metric).isNotNull()
    if len(steps) < 2:
        return df.withColumn(name, F.when(known, F.lit(steps[0][1] if steps else None).cast("double")))
    splits = [-float("inf"), *(start for start, _ in steps[1:]), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_v", outputCol="_step", handleInvalid="keep").transform(
        df.withColumn("_v", F.coalesce(F.col(metric).cast("double"), F.lit(0.0)))
    )
    shares = F.array(*[F.lit(share) for _, share in steps])
    share = F.when(known, F.try_element_at(shares, F.col("_step").cast("int") + 1))
    return placed.withColumn(name, share).drop("_v", "_step")


def customer_profile(labeled: DataFrame, customer_id: str) -> DataFrame:
    return labeled.where(strip(F.col("customer_id")) == F.lit(customer_id.strip()))


def customer_lines(transactions: DataFrame, customer_id: str) -> DataFrame:
    """Line items of a customer, newest first."""
    own = transactions.where(strip(F.col("customer_id")) == F.lit(customer_id.strip()))
    return own.orderBy(F.desc("invoice_date"), "invoice_no")


def store_by_customer(transactions: DataFrame, name: str, path: str, buckets: int | None = None) -> None:
    """Store line items as table ``name`` at ``path`` so that one customer is looked up without a scan of the others: in
    buckets by customer, sorted by customer and date, with Bloom filters on the id.

    ``buckets`` defaults to the session's shuffle partitions. A bucket is written by up to ``FILES_PER_BUCKET`` tasks, so
    that a customer with a large share of the lines is not a single task."""
    spark = transactions.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = transactions.withColumn("customer_id", strip(F.col("customer_id").cast("string")))
    dealt = keyed.withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.lit(FILES_PER_BUCKET)))
    # The hash of the bucket first, so that a task holds few buckets and files stay few.
    bucket = F.pmod(F.hash("customer_id"), F.lit(buckets))
    spread = dealt.repartition(buckets, bucket, "_deal").drop("_deal")
    writer = spread.write.bucketBy(buckets, "customer_id").sortBy("customer_id", "invoice_date")
    writer.option("parquet.bloom.filter.enabled#customer_id", "true").option("path", path).saveAsTable(name)


def stored_lines(spark: SparkSession, name: str, customer_id: str) -> DataFrame:
    """Line items of a customer, newest first, from a table of :func:`store_by_customer`: one bucket of it is read."""
    own = spark.table(name).where(F.col("customer_id") == F.lit(customer_id.strip()))
    return own.orderBy(F.desc("invoice_date"), "invoice_no")


def preview(labeled: DataFrame, rows: int = 100) -> DataFrame:
    """The biggest spenders first, as the labeled table is ordered."""
    return labeled.orderBy(F.desc("monetary"), "customer_id").limit(rows)


def retention_cells(matrix: DataFrame) -> DataFrame:
    """Heatmap cells of a cohort matrix with the text to show."""
    text = F.when(F.col("retention_pct").isNull(), F.lit("No Data")).when(
        F.col("cohort_index") == 0, F.format_number("customers", 0)
    ).otherwise(F.concat(F.format_number("retention_pct", 1), F.lit("%")))
    return matrix.withColumn("cell_text", text)


def transition_cells(transitions: DataFrame) -> DataFrame:
    """Heatmap cells of a transition matrix in percent."""
    percent = round_to(F.col("prob") * 100, 1)
    return transitions.select(
        "segment_t1",
        "segment_t2",
        F.col("n").alias("customers"),
        percent.alias("migration_pct"),
        F.concat(F.format_number(percent, 1), F.lit("%")).alias("cell_text"),
    )

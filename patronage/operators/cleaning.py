"""Cleaning of raw transactions and the report of what was removed and why.

Every rule is a plain Column: one projection adds the cleaned values and the first rule a row
breaks, so the clean table is a filter and the report is one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.text import (
    clean_id,
    clean_number,
    exact,
    is_cancellation,
    is_missing,
    parse_date,
    round_to,
)
from patronage.schema import MISSING_INVOICE_TEXT
from patronage.session import materialize
from patronage.sources.conform import select_canonical

# Removal reasons in the order in which they apply, with their report wording.
REMOVAL_REASONS = {
    "missing_customer": "Missing / Guest Customer ID",
    "cancelled": "Cancelled Orders (Invoice starts with 'C')",
    "missing_invoice": "Missing / Blank Invoice Number",
    "non_positive_qty": "Non-Positive Quantity (≤ 0)",
    "non_positive_price": "Non-Positive Price (≤ 0)",
    "invalid_date": "Invalid / Unparseable Dates",
}


@dataclass(frozen=True)
class CleaningPolicy:
    """``gross`` drops returns and cancellations; ``net`` keeps returns as refunds; ``day_first``: ``1/2/2011`` is a
    day in February."""

    policy_type: str = "gross"
    remove_duplicates: bool = False
    day_first: bool = False

    def __post_init__(self) -> None:
        if self.policy_type not in ("gross", "net"):
            raise ValueError(f"Unknown cleaning policy '{self.policy_type}'.")


def duplicate_row_count(raw: DataFrame) -> DataFrame:
    """One row: how many rows have at least one exact copy, counting every copy."""
    return (
        raw.groupBy(*raw.columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))
    )


def duplicate_rows(raw: DataFrame) -> DataFrame:
    """Every distinct row that occurs more than once, with its number of ``copies``."""
    return raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def _cleaned(raw: DataFrame, policy: CleaningPolicy, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cleaned columns plus ``_no_customer``; ``carry`` passes through."""
    types = {f.name: f.dataType for f in raw.schema}
    rules = {
        "customer_id": clean_id,
        "invoice_date": lambda value, dtype: parse_date(value, dtype, policy.day_first),
        "quantity": clean_number,
        "unit_price": clean_number,
    }

    def cleaned(name: str) -> Column:
        return rules[name](F.col(name), types[name]) if name in rules else F.col(name)

    no_customer = is_missing(F.col("customer_id"), types["customer_id"])
    names = [c for c in raw.columns if c not in carry]
    return raw.select(
        *carry, *[cleaned(c).alias(c) for c in names], no_customer.alias("_no_customer")
    )


def broken_rules(policy: CleaningPolicy, invoice_type: T.DataType) -> dict[str, Column]:
    """Never-null conditions under which a cleaned row is removed, in order of precedence."""
    quantity, price = F.col("quantity"), F.col("unit_price")
    cancelled = is_cancellation(F.col("invoice_no"), trimmed=True)
    if policy.policy_type == "net":
        cancelled = cancelled & F.coalesce(quantity >= 0, F.lit(False))
        bad_quantity = F.coalesce(quantity == 0, F.lit(True))
    else:
        bad_quantity = F.coalesce(quantity <= 0, F.lit(True))
    return {
        "missing_customer": F.col("_no_customer"),
        "cancelled": cancelled,
        "missing_invoice": is_missing(F.col("invoice_no"), invoice_type, MISSING_INVOICE_TEXT),
        "non_positive_qty": bad_quantity,
        "non_positive_price": F.coalesce(price <= 0, F.lit(True)),
        "invalid_date": F.col("invoice_date").isNull(),
    }


def annotate_transactions(
    raw: DataFrame, policy: CleaningPolicy = CleaningPolicy(), carry: tuple[str, ...] = ()
) -> DataFrame:
    """Cleaned columns plus ``removal_reason``: the first broken rule, null for rows that stay."""
    rules = broken_rules(policy, raw.schema["invoice_no"].dataType)
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return _cleaned(raw, policy, carry).withColumn("removal_reason", reason).drop("_no_customer")


def kept_transactions(raw: DataFrame, policy: CleaningPolicy = CleaningPolicy()) -> DataFrame:
    """Cleaned rows that break no rule, with ``is_refund``.

    Every rule is a filter of its own, so each is applied as early as its columns are known,
    down to the scans below a join.
    """
    kept = _cleaned(raw, policy)
    for broken in broken_rules(policy, raw.schema["invoice_no"].dataType).values():
        kept = kept.where(~broken)
    return with_refund_flag(kept.drop("_no_customer"))


def with_refund_flag(df: DataFrame) -> DataFrame:
    refund = (F.col("quantity") * F.col("unit_price") < 0) | is_cancellation(F.col("invoice_no"))
    return df.withColumn("is_refund", refund)


def clean_transactions(
    df: DataFrame,
    mapping: dict[str, str | None] | None = None,
    remove_duplicates: bool = False,
    policy: CleaningPolicy | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Clean transactions with ``is_refund``, and the one-row report about the cleaning.

    Copies are dropped only on request and only if the raw rows had exact copies. Rows come in no
    particular order; sort by ``invoice_date`` where the result is written.
    """
    policy = policy or CleaningPolicy()
    dedupe = policy.remove_duplicates or remove_duplicates
    policy = replace(policy, remove_duplicates=dedupe)
    raw = select_canonical(df, mapping)
    if not dedupe:
        return kept_transactions(raw, policy), cleaning_report(raw, policy)
    # Collapsed and stored once: the question for copies, the rows and the report all read that table.
    copies = materialize(_with_copies(raw))
    kept = kept_transactions(copies.select(raw.columns), policy)
    if not copies.where("_n > 1").isEmpty():
        kept = kept.dropDuplicates()
    return kept, _report(copies, raw.columns, policy)


def _with_copies(raw: DataFrame) -> DataFrame:
    return raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_n"))


def cleaning_report(raw: DataFrame, policy: CleaningPolicy = CleaningPolicy()) -> DataFrame:
    """One row of counts and revenue figures for canonical raw rows.

    Rows are first collapsed to distinct raw rows with their number of copies, which yields the
    duplicate count and shrinks what the later steps see.
    """
    return _report(_with_copies(raw), raw.columns, policy)


def _report(copies: DataFrame, columns: list[str], policy: CleaningPolicy) -> DataFrame:
    copies = copies.withColumn("_dup", F.when(F.col("_n") > 1, F.col("_n")).otherwise(F.lit(0)))
    marked = annotate_transactions(copies, policy, carry=("_n", "_dup"))
    if policy.remove_duplicates:
        marked = marked.groupBy(*columns, "removal_reason").agg(
            F.sum("_n").alias("_n"), F.sum("_dup").alias("_dup")
        )
    kept = F.col("removal_reason").isNull()
    total = F.col("quantity") * F.col("unit_price")
    weights = {"all": F.col("_n"), "once": F.lit(1).cast("bigint")}

    def add(name: str, condition: Column, value: Column, kind=lambda number: number) -> list[Column]:
        return [
            F.sum(F.when(condition, kind(value * w))).alias(f"{name}_{suffix}")
            for suffix, w in weights.items()
        ]

    # First per reason and customer, so that the distinct customers are simply counted after it.
    customer = F.when(kept, F.col("customer_id")).alias("_customer")
    per_customer = marked.groupBy("removal_reason", customer).agg(
        F.sum("_n").alias("_n"),
        F.sum("_dup").alias("_dup"),
        F.min("invoice_date").alias("first"),
        F.max("invoice_date").alias("last"),
        *add("rows", F.lit(True), F.lit(1).cast("bigint")),
        *add("gross", total > 0, total, exact),
        *add("refund", total < 0, -total, exact),
        *add("refunds", total < 0, F.lit(1).cast("bigint")),
    )
    names = ["rows", "gross", "refund", "refunds"]
    sums = [f"{name}_{suffix}" for name in names for suffix in weights]
    totals = per_customer.agg(
        F.sum("_n").alias("before"),
        F.sum("_dup").alias("dups"),
        *[
            F.sum(F.when(F.col("removal_reason") == r, F.col("_n"))).alias(f"rows_removed_{r}")
            for r in REMOVAL_REASONS
        ],
        F.count(F.when(kept, 1)).alias("customers"),
        F.min(F.when(kept, F.col("first"))).alias("first"),
        F.max(F.when(kept, F.col("last"))).alias("last"),
        *[F.sum(F.when(kept, F.col(c))).alias(c) for c in sums],
    )
    dedupe = F.lit(policy.remove_duplicates) & (F.col("dups") > 0)

    def pick(name: str) -> Column:
        chosen = F.when(dedupe, F.col(f"{name}_once")).otherwise(F.col(f"{name}_all"))
        return F.coalesce(chosen, F.lit(0))

    before, after = F.coalesce(F.col("before"), F.lit(0)), pick("rows").cast("bigint")
    gross, refund = pick("gross").cast("double"), pick("refund").cast("double")
    revenue = gross - refund if policy.policy_type == "net" else gross

    def share(part: Column, whole: Column) -> Column:
        ratio = F.try_divide(part.cast("double"), whole.cast("double")) * 100
        return round_to(F.when(whole > 0, F.coalesce(ratio, F.lit(0.0))).otherwise(0.0), 2)

    return totals.select(
        before.alias("total_rows_before"),
        after.alias("total_rows_after"),
        F.col("customers").alias("total_customers"),
        round_to(revenue, 2).alias("total_revenue"),
        F.date_format("first", "yyyy-MM-dd").alias("date_min"),
        F.date_format("last", "yyyy-MM-dd").alias("date_max"),
        *[
            F.coalesce(F.col(f"rows_removed_{r}"), F.lit(0)).alias(f"rows_removed_{r}")
            for r in REMOVAL_REASONS
        ],
        F.coalesce(F.col("dups"), F.lit(0)).alias("duplicate_rows_detected"),
        F.lit(policy.remove_duplicates).alias("duplicates_removed"),
        F.lit(policy.policy_type).alias("policy_type"),
        round_to(gross, 2).alias("gross_revenue"),
        round_to(refund, 2).alias("refund_amount"),
        pick("refunds").cast("bigint").alias("refund_count"),
        share(refund, gross).alias("refund_rate_pct"),
        (before - after).alias("total_rows_removed"),
        share(after, before).alias("retention_percentage"),
    )


def removal_breakdown(report: DataFrame) -> DataFrame:
    """Long form of a cleaning report: rows filtered per reason, and redundant copies."""
    dups = F.col("duplicate_rows_detected")
    entries = [
        F.struct(F.lit(label).alias("reason"), F.col(f"rows_removed_{r}").alias("rows_filtered"))
        for r, label in REMOVAL_REASONS.items()
    ]
    redundant = F.when(dups >= 2, F.floor(dups / 2)).otherwise(dups).cast("bigint")
    entries.append(
        F.struct(F.lit("Redundant duplicate copies").alias("reason"), redundant.alias("rows_filtered"))
    )
    return report.select(F.explode(F.array(*entries)).alias("e")).select("e.*")

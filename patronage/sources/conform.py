"""Header mapping and projection onto the canonical schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.text import clean_id, clean_number, parse_date
from patronage.schema import CANONICAL_COLUMNS, COLUMN_ALIASES, REQUIRED_COLUMNS


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def map_columns(
    columns: list[str], aliases: dict[str, list[str]] = COLUMN_ALIASES
) -> dict[str, str | None]:
    """Canonical name to header, matched on letters and digits only; each header used once."""
    by_plain_name = {_plain(c): c for c in columns}
    mapping: dict[str, str | None] = {}
    for canonical, spellings in aliases.items():
        candidates = (by_plain_name.get(_plain(s)) for s in [canonical, *spellings])
        taken = set(mapping.values())
        mapping[canonical] = next((c for c in candidates if c and c not in taken), None)
    return mapping


def mapping_issues(
    mapping: dict[str, str | None], required: list[str] = REQUIRED_COLUMNS
) -> list[str]:
    """Unmapped required columns and headers used twice; empty when the mapping is usable."""
    issues = [c for c in required if not mapping.get(c)]
    first_use: dict[str, str] = {}
    for canonical, header in mapping.items():
        if header is None:
            continue
        if header in first_use:
            issues.append(
                f"{first_use[header]} and {canonical} both point to '{header}'"
            )
        first_use.setdefault(header, canonical)
    return issues


def select_canonical(df: DataFrame, mapping: dict[str, str | None] | None = None) -> DataFrame:
    """Keep and rename the mapped columns, values untouched."""
    mapping = map_columns(df.columns) if mapping is None else mapping
    issues = mapping_issues(mapping)
    if issues:
        raise ValueError(f"Column mapping is not usable: {issues}")
    present = [c for c in CANONICAL_COLUMNS if mapping.get(c)]
    return df.select(*[F.col(f"`{mapping[c]}`").alias(c) for c in present])


def conform_transactions(
    df: DataFrame, mapping: dict[str, str | None] | None = None, day_first: bool = False
) -> DataFrame:
    """Canonical columns with their types; text that does not parse becomes null."""
    raw = select_canonical(df, mapping)
    types = {f.name: f.dataType for f in raw.schema}
    converted = {
        "customer_id": lambda c: F.when(c.isNotNull(), clean_id(c, types["customer_id"])),
        "invoice_date": lambda c: parse_date(c, types["invoice_date"], day_first),
        "quantity": lambda c: clean_number(c, types["quantity"]),
        "unit_price": lambda c: clean_number(c, types["unit_price"]),
    }
    return raw.select(
        *[converted.get(c, lambda x: x.cast("string"))(F.col(c)).alias(c) for c in raw.columns]
    )

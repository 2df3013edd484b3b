"""Canonical transaction schema and the fixed values that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame

REQUIRED_COLUMNS = ["customer_id", "invoice_no", "invoice_date", "quantity", "unit_price"]
OPTIONAL_COLUMNS = ["country", "description"]
CANONICAL_COLUMNS = REQUIRED_COLUMNS + OPTIONAL_COLUMNS

RFM_FEATURES = ["recency", "frequency", "monetary"]

# Text that counts as "no value" after trimming and lower-casing.
MISSING_TEXT = ["", "nan", "none", "null"]
MISSING_INVOICE_TEXT = MISSING_TEXT + ["0"]

# Accepted header spellings per canonical column, in order of preference.
COLUMN_ALIASES = {
    "customer_id": [
        "customerid", "customer_id", "cust_id", "clientid", "client_id",
        "customer", "user_id", "userid", "account_id", "accountid",
    ],
    "invoice_no": [
        "invoiceno", "invoice_no", "invoicenumber", "invoice_num", "invoice", "order_id",
        "orderid", "orderno", "order_number", "transaction_id", "trans_id", "bill_no",
    ],
    "invoice_date": [
        "invoicedate", "invoice_date", "date", "order_date", "orderdate",
        "transaction_date", "trans_date", "timestamp", "created_at", "purchase_date",
    ],
    "quantity": ["quantity", "qty", "count", "item_count", "volume", "units", "pieces"],
    "unit_price": [
        "unitprice", "unit_price", "price", "item_price", "unit_cost", "rate", "amount", "sales",
    ],
    "country": ["country", "nation", "region", "location", "state"],
    "description": ["description", "product_name", "item_description", "item_name", "product"],
}

def require_columns(df: DataFrame, columns: list[str], purpose: str) -> None:
    """Raise ``ValueError`` naming every column of ``columns`` that ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{purpose} needs columns that are not there: {missing}")

from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from patronage.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


def day(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


TX = (
    "customer_id string, invoice_no string, invoice_date timestamp_ntz, quantity double, "
    "unit_price double"
)


@pytest.fixture(scope="session")
def transactions(spark):
    """Rows of (customer, invoice, date, quantity, price[, extra columns])."""

    def build(rows, extra: str = ""):
        parsed = [(r[0], r[1], day(r[2]), float(r[3]), float(r[4]), *r[5:]) for r in rows]
        return spark.createDataFrame(parsed, TX + extra)

    return build


@pytest.fixture(scope="session")
def rfm_base(spark):
    """Thirty customers in three clearly separate groups."""
    rows = []
    for i in range(10):
        rows.append((f"C_CHAMP_{i}", 1.0 + i, 10 + 2 * i, 1500.0 + 350 * i))
        rows.append((f"C_NEW_{i}", 2.0 + 2 * i, 1 + i % 2, 20.0 + 13 * i))
        rows.append((f"C_LOST_{i}", 150.0 + 17 * i, 1 + i % 2, 20.0 + 8 * i))
    return spark.createDataFrame(
        rows, "customer_id string, recency double, frequency int, monetary double"
    )


def one(df) -> dict:
    return df.first().asDict()


def by(df, key: str) -> dict:
    return {r[key]: r.asDict() for r in df.collect()}

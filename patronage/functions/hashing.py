"""Keyed and plain hashes as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256_hex(message: Column, key: str) -> Column:
    """Hex HMAC-SHA256 of a text column under a driver-side key (RFC 2104)."""
    secret = key.encode("utf-8")
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(64, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in secret))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in secret))
    inner = F.sha2(F.concat(inner_pad, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def sha256_percentile(text: Column) -> Column:
    """SHA-256 of ``text`` read as one big integer, modulo 100."""
    digest = F.sha2(text, 256)
    remainder = F.lit(0).cast("bigint")
    for start in range(1, 65, 8):
        chunk = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        # 2**32 leaves 96 modulo 100.
        remainder = (remainder * 96 + chunk) % 100
    return remainder

"""Deterministic row keys: the same row gets the same draw on every run."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def row_digest(key: Column) -> Column:
    return F.md5(key.cast("string"))


def digest_bucket(key: Column, buckets: int, digits: int = 6) -> Column:
    """Bucket 0..buckets-1 from the leading hex digits of the key's digest."""
    leading = F.conv(F.substring(row_digest(key), 1, digits), 16, 10).cast("bigint")
    return F.pmod(leading, F.lit(buckets)).cast("int")

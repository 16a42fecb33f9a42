"""Seeded order keys and sampling hashes that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col


def order_hash(key: Column | str, seed: int) -> Column:
    """Seeded shuffle key: 32 hex digits, unique per ``key`` for practical purposes.

    Ordering by it is a shuffle that a rerun, a retry or another partition
    count repeats exactly.  Its leading digits are evenly spread, which the
    budget gate uses as buckets.
    """
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def unit_hash(key: Column | str, seed: int) -> Column:
    """Seeded number in [0, 1), with 32 bits from the order hash."""
    head = F.conv(F.substring(order_hash(key, seed), 1, 8), 16, 10).cast("double")
    return head / F.lit(float(1 << 32))

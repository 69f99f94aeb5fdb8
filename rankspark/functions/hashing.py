"""Stable hashes that do not depend on process, partition or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(c: Column) -> Column:
    """First 64 bits of SHA-256 as an unsigned number, held in a decimal."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_pick(c: Column, n: int | Column, draw: int = 0) -> Column:
    """A number from 0 to n-1 for the text. ``draw`` gives further, unrelated picks."""
    size = (F.lit(n) if isinstance(n, int) else n).cast("decimal(20,0)")
    h = stable_hash(c)
    for _ in range(draw):
        h = F.floor(h / size).cast("decimal(20,0)")
    return F.pmod(h, size).cast("int")

"""Seeded draws keyed by content.

A draw depends on the seed and the key alone, never on partitioning, order or
retries, and any engine with md5 repeats it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(1 << 32)
SEED = 1337


def draw(seed: int | str | Column, *keys: Column) -> Column:
    """The md5 of `seed|key|...`; the readers below take 32-bit slices of it."""
    return F.md5(F.concat_ws("|", seed if isinstance(seed, Column) else F.lit(str(seed)), *[k.cast("string") for k in keys]))


def whole(hexed: Column, part: int = 0) -> Column:
    """The part-th 32-bit slice as a non-negative bigint."""
    return F.conv(F.substring(hexed, 1 + 8 * part, 8), 16, 10).cast("bigint")


def unit(hexed: Column, part: int = 0) -> Column:
    """The part-th slice as a double in [0, 1)."""
    return whole(hexed, part).cast("double") / F.lit(SCALE)


def pick(hexed: Column, part: int, size: Column) -> Column:
    """The part-th slice as a position in 1..size."""
    return (whole(hexed, part) % size + 1).cast("int")

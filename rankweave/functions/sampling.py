"""Repeatable pseudo-random order and numbers, the same on every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: int | str, *ids: Column) -> Column:
    """A text whose order is random but fixed by seed and ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(i.cast("string") for i in ids)))


def uniform(seed: int | str, *ids: Column) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of the key."""
    return (F.conv(F.substring(key(seed, *ids), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

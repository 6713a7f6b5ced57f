"""Vector measures as column expressions; a vector is an array of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    """The sum of an array, in array order."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mips_item(v: Column, max_norm: Column) -> Column:
    """An item with one more component, so that largest inner product becomes smallest distance."""
    return F.concat(v, F.array(F.sqrt(F.greatest(max_norm * max_norm - dot(v, v), F.lit(0.0)))))


def mips_query(v: Column) -> Column:
    return F.concat(v, F.array(F.lit(0.0)))

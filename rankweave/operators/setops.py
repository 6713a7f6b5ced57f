"""Set operations over rows and ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_chunks(chunks: list[DataFrame], key: list[str]) -> DataFrame:
    """All chunks of one computation; rows of one key must be equal, else the job fails."""
    whole = reduce(lambda a, b: a.unionByName(b), chunks).distinct()
    kept = [c for c in whole.columns if c not in key]
    one = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in kept])
    fine = F.assert_true(F.col("_n") == 1, "chunks disagree on a key")
    return one.where(F.coalesce(fine.cast("boolean"), F.lit(True))).drop("_n")


def _paired(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """(query_id, x, y): both lists of a query, an empty one for the side that lacks it."""
    both = a.select("query_id", F.col("indices").alias("x")).join(b.select("query_id", F.col("indices").alias("y")), "query_id", how)
    none = [F.filter(c, lambda _: F.lit(False)) for c in ("y", "x")]
    return both.select("query_id", F.coalesce("x", none[0]).alias("x"), F.coalesce("y", none[1]).alias("y"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, common, diff, total, common_frac, diff_frac) of two packed lists.

    Items count once on either side, the fractions are of the first list's length; of an empty list 0.
    A query that only one side has meets an empty list.
    """
    both = _paired(a, b, "full")
    common, size = F.size(F.array_intersect("x", "y")), F.size("x")
    out = both.select("query_id", common.alias("common"), size.alias("total"))
    share = F.when(F.col("total") > 0, F.col("common") / F.col("total")).otherwise(0.0)
    return out.select("query_id", "common", (F.col("total") - F.col("common")).alias("diff"), "total", share.alias("common_frac"), F.when(F.col("total") > 0, 1 - share).otherwise(0.0).alias("diff_frac"))


def recall_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, recall): which part of the second list's items the first has; of a query that the first lacks 0."""
    both = _paired(a, b, "right")
    return both.select("query_id", (F.size(F.array_intersect("x", "y")) / F.greatest(F.size("y"), F.lit(1))).alias("recall"))

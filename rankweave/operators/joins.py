"""Joins of queries to items: by key, by domain and key, by title; merges of candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.ordering import ordinals


def link_gold(mentions: DataFrame, entities: DataFrame, key: str = "label_id", kb_key: str = "kb_id", on: tuple[str, ...] = ()) -> DataFrame:
    """Mentions with the ``item_id`` of their entity as ``gold``; a mention without one is dropped.

    ``on`` names further columns, such as the domain, that must agree.
    """
    ids = entities.select(F.col(kb_key).alias(key), *on, F.col("item_id").alias("gold"))
    return mentions.join(ids, [key, *on])


def unlinked(mentions: DataFrame, entities: DataFrame, key: str = "label_id", kb_key: str = "kb_id", on: tuple[str, ...] = ()) -> DataFrame:
    """Mentions whose entity is missing."""
    return mentions.join(entities.select(F.col(kb_key).alias(key), *on), [key, *on], "left_anti")


def link_gold_strict(mentions: DataFrame, entities: DataFrame, key: str = "label_id", kb_key: str = "kb_id", on: tuple[str, ...] = ()) -> DataFrame:
    """As ``link_gold``, but an unknown key fails the job."""
    ids = entities.select(F.col(kb_key).alias(key), *on, F.col("item_id").alias("gold"))
    joined = mentions.join(ids, [key, *on], "left")
    return joined.where(F.coalesce(F.assert_true(F.col("gold").isNotNull(), F.concat(F.lit("unknown key "), F.col(key).cast("string"))).cast("boolean"), F.lit(True)))


def titles_to_ids(lists: DataFrame, entities: DataFrame, title: str = "title") -> DataFrame:
    """Titles of a ranked list as item ids; of entities with one title the last counts."""
    ids = entities.groupBy(title).agg(F.max("item_id").alias("item_id"))
    return lists.join(ids, title)


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """``left`` and ``right`` side by side: the n-th row of one with the n-th of the other, numbered as ``ordinal``.

    Rows are numbered along columns of distinct values; those beyond the shorter side's end are dropped.
    """
    return ordinals(left, left_order).join(ordinals(right, right_order), "ordinal")


def merge_candidates(left: DataFrame, right: DataFrame, digits: int = 4) -> DataFrame:
    """(query_id, item_id, score, source): the union of two candidate lists, the left's score first.

    Scores of a pair that both have must agree to ``digits`` decimals, else the job fails.
    """
    a = left.select("query_id", "item_id", F.col("score").alias("a"))
    b = right.select("query_id", "item_id", F.col("score").alias("b"))
    both = a.join(b, ["query_id", "item_id"], "full_outer")
    agree = F.col("a").isNull() | F.col("b").isNull() | (F.round(F.abs(F.col("a") - F.col("b")), digits) == 0)
    checked = both.where(F.coalesce(F.assert_true(agree, "scores of one pair differ").cast("boolean"), F.lit(True)))
    source = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("both")
    return checked.select("query_id", "item_id", F.coalesce("a", "b").alias("score"), source.alias("source"))


def without(candidates: DataFrame, excluded: DataFrame, item: str = "item_id") -> DataFrame:
    """Candidates that are not among the excluded (query_id, item) pairs."""
    return candidates.join(excluded.select("query_id", item), ["query_id", item], "left_anti")


def without_reciprocal(pairs: DataFrame, filters: DataFrame) -> DataFrame:
    """(query_id, item_id, score) pairs less those named by a filter list."""
    return pairs.join(filters.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_anti")

"""What the queries share: the tables in the engine's roles, and the same as SQL.

Vectors: queries are the rows of ``embeddings`` whose id is divisible by 20, items all rows.  The exact
scorer is the inner product, the cheap one that of the first 16 components.  A query's gold item is
the smallest other id with its label; for multi-label metrics all others with its label are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators.scoring import Pairs, first_dims, matrix, topk

CHEAP = first_dims(16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("e"), "label")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumnRenamed("item_id", "id")


def exact(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return topk(queries(spark, sf_dir), items(spark, sf_dir), k)


def cheap(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return topk(queries(spark, sf_dir), items(spark, sf_dir), k, CHEAP)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, item_id, score, cheap) of all pairs of the query set and the items, but a query with itself."""
    return matrix(queries(spark, sf_dir), items(spark, sf_dir), {"score": "ip", "cheap": CHEAP}).where("query_id <> item_id")


def scored(spark: SparkSession, sf_dir: str) -> Pairs:
    """The same pairs by the exact scorer, not formed until they are asked for."""
    return Pairs(queries(spark, sf_dir), items(spark, sf_dir))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, gold): from the two smallest ids of each label, so that no pairs are formed."""
    two = items(spark, sf_dir).groupBy("label").agg(F.min("item_id").alias("first"))
    second = items(spark, sf_dir).join(two, "label").where("item_id <> first").groupBy("label").agg(F.min("item_id").alias("second"))
    joined = queries(spark, sf_dir).join(two, "label").join(second, "label", "left")
    return joined.select("query_id", "label", F.when(F.col("first") == F.col("query_id"), F.col("second")).otherwise(F.col("first")).alias("gold")).where("gold is not null")


def gold_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, item_id) of all others with the query's label."""
    q = queries(spark, sf_dir).select("query_id", "label")
    return items(spark, sf_dir).select("item_id", "label").join(q, "label").where("item_id <> query_id").select("query_id", "item_id")


Q = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 20 = 0)"
I = "i AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS e, label FROM embeddings)"  # noqa: E741
S = f"{Q}, {I}, s AS MATERIALIZED (SELECT query_id, item_id, list_dot_product(q.e, i.e) AS score, list_dot_product(q.e[1:16], i.e[1:16]) AS cheap, q.label = i.label AS same FROM q JOIN i ON query_id <> item_id)"
R = f"{S}, ex AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rk FROM s), ch AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cheap DESC, item_id) AS rk FROM s)"
GOLD = "gold AS (SELECT query_id, q.label, min(item_id) AS gold FROM q JOIN i ON q.label = i.label AND query_id <> item_id GROUP BY ALL)"


def uniform(seed: int, *ids: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *(f"({i})::VARCHAR" for i in ids)])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def md5_key(seed: int | str, *ids: str) -> str:
    return "md5(" + " || ':' || ".join([f"'{seed}'", *(f"({i})::VARCHAR" for i in ids)]) + ")"

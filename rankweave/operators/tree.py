"""Pivot trees: nodes split by which of two pivots an item is more similar to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.sampling import key
from rankweave.functions.vectors import dot
from rankweave.operators.scoring import ranked
from rankweave.session import cut


def build(items: DataFrame, max_leaf: int, depth: int, seed: int, pivots: str = "random") -> tuple[DataFrame, DataFrame]:
    """(node, left, right pivot ids and vectors) and (item_id, e, leaf), all nodes of a level at once.

    Nodes are numbered as a heap from 1.  The pivots of a node are its first two items in hashed
    order, or with ``far`` the first and the one least similar to it.  Items as similar to both go
    left or right by the parity of their hash, so that ties cannot stop the splitting.
    """
    placed = cut(items.select("item_id", "e", F.lit(1).cast("long").alias("node"), F.lit(False).alias("done")))
    tree = None
    for level in range(depth):
        nodes = placed.where(~F.col("done"))
        large = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_leaf)
        live = nodes.join(large.select("node"), "node", "left_semi")
        order = F.struct(key(f"{seed}:{level}", F.col("item_id")), F.col("item_id"))
        left = live.groupBy("node").agg(F.min_by(F.struct("item_id", "e"), order).alias("l"))
        rest = live.join(left, "node").where(F.col("item_id") != F.col("l.item_id"))
        by = order if pivots == "random" else F.struct(dot(F.col("l.e"), F.col("e")), F.col("item_id"))
        right = rest.groupBy("node").agg(F.min_by(F.struct("item_id", "e"), by).alias("r"))
        chosen = cut(left.join(right, "node").select("node", F.col("l.item_id").alias("left_id"), F.col("l.e").alias("left_e"), F.col("r.item_id").alias("right_id"), F.col("r.e").alias("right_e")))
        if chosen.isEmpty():
            break
        tree = chosen if tree is None else tree.unionByName(chosen)
        to_left, to_right = dot(F.col("e"), F.col("left_e")), dot(F.col("e"), F.col("right_e"))
        odd = F.substring(key(seed, F.col("item_id")), 1, 1).isin(*"13579bdf")
        goes_right = (to_right > to_left) | ((to_right == to_left) & odd)
        moved = placed.join(chosen, "node", "left")
        placed = cut(moved.select("item_id", "e", F.when(F.col("left_id").isNull(), F.col("node")).otherwise(2 * F.col("node") + goes_right.cast("int")).alias("node"), F.col("left_id").isNull().alias("done")))
    schema = "node long, left_id long, left_e array<double>, right_id long, right_e array<double>"
    return tree if tree is not None else items.sparkSession.createDataFrame([], schema), placed.select("item_id", "e", F.col("node").alias("leaf"))


def search(queries: DataFrame, tree: DataFrame, leaves: DataFrame, k: int, beam: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, rk, item_id, score) and (query_id, n_scored): at each level the beam's nodes branch to
    both pivots, the ``beam`` most similar pivots go on, and reached leaves are scored whole."""
    front = queries.select("query_id", F.col("e").alias("q"), F.lit(1).cast("long").alias("node"), F.lit(0.0).alias("s"))
    pivots, done = None, None
    for _ in range(depth + 1):
        ended = front.join(tree.select("node"), "node", "left_anti")
        done = ended if done is None else done.unionByName(ended)
        inner = front.join(tree, "node")
        sides = inner.select("query_id", "q", F.explode(F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left_id").alias("pivot"), dot(F.col("q"), F.col("left_e")).alias("s")),
            F.struct((2 * F.col("node") + 1).alias("node"), F.col("right_id").alias("pivot"), dot(F.col("q"), F.col("right_e")).alias("s")),
        )).alias("b")).select("query_id", "q", "b.*")
        sides = cut(sides)
        if sides.isEmpty():
            break
        pivots = sides if pivots is None else pivots.unionByName(sides)
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "node"))
        front = cut(sides.withColumn("b", best).where(F.col("b") <= beam).select("query_id", "q", "node", "s"))
    hit = done.join(leaves, done["node"] == leaves["leaf"]).select("query_id", "item_id", dot(F.col("q"), F.col("e")).alias("score"))
    if pivots is not None:
        hit = hit.unionByName(pivots.select("query_id", F.col("pivot").alias("item_id"), F.col("s").alias("score")))
    hit = hit.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return ranked(hit, k), hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_scored"))

"""Connected components of a distributed edge list, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.session import cut

HOT = 512  #: a node with more than this fraction of the edges is hot; there are 2 * HOT of them at most


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step of the alternating algorithm: neighbours of a node move to its smallest one.

    ``total`` edges at most.  The few nodes that hold a large share of them meet their edges by a broadcast,
    so that no task gets a whole star; their number is bounded by that share.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), (F.col("n") > total / HOT).alias("hot"))
    hot = F.broadcast(least.where("hot").select("a", F.col("m").alias("m0")))
    marked = both.join(hot, "a", "left")
    joined = marked.where("m0 is null").drop("m0").join(least.where("not hot").select("a", "m"), "a").unionByName(marked.where("m0 is not null").withColumnRenamed("m0", "m"))
    moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges; the component is its smallest node.

    Large-star and small-star steps alternate until nothing changes, in about the log of the
    component's size; each round's edges are cut from their lineage.  Null ends and loops: a loop's
    node is a component alone, an edge with a null end is none.  No edges: no nodes.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    pairs = cut(pairs.distinct())
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    now = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    total, mark = pairs.count(), None
    for _ in range(rounds):
        if not total:
            break
        for large in (True, False):
            now = cut(_stars(now, large, total))  # each step by itself, as a step names its edges several times
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(found):
            break
        mark, total = tuple(found), max(found[0], 1)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))

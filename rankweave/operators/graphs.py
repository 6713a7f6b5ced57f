"""Neighbour graphs as edge tables (src, dst, pos), their distances and their shape."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.sampling import key, uniform
from rankweave.operators.index import nearest
from rankweave.operators.ordering import ordinals
from rankweave.operators.scoring import ranked
from rankweave.session import cut


GRAPH_EDGES = 4_000_000  #: directed edges up to which every task gets the graph, 4 bytes each
ANSWERS = 1_000_000  #: answers up to which they are sent to the distances


def knn_graph(vectors: DataFrame, k: int, metric: str = "ip", index: str = "auto", drop_first: bool = False) -> DataFrame:
    """Each node's k nearest others; with ``drop_first`` the k+1 nearest less the first, whichever that is."""
    nodes = vectors.select(F.col("id").alias("query_id"), "e")
    items = vectors.select(F.col("id").alias("item_id"), "e")
    found = nearest(nodes, items, k + 1 if drop_first else k, metric, index, exclude_self=not drop_first)
    if drop_first:
        found = found.where("rk > 1").withColumn("rk", F.col("rk") - 1)
    return found.select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"), F.col("rk").alias("pos"), "score")


def random_graph(ids: DataFrame, k: int, seed: int, id_col: str = "id", allow_self: bool = False) -> DataFrame:
    """Each node's k distinct random neighbours, drawn by hashed numbers, so that no pairs are formed."""
    numbered = ordinals(ids.select(F.col(id_col).alias("id")), "id")
    n = numbered.count()
    draws = 3 * k + 12
    drawn = numbered.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("ordinal", F.floor(uniform(seed, F.col("src"), F.col("draw")) * n).cast("long"))
    named = drawn.join(numbered.select("ordinal", F.col("id").alias("dst")), "ordinal")
    if not allow_self:
        named = named.where("src <> dst")
    first = named.groupBy("src", "dst").agg(F.min("draw").alias("draw"))
    pos = F.row_number().over(Window.partitionBy("src").orderBy("draw"))
    return first.withColumn("pos", pos).where(F.col("pos") <= k).select("src", "dst", "pos")


def knn_from_scores(scores: DataFrame, k: int) -> DataFrame:
    """A graph from item-item scores (item_x, item_y, score): exactly the k best others of each."""
    others = scores.where("item_x <> item_y").select(F.col("item_x").alias("query_id"), F.col("item_y").alias("item_id"), "score")
    return ranked(others, k).select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"), F.col("rk").alias("pos"))


def small_world(short: DataFrame, random: DataFrame, degree: int, long_share: float = 0.2, long_range: bool = True) -> DataFrame:
    """Near neighbours and, with ``long_range``, some random ones, ``degree`` in all.

    A random neighbour that is near already is skipped; without ``long_range`` only the near part of
    the degree remains.
    """
    n_long = math.ceil(long_share * degree)
    near = short.where(F.col("pos") <= degree - n_long).select("src", "dst", "pos")
    if not long_range:
        return near
    far = random.select("src", "dst", F.col("pos").alias("p")).join(near.select("src", "dst"), ["src", "dst"], "left_anti")
    far = far.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("p"))).where(F.col("pos") <= n_long)
    return near.unionByName(far.select("src", "dst", (F.col("pos") + degree - n_long).alias("pos")))


def levels(ids: DataFrame, degree: int, seed: int, id_col: str = "id") -> DataFrame:
    """(id, level): geometric levels as of a hierarchical small world, by hashed numbers."""
    return ids.select(F.col(id_col).alias("id"), F.floor(-F.log(uniform(seed, F.col(id_col))) / math.log(degree)).cast("int").alias("level"))


def hierarchical(vectors: DataFrame, degree: int, seed: int, metric: str = "ip") -> DataFrame:
    """(level, src, dst, pos): for each level the near neighbours among the nodes that reach it.

    In place of one insertion after the other, each level's exact neighbours are taken at once.
    """
    placed = cut(vectors.join(levels(vectors, degree, seed), "id"))
    top = placed.agg(F.max("level")).first()[0]
    out = None
    for level in range((top or 0) + 1):
        part = knn_graph(placed.where(F.col("level") >= level).select("id", "e"), degree, metric, "exact").select(F.lit(level).alias("level"), "src", "dst", "pos")
        out = part if out is None else out.unionByName(part)
    return out


def degree_stats(edges: DataFrame) -> DataFrame:
    """Mean and percentiles of out-degrees."""
    per = edges.groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("degree"))
    return per.agg(F.avg("degree").alias("mean"), *[F.percentile("degree", F.lit(p / 100)).alias(f"p{p}") for p in (1, 10, 50, 90, 99)])


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, dist) in edges of the undirected graph, a level at a time until none is new, or up to ``most`` levels.

    A graph of ``GRAPH_EDGES`` at most goes to every task, which walks from its own sources and shuffles
    nothing; a larger one, or one whose ids are not whole numbers, is walked by joins of all sources.
    """
    graph = cut(undirected(edges))
    kinds = {graph.schema["src"].dataType.simpleString(), sources.schema["source"].dataType.simpleString()}
    if kinds <= {"int", "bigint"} and graph.count() <= GRAPH_EDGES:
        return _walked(graph, sources, most, "int" if kinds == {"int"} else "bigint")
    seen = cut(sources.select(F.col("source"), F.col("source").alias("node")).distinct().withColumn("dist", F.lit(0)))
    edge = seen
    for level in itertools.count(1) if most is None else range(1, most + 1):
        step = edge.join(graph, edge["node"] == graph["src"]).select("source", F.col("dst").alias("node")).distinct()
        edge = cut(step.join(seen, ["source", "node"], "left_anti").withColumn("dist", F.lit(level)))
        if edge.isEmpty():
            break
        seen = cut(seen.unionByName(edge))
    return seen


def _walked(graph: DataFrame, sources: DataFrame, most: int | None, kind: str) -> DataFrame:
    spark = graph.sparkSession
    src, dst = (c.to_numpy() for c in graph.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null").toArrow().columns)
    ids = np.unique(src)  # both directions are there
    order = np.argsort(src, kind="stable")
    begin = np.searchsorted(src[order], ids)
    sent = spark.sparkContext.broadcast((ids, np.append(begin, len(src)), np.searchsorted(ids, dst[order]).astype(np.int32)))

    def walk(start: int) -> tuple[np.ndarray, np.ndarray]:
        ids, begin, nbrs = sent.value
        at = int(np.searchsorted(ids, start))
        if at == len(ids) or ids[at] != start:
            return np.array([start], np.int64), np.zeros(1, np.int32)
        dist = np.full(len(ids), -1, np.int32)
        dist[at] = level = 0
        front = np.array([at])
        while len(front) and (most is None or level < most):
            level += 1
            spans = begin[front + 1] - begin[front]
            ends = np.cumsum(spans)
            near = nbrs[np.repeat(begin[front] - (ends - spans), spans) + np.arange(ends[-1])]
            dist[near[dist[near] < 0]] = level
            front = np.flatnonzero(dist == level)
        reached = np.flatnonzero(dist >= 0)
        return ids[reached], dist[reached]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                nodes, dist = walk(s) if s is not None else (np.array([None]), np.zeros(1, np.int32))
                for lo in range(0, len(nodes), 500_000):
                    part = pa.array(nodes[lo : lo + 500_000], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([s] * len(part), pa.int64()), part, pa.array(dist[lo : lo + 500_000])], names=["source", "node", "dist"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    out = sources.select(F.col("source").cast("long")).distinct().repartition(parts).mapInArrow(run, "source long, node long, dist int")
    return out.select(F.col("source").cast(sources.schema["source"].dataType), F.col("node").cast(kind), "dist")


def within_hops(dist: DataFrame, hops: int) -> DataFrame:
    return dist.where(F.col("dist") <= hops)


def hop_accuracy(dist: DataFrame, answers: DataFrame, hops: list[int]) -> DataFrame:
    """(hops, share): how many (source, node) answers lie within so many hops; an unreached one in none."""
    if answers.count() <= ANSWERS:  # the distances stay where they are, those of answers are picked out
        dist = cut(dist.join(F.broadcast(answers.select("source", "node").distinct()), ["source", "node"], "left_semi"))
    joined = answers.join(dist, ["source", "node"], "left")
    limits = joined.withColumn("hops", F.explode(F.array(*map(F.lit, hops))))
    return limits.groupBy("hops").agg(F.avg(F.coalesce(F.col("dist") <= F.col("hops"), F.lit(False)).cast("double")).alias("share"))


def shape(dist: DataFrame) -> DataFrame:
    """(radius, diameter, centres) from all distances; unreached pairs do not count."""
    far = cut(dist.groupBy("source").agg(F.max("dist").alias("ecc")))
    ends = far.agg(F.min("ecc").alias("radius"), F.max("ecc").alias("diameter"))
    return far.crossJoin(F.broadcast(ends)).groupBy("radius", "diameter").agg(F.count_if(F.col("ecc") == F.col("radius")).alias("centres"))


def spanning_weights(pairs: DataFrame, group: str) -> DataFrame:
    """(group, weights): sorted weights of a minimum spanning forest of each group's (a, b, w) pairs."""

    def prim(rows: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        got = []
        for a, b, w in rows.sort_values(["w", "a", "b"])[["a", "b", "w"]].itertuples(index=False):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                got.append(float(w))
        return pd.DataFrame({group: [rows[group].iloc[0]], "weights": [np.array(got)]})

    kind = pairs.schema[group].dataType.simpleString()
    return pairs.select(group, "a", "b", F.col("w").cast("double").alias("w")).groupBy(group).applyInPandas(prim, f"`{group}` {kind}, weights array<double>")


def tables(edges: DataFrame, vectors: DataFrame, scores: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph to keep: edges with the distance of their ends, nodes with the sum of their scores and whether a top list has them."""
    a, b = vectors.select(F.col("id").alias("src"), F.col("e").alias("x")), vectors.select(F.col("id").alias("dst"), F.col("e").alias("y"))
    from rankweave.functions.vectors import l2

    long_edges = edges.join(a, "src").join(b, "dst").select("src", "dst", l2(F.col("x"), F.col("y")).alias("weight"))
    sums = scores.groupBy(F.col("item_id").alias("id")).agg(F.sum("score").alias("score_sum"))
    marked = top.select(F.col("item_id").alias("id")).distinct().withColumn("in_top", F.lit(True))
    nodes = vectors.select("id").join(sums, "id", "left").join(marked, "id", "left")
    return long_edges, nodes.select("id", "score_sum", F.coalesce("in_top", F.lit(False)).alias("in_top"))


def random_entries(queries: DataFrame, ids: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """(query_id, item_id): the same ``n`` random nodes to start from for every query."""
    some = ids.select(F.col(id_col).alias("item_id")).orderBy(key(seed, F.col("item_id")), "item_id").limit(n)
    return queries.select("query_id").crossJoin(F.broadcast(some))

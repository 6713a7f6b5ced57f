"""Choice of an index for nearest items: exact by blocks, or cells of a k-means."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.sampling import key
from rankweave.functions.vectors import cosine, dot, l2
from rankweave.operators.scoring import ranked, topk

EXACT_UP_TO = 11_000  #: vectors up to which an exact index is taken
SAMPLE = 50_000


def plan_index(n: int, force_exact: bool = False, probe_mult: float = 1.0) -> tuple[str, int, int]:
    """(kind, cells, probes) for n vectors: exact, or the root of n cells of which the root times a factor are probed."""
    if force_exact or n <= EXACT_UP_TO:
        return "exact", 0, 0
    cells = int(math.sqrt(n))
    return "ivf", cells, max(1, int(math.sqrt(cells) * probe_mult))


def ivf_topk(queries: DataFrame, items: DataFrame, k: int, cells: int, probes: int, metric: str = "ip", seed: int = 1, exclude_self: bool = True) -> DataFrame:
    """Each query's k best items within its ``probes`` nearest cells.

    Centres come from a bounded sample; every item is in a cell.  Queries meet items on the cell.
    """
    n = items.count()
    part = items if n <= SAMPLE else items.where(F.substring(key(seed, F.col("item_id")), 1, 6) < f"{int(SAMPLE / n * 0xFFFFFF):06x}")
    model = KMeans(k=min(cells, max(2, n)), seed=seed, featuresCol="v", maxIter=15).fit(part.select(array_to_vector("e").alias("v")))
    centres = items.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, c array<double>")
    placed = model.transform(items.select("item_id", "e", array_to_vector("e").alias("v"))).select("item_id", "e", F.col("prediction").alias("cell"))
    near = topk(queries, centres.select(F.col("cell").cast("long").alias("item_id"), F.col("c").alias("e")), probes, "l2", exclude_self=False)
    asked = near.select("query_id", F.col("item_id").cast("int").alias("cell")).join(queries.select("query_id", F.col("e").alias("q")), "query_id")
    score = {"ip": dot, "cosine": cosine, "l2": lambda a, b: -l2(a, b)}[metric](F.col("q"), F.col("e"))
    pairs = asked.join(placed, "cell")
    if exclude_self:
        pairs = pairs.where("query_id <> item_id")
    return ranked(pairs.select("query_id", "item_id", score.alias("score")), k)


def nearest(queries: DataFrame, items: DataFrame, k: int, metric: str = "ip", index: str = "auto", exclude_self: bool = True) -> DataFrame:
    """(query_id, rk, item_id, score) by the index that ``plan_index`` chooses, or the one asked for."""
    kind, cells, probes = plan_index(items.count(), index == "exact")
    if index == "ivf" and kind == "exact":
        n = items.count()
        kind, cells, probes = "ivf", max(2, int(math.sqrt(n))), max(1, int(math.sqrt(math.sqrt(n))))
    if kind == "exact":
        return topk(queries, items, k, metric, exclude_self=exclude_self)
    return ivf_topk(queries, items, k, cells, probes, metric, exclude_self=exclude_self)

"""Negative sampling, splits, and the assembly of training rows.

Random choices order or draw by hashes of seed and ids, so they repeat on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.sampling import key, uniform
from rankweave.operators.joins import without
from rankweave.operators.ordering import ordinals
from rankweave.operators.scoring import gather, ranked


def random_negatives(queries: DataFrame, items: DataFrame, positives: DataFrame, n: int, seed: int, blacklist: DataFrame | None = None) -> DataFrame:
    """(query_id, rk, neg_id): n random items of each query that are neither its positives nor black-listed.

    Draws name items by hashed ordinals, so no pairs of all queries and items are formed; there are
    enough draws for the longest list of excluded items of a query.
    """
    numbered = ordinals(items.select("item_id"), "item_id")
    total = numbered.count()
    excluded = positives.select("query_id", "item_id")
    if blacklist is not None:
        excluded = excluded.unionByName(blacklist.select("query_id", "item_id"))
    excluded = excluded.distinct()
    most = excluded.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    draws = 4 * n + 24 + int(4.0 * n * most / max(1, total - most))
    drawn = queries.select("query_id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("ordinal", F.floor(uniform(seed, F.col("query_id"), F.col("draw")) * total).cast("long"))
    named = drawn.join(numbered, "ordinal").groupBy("query_id", "item_id").agg(F.min("draw").alias("draw"))
    kept = without(named, excluded)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("draw"))
    return kept.withColumn("rk", nth).where(F.col("rk") <= n).select("query_id", "rk", F.col("item_id").alias("neg_id"))


def hard_negatives(candidates: DataFrame, positives: DataFrame, n: int) -> DataFrame:
    """(query_id, rk, neg_id, score): each query's n best candidates that are no positives.

    ``candidates`` is a ranked list of at least n plus the positives' number.
    """
    kept = ranked(without(candidates.drop("rk"), positives), n)
    return kept.select("query_id", "rk", F.col("item_id").alias("neg_id"), "score")


def reranked_negatives(candidates: DataFrame, positives: DataFrame, exact: DataFrame | None, first: int, n: int) -> DataFrame:
    """The n best by exact score among the ``first`` hard negatives; without a scorer the first n."""
    hard = hard_negatives(candidates, positives, first)
    if exact is None:
        return hard.where(F.col("rk") <= n)
    again = ranked(gather(hard.select("query_id", F.col("neg_id").alias("item_id")), exact), n)
    return again.select("query_id", "rk", F.col("item_id").alias("neg_id"), "score")


def with_distance(negatives: DataFrame, positives: DataFrame, dist: DataFrame) -> DataFrame:
    """Negatives with the number of nodes on a shortest path to the positive, null if there is none."""
    pos = positives.select("query_id", F.col("item_id").alias("source"))
    joined = negatives.join(pos, "query_id").join(dist.select("source", F.col("node").alias("neg_id"), "dist"), ["source", "neg_id"], "left")
    return joined.groupBy("query_id", "rk", "neg_id").agg((F.min("dist") + 1).alias("nodes"))


def weighted_ball(dist: DataFrame, positives: DataFrame, degree: int, n: int, seed: int) -> DataFrame:
    """(query_id, rk, neg_id, dist): n nodes around the positive, drawn without replacement with weights degree^-dist."""
    pos = positives.select("query_id", F.col("item_id").alias("source"))
    ball = dist.where("dist > 0").join(pos, "source")
    draw = F.log(uniform(seed, F.col("query_id"), F.col("node"))) * F.pow(F.lit(float(degree)), F.col("dist"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(draw.desc(), "node"))
    return ball.withColumn("rk", nth).where(F.col("rk") <= n).select("query_id", "rk", F.col("node").alias("neg_id"), "dist")


def path_steps(paths: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(query_id, step, node, pos_id, neg_ids): along each path the next node against the current node and its other neighbours.

    ``paths`` is (query_id, step, node); negatives are cycled or cut to n.
    """
    from rankweave.functions.texts import cycled

    next_node = F.lead("node").over(Window.partitionBy("query_id").orderBy("step"))
    steps = paths.withColumn("pos_id", next_node).where("pos_id is not null")
    near = edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("nbrs"))
    joined = steps.join(near, steps["node"] == near["src"], "left")
    others = F.concat(F.array("node"), F.filter(F.coalesce("nbrs", F.array().cast("array<long>")), lambda x: x != F.col("pos_id")))
    return joined.select("query_id", "step", "node", "pos_id", cycled(others, n).alias("neg_ids"))


def triplets(scores: DataFrame, n_pos: int, n_neg: int, k: int) -> DataFrame:
    """(query_id, pos_id, neg_id): each query's first n_pos items against those of rank k-n_neg+1 to k."""
    top = ranked(scores, k)
    pos = top.where(F.col("rk") <= n_pos).select("query_id", F.col("item_id").alias("pos_id"))
    neg = top.where(F.col("rk") > k - n_neg).select("query_id", F.col("item_id").alias("neg_id"))
    return pos.join(neg, "query_id").where("pos_id <> neg_id")


def split_train_dev(rows: DataFrame, id_col: str, dev_share: float, seed: int) -> DataFrame:
    """Rows with ``part``: the first ceil(n(1-f)) in hashed order are train, the others dev."""
    numbered = ordinals(rows.withColumn("_k", F.concat(key(seed, F.col(id_col)), F.lit(":"), F.col(id_col).cast("string"))), "_k")
    n = rows.count()
    bar = F.ceil(F.lit(n) * F.lit(1 - dev_share))
    return numbered.withColumn("part", F.when(F.col("ordinal") < bar, "train").otherwise("dev")).drop("_k", "ordinal")


def repeated_splits(ids: DataFrame, id_col: str, splits: int, train_share: float, seed: int) -> DataFrame:
    """(split, id, part) for several independent splits, each id by its own hash."""
    many = ids.select(id_col).withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    return many.select("split", id_col, F.when(uniform(seed, F.col("split"), F.col(id_col)) < train_share, "train").otherwise("test").alias("part"))


def flattened(queries: DataFrame, labels: str = "label_idxs") -> DataFrame:
    """One row for each query and positive label."""
    return queries.select("query_id", F.explode(labels).alias("item_id"))


def chunked(queries: DataFrame, most: int, labels: str = "label_idxs") -> DataFrame:
    """Positives kept together, at most so many to a row."""
    flat = queries.select("query_id", F.posexplode(labels).alias("p", "x")).withColumn("chunk", F.floor(F.col("p") / most).cast("int"))
    return flat.groupBy("query_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("labels"))


def negative_batches(negatives: DataFrame, size: int) -> DataFrame:
    """(query_id, batch, neg_ids): ranked negatives in rows of ``size``."""
    rows = negatives.withColumn("batch", F.floor((F.col("rk") - 1) / size).cast("int"))
    return rows.groupBy("query_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "neg_id"))), lambda s: s["neg_id"]).alias("neg_ids"))


def labelled_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(query_id, item_id, label): positives with 1, negatives with 0."""
    return positives.select("query_id", "item_id", F.lit(1).alias("label")).unionByName(negatives.select("query_id", F.col("neg_id").alias("item_id"), F.lit(0).alias("label")))


def ids_of_tokens(tokens: DataFrame) -> DataFrame:
    """(ids, item_id): the item of a token sequence, the last of several."""
    return tokens.groupBy("ids").agg(F.max("id").alias("item_id"))


STRATEGIES = {
    "random": random_negatives, "hard": hard_negatives, "reranked": reranked_negatives, "distance": with_distance, "ball": weighted_ball, "path": path_steps, "triplets": triplets,
}

"""Beam search over a neighbour graph under a budget of scored items, all queries at once.

The state of all queries is one table of scored nodes; each round joins the beams with the edges,
drops what is scored, scores the rest, and keeps the round's best as the next beam.  Rounds are cut
from their lineage, and the loop ends when no query goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.scoring import ranked
from rankweave.session import cut

Scorer = Callable[[DataFrame], DataFrame]  #: (query_id, item_id) pairs to the same with a score


def lookup(scores: DataFrame) -> Scorer:
    """A scorer that looks pairs up; a pair without a score gets none and is dropped."""
    return lambda pairs: pairs.join(scores.select("query_id", "item_id", "score"), ["query_id", "item_id"])


@dataclass
class Plan:
    k: int = 10
    beam: int = 10
    budget: int = 1 << 30
    mode: str = "hard"  #: the budget cuts a round short, or with ``soft`` is only looked at before one
    rounds: int = 1000
    stop_at_local_optimum: bool = True
    backtrack: bool = False  #: the next beam comes from all scored nodes that were not expanded yet
    shortlist: int = 0  #: score only so many new nodes a round, those with the best cheap scores


def beam_search(entries: DataFrame, edges: DataFrame, score: Scorer, plan: Plan, cheap: DataFrame | None = None, masked: DataFrame | None = None, soft_mask: bool = False, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, rk, item_id, score) and (query_id, n_scored, rounds).

    ``entries`` are the start pairs.  ``masked`` pairs are left out or, with ``soft_mask``, get their
    cheap score, which costs nothing.  ``cheap`` holds such scores (query_id, item_id, score).
    ``kept`` says the same as ``masked`` the other way round: all other items of a query that is named in it are left out.
    """
    if kept is not None:
        kept = cut(kept.select("query_id", "item_id").distinct())
        named = cut(kept.select("query_id").distinct())
    beam_size = min(plan.beam, plan.budget)
    graph = cut(edges.select("src", F.col("dst").alias("nbr"), "pos"))
    start = entries.select("query_id", "item_id").distinct()
    start = start.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("item_id"))).where(F.col("at") <= plan.budget)
    seen = cut(score(start.select("query_id", "item_id")).withColumn("round", F.lit(0)).withColumn("cost", F.lit(1)))
    expanded = None
    front = cut(ranked(seen, beam_size).select("query_id", "item_id", "rk"))
    for step in range(1, plan.rounds + 1):
        paid = seen.groupBy("query_id").agg(F.sum("cost").alias("paid"))
        worst = ranked(seen, plan.k).groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("have"))
        open_ = front.join(paid.where(F.col("paid") < plan.budget), "query_id")
        reached = open_.withColumnRenamed("item_id", "src").join(graph, "src").select("query_id", F.col("nbr").alias("item_id"), "paid", "rk", "pos")
        first = reached.groupBy("query_id", "item_id").agg(F.min(F.struct("rk", "pos")).alias("o"), F.first("paid").alias("paid"))
        new = first.join(seen.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
        free = None
        if masked is not None:
            hidden = masked.select("query_id", "item_id").distinct()
            if soft_mask and cheap is not None:
                free = new.join(hidden, ["query_id", "item_id"], "left_semi").join(cheap, ["query_id", "item_id"]).select("query_id", "item_id", "score")
            new = new.join(hidden, ["query_id", "item_id"], "left_anti")
        if kept is not None:
            new = new.join(kept, ["query_id", "item_id"], "left_semi").unionByName(new.join(named, "query_id", "left_anti"))
        if plan.shortlist and cheap is not None:
            short = ranked(new.join(cheap.select("query_id", "item_id", "score"), ["query_id", "item_id"]), plan.shortlist)
            new = new.join(short.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi")
        if plan.mode == "hard":
            nth = F.row_number().over(Window.partitionBy("query_id").orderBy("o.rk", "o.pos", "item_id"))
            new = new.withColumn("nth", nth).where(F.col("nth") <= plan.budget - F.col("paid"))
        scored = score(new.select("query_id", "item_id")).withColumn("cost", F.lit(1))
        if free is not None:
            scored = scored.unionByName(free.withColumn("cost", F.lit(0)))
        scored = cut(scored.withColumn("round", F.lit(step)).select("query_id", "item_id", "score", "round", "cost"))
        if scored.isEmpty():
            break
        gone_on = scored.groupBy("query_id").agg(F.max("score").alias("best")).join(worst, "query_id", "left")
        if plan.stop_at_local_optimum:
            gone_on = gone_on.where((F.col("have") < plan.k) | (F.col("best") >= F.col("worst")))
        if plan.backtrack:
            expanded = front.select("query_id", "item_id") if expanded is None else cut(expanded.unionByName(front.select("query_id", "item_id")))
            pool = seen.select("query_id", "item_id", "score").unionByName(scored.select("query_id", "item_id", "score")).join(expanded, ["query_id", "item_id"], "left_anti")
        else:
            pool = scored
        seen = cut(seen.select("query_id", "item_id", "score", "round", "cost").unionByName(scored))
        front = cut(ranked(pool.join(gone_on.select("query_id"), "query_id", "left_semi"), beam_size).select("query_id", "item_id", "rk"))
        if front.isEmpty():
            break
    costs = seen.groupBy("query_id").agg(F.sum("cost").alias("n_scored"), F.max("round").alias("rounds"))
    return ranked(seen.select("query_id", "item_id", "score"), plan.k), costs


def descend(entries_top: DataFrame, level_edges: DataFrame, score: Scorer, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Search through the levels of a hierarchical graph (level, src, dst, pos), from the top.

    Upper levels use a beam of 2 at most and start the one below with what they found.
    """
    top = level_edges.agg(F.max("level")).first()[0]
    entries, spent = entries_top, None
    for level in range(top or 0, -1, -1):
        here = plan if level == 0 else Plan(k=min(2, plan.beam), beam=min(2, plan.beam), budget=plan.budget, mode=plan.mode, rounds=plan.rounds)
        found, cost = beam_search(entries, level_edges.where(F.col("level") == level), score, here)
        entries = cut(found.select("query_id", "item_id"))
        spent = cost if spent is None else cut(spent.unionByName(cost).groupBy("query_id").agg(F.sum("n_scored").alias("n_scored"), F.sum("rounds").alias("rounds")))
    return found, spent


def with_gold(entries: DataFrame, gold: DataFrame) -> DataFrame:
    """Entry pairs with each query's gold item among them; a switch for experiments, never the default."""
    return entries.select("query_id", "item_id").unionByName(gold.select("query_id", F.col("gold").alias("item_id"))).distinct()

"""Queries that get their rows without the matrix of all pairs, or the graph without cells, give what the formed ones give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions.sampling import key
from rankweave.operators import approx, composed, graphs, index, scoring, search
from rankweave.plans import catalogue, common, graph
from tests.compare import spark_rows


def _no(*_, **__):
    raise AssertionError("not to be formed")


@pytest.fixture
def pairs(spark, data):
    return common.scored(spark, data)


def test_fixed_anchors(spark):
    rows = [(q, i, (q * 3 + i * 7) % 10 / 8 - 0.5) for q in range(0, 40, 4) for i in range(40) if q != i]
    theirs = [(a, b, (a * b) % 7 / 4 - 0.7) for a in range(40) for b in (4, 8) if a != b]
    scores, item_scores = spark.createDataFrame(rows, "query_id long, item_id long, score double"), spark.createDataFrame(theirs, "item_x long, item_y long, score double")
    anchors = spark.createDataFrame([(4,), (8,)], "item_id long")  # 4 and 8 have no anchor in common
    formed = approx.fixed_anchor_scores(scores, item_scores, anchors).withColumn("score", F.round("score", 9))
    for k in (3, 40):
        assert spark_rows(approx.fixed_anchor_topk(scores, item_scores, anchors, k)) == spark_rows(scoring.ranked(formed, k))


def test_sparsify_orders_few_cells(spark, data, monkeypatch):
    rows = spark.createDataFrame([(q, i) for q in (1, 2, None) for i in range(600 if q == 1 else 15)], "query_id long, item_id long").withColumn("score", F.col("item_id") * 0.5)
    nth = F.row_number().over(approx.Window.partitionBy("query_id").orderBy(key(8, F.col("query_id"), F.col("item_id")), "item_id"))
    assert spark_rows(approx.sparsify(rows, 20, 8)) == spark_rows(rows.withColumn("n", nth).where("n <= 20").drop("n"))
    monkeypatch.setattr(approx, "key", lambda *_: F.when(F.col("item_id") % 50 == 1, F.lit("0")).otherwise("f"))  # too few below the bar
    assert approx.sparsify(rows, 20, 8).where("query_id = 1").count() == 20
    monkeypatch.undo()
    assert "MapInArrow" not in catalogue.QUERIES["sparsify"](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def _both(pairs):
    rows = pairs.rows()
    chosen = approx.anchors(pairs.ids("item_id"), 12, 2, "item_id")
    some = pairs.only(pairs.ids("query_id").where("query_id % 40 = 0"))
    return approx.Cur(some, some.ids("query_id"), chosen), approx.Cur(rows.where("query_id % 40 = 0"), some.ids("query_id"), chosen), rows


def test_assess_is_evaluate(pairs):
    made, formed, rows = _both(pairs)
    assert spark_rows(approx.assess(made, pairs, 5, 20)) == spark_rows(approx.evaluate(formed.complete(rows), rows, 5, 20))


@pytest.mark.parametrize("name", ["cur_full", "mined_by_cur"])
def test_cur_multiplies_where_it_scores(spark, data, monkeypatch, name):
    for owner, what in ((approx.Cur, "complete"), (approx, "gather"), (approx, "evaluate"), (common, "matrix"), (graph, "pairs")):
        monkeypatch.setattr(owner, what, _no)
    vectors = approx.vectors
    monkeypatch.setattr(approx, "vectors", lambda s, by, over: _no() if by == "item_id" else vectors(s, by, over))
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_grid_forms_no_matrix(spark, data, monkeypatch):
    for owner, what in ((approx.Cur, "complete"), (approx, "gather"), (approx, "evaluate"), (common, "matrix")):
        monkeypatch.setattr(owner, what, _no)
    assert catalogue.QUERIES["approximation_grid"](spark, data).count() == 6


def test_anchor_products(spark, data, pairs):
    formed = approx.anchor_embeddings(scoring.matrix(pairs.queries, pairs.items, {"score": "ip"}))
    q = pairs.queries
    old = scoring.topk(formed.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id"), formed, 3).withColumn("score", F.round("score", 6))
    new = scoring.topk(*approx.anchor_products(q, pairs.items, q), 3).withColumn("score", F.round("score", 6))
    assert spark_rows(old) == spark_rows(new)


def test_entry_points_form_no_embeddings(spark, data, monkeypatch):
    monkeypatch.setattr(approx, "anchor_embeddings", _no)
    assert catalogue.QUERIES["entry_points"](spark, data).count() == 375


def test_graphs_are_exact(spark, data, monkeypatch):
    monkeypatch.setattr(index, "EXACT_UP_TO", 100)
    monkeypatch.setattr(index, "ivf_topk", _no)
    vectors = common.nodes(spark, data).select("id", "e")
    assert composed.graph("knn", vectors, 8).count() == 4000
    assert composed.graph("hnsw", vectors, 6, 3).where("level = 0").count() == 3000


def test_exhaustive_ranks_are_those_of_the_formed_pairs(spark, monkeypatch):
    vectors = [(i, [float((i * a) % 7 - 3) for a in (1, 2, 3, 5)], i % 6) for i in range(60)] + [(60 + i, [0.5, 1.0, -2.0, 1.0], 1) for i in range(9)]
    items = spark.createDataFrame(vectors, "item_id long, e array<double>, label int").repartition(3)
    asked = items.where("item_id % 4 = 0").withColumnRenamed("item_id", "query_id")
    gold = asked.select("query_id", ((F.col("query_id") * 5 + 3) % 69).alias("gold")).where("query_id <> gold")
    pairs = scoring.matrix(asked, items, {"score": "ip", "cheap": scoring.first_dims(2)}).where("query_id <> item_id")
    formed = composed.exhaustive_reciprocal_ranks(scoring.ranked(pairs.select("query_id", "item_id", F.col("cheap").alias("score"))), pairs, gold, 10)
    expected = spark_rows(formed)
    monkeypatch.setattr(scoring, "matrix", _no)
    monkeypatch.setattr(scoring, "QUERY_BLOCK", 7)
    assert spark_rows(composed.exhaustive_ranks(scoring.Pairs(asked, items), 2, gold, 10)) == expected
    assert len({r for r in expected[1] if "True" in r}) > 1


def test_exhaustive_rerank_forms_no_pairs(spark, data, monkeypatch):
    monkeypatch.setattr(common, "matrix", _no)
    monkeypatch.setattr(scoring, "matrix", _no)
    assert catalogue.QUERIES["exhaustive_rerank"](spark, data).count() > 0


@pytest.mark.parametrize("strategy", ["approx_topk", "variance", "random"])
@pytest.mark.parametrize("n_train", [1, 6])
def test_incremental_cur_of_pairs_forms_no_rows(spark, monkeypatch, strategy, n_train):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 8)))], "item_id long, e array<double>")
    asked = items.where("item_id % 4 = 0").withColumnRenamed("item_id", "query_id")
    train, test = (scoring.Pairs(asked.where(f"query_id {side} {4 * n_train}"), items) for side in ("<", ">="))
    drop = 0 if n_train == 1 else -1  # the only anchor query's own item has no column
    formed = approx.incremental_cur(test.rows().where(f"item_id <> {drop}"), train.rows(), 12, 3, 7, strategy, 5)
    expected = spark_rows(formed)
    for owner, what in ((scoring, "matrix"), (approx, "dense"), (scoring.Pairs, "rows")):
        monkeypatch.setattr(owner, what, _no)
    assert spark_rows(approx.incremental_cur(test, train, 12, 3, 7, strategy, 5)) == expected


def test_kept_items_are_those_not_masked(spark):
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 6)))], "item_id long, e array<double>")
    asked = items.where("item_id % 4 = 0").withColumnRenamed("item_id", "query_id")
    train, test = (scoring.Pairs(asked.where(f"query_id {side} 28"), items) for side in ("<", ">="))
    edges = graphs.knn_graph(items.withColumnRenamed("item_id", "id"), 6, index="exact")
    start = composed.entries("random", test.ids("query_id"), items, 3, seed=1)
    explored = test.rows().where("item_id % 3 = 0 and query_id <> 40 or item_id = 7")  # 40 has too few
    formed = composed.adaptive_scores(explored, train.rows(), 5)
    best = composed.adaptive_scores(explored, train, 5, keep=15)
    assert spark_rows(best.select("query_id", "item_id")) == spark_rows(scoring.ranked(formed, 15).select("query_id", "item_id"))
    plan = search.Plan(k=5, beam=4, budget=30)
    masked = search.beam_search(start, edges, search.lookup(test.rows()), plan, formed, composed.adaptive_mask(formed, 15))
    kept = search.beam_search(start, edges, search.lookup(test.rows()), plan, kept=best)
    assert [spark_rows(a) for a in kept] == [spark_rows(a) for a in masked]


def test_masked_search_forms_no_scores(spark, data, monkeypatch):
    for owner, what in ((scoring, "matrix"), (approx, "dense"), (composed, "adaptive_mask")):
        monkeypatch.setattr(owner, what, _no)
    assert catalogue.QUERIES["masked_search"](spark, data).count() > 0


def test_method_errors_are_those_of_the_formed_matrices(spark, monkeypatch):
    rng = np.random.default_rng(6)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 5)))], "item_id long, e array<double>")
    asked = items.where("item_id % 4 = 0").withColumnRenamed("item_id", "query_id")
    train, test = (scoring.Pairs(asked.where(f"query_id {side} 44"), items) for side in ("<", ">="))
    expected = approx.method_errors(train, test, 8, 4)
    for owner, what in ((scoring, "matrix"), (approx, "dense"), (approx, "block"), (scoring.Pairs, "rows")):
        monkeypatch.setattr(owner, what, _no)
    monkeypatch.setattr(approx, "STRIP", 16)
    got = approx.method_errors(train, test, 8, 4, formed=0)
    assert [g[0] for g in got] == [e[0] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[1:] == pytest.approx(e[1:], rel=1e-6, abs=1e-9), g[0]

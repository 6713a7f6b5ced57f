import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions import texts, vectors
from rankweave.operators.ordering import ordinals, running_total
from rankweave.operators import aggregates, approx, graphs, index, joins, lexical, losses, metrics, negatives, report, scoring, search, sequence, setops, significance, tree


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6))
    return x, frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")


SCORES = [(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.1), (1, 5, 0.0), (2, 1, 0.2), (2, 2, 0.8), (2, 3, 0.6), (2, 4, 0.4), (2, 5, 0.3), (3, 1, 0.1), (3, 2, 0.2), (3, 3, 0.3), (3, 4, 0.4), (3, 5, 0.5)]


def test_ranks_break_ties_by_item(spark):
    s = frame(spark, SCORES, "query_id long, item_id long, score double")
    top = {(r.query_id, r.rk): r.item_id for r in scoring.ranked(s, 3).collect()}
    assert [top[1, k] for k in (1, 2, 3)] == [1, 2, 3]
    gold = frame(spark, [(1, 1), (2, 4), (3, 1)], "query_id long, gold long")
    rr = {r.query_id: r.rr for r in metrics.reciprocal_rank(scoring.ranked(s, 3), gold).collect()}
    assert rr == {1: 1.0, 2: pytest.approx(1 / 3), 3: 0.0}
    m = metrics.rank_metrics(scoring.ranked(s, 3), gold).first()
    assert (m.acc, m.recall, m.norm_acc) == (33.33, 66.67, 50.0)
    none = metrics.rank_metrics(scoring.ranked(s.where("query_id = 3"), 1), frame(spark, [(3, 1)], "query_id long, gold long")).first()
    assert none.norm_acc is None and none.acc == 0.0


def test_topk_equals_numpy_in_several_blocks(spark, clouds, monkeypatch):
    x, df = clouds
    monkeypatch.setattr(scoring, "query_blocks", lambda q, i, v, size=7, f=scoring.query_blocks: f(q, i, v, 7))
    items = df.withColumnRenamed("id", "item_id").repartition(5)
    found = scoring.topk(df.where("id < 30").withColumnRenamed("id", "query_id"), items, 4).collect()
    s = x[:30] @ x.T
    s[np.arange(30), np.arange(30)] = -np.inf
    assert {(r.query_id, r.rk): r.item_id for r in found} == {(q, k + 1): int(i) for q in range(30) for k, i in enumerate(np.argsort(-s[q])[:4])}
    assert scoring.topk(df.where("id < 0").withColumnRenamed("id", "query_id"), items, 4).count() == 0
    assert scoring.topk(df.where("id < 3").withColumnRenamed("id", "query_id"), items.where("item_id < 0"), 4).count() == 0


def test_index_choice_and_probing_all_cells_is_exact(spark, clouds):
    assert index.plan_index(11_000)[0] == "exact" and index.plan_index(11_001)[0] == "ivf"
    assert index.plan_index(1_000_000, force_exact=True)[0] == "exact"
    _, df = clouds
    q, i = df.where("id < 10").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "item_id")
    a = {(r.query_id, r.rk, r.item_id) for r in index.ivf_topk(q, i, 5, 6, 6).collect()}
    assert a == {(r.query_id, r.rk, r.item_id) for r in scoring.topk(q, i, 5).collect()}


def test_cur_reproduces_a_matrix_that_its_anchors_span(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(6, 2)) @ rng.normal(size=(2, 8))
    s = frame(spark, [(i, j, float(m[i, j])) for i in range(6) for j in range(8)], "query_id long, item_id long, score double")
    for prefer in ("rows", "cols"):
        made = approx.Cur(s, frame(spark, [(0,), (3,)], "query_id long"), frame(spark, [(1,), (5,)], "item_id long"), prefer)
        for r in made.complete(s).collect():
            assert r.score == pytest.approx(m[r.query_id, r.item_id], abs=1e-9)
    zero = s.withColumn("score", F.lit(0.0))
    made = approx.Cur(zero, frame(spark, [(0,)], "query_id long"), frame(spark, [(1,)], "item_id long"))
    assert {r.score for r in made.complete(zero).collect()} == {0.0}
    cols = np.array([1, 5, 6])
    for method in ("cur", "svd_linreg", "cur_linreg", "cur_oracle", "svd_oracle", "svd_linreg_well_cond"):
        assert approx.approximate(method, m[:4], m[4:], cols, 2) == pytest.approx(m[4:], abs=1e-4)
    assert approx.error_norms(m, m)["rank"] == 2
    with pytest.raises(ValueError):
        approx.approximate("none", m, m, cols)


def test_incremental_cur_scores_no_more_than_asked(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(8, 3)) @ rng.normal(size=(3, 40))
    s = frame(spark, [(i, j, float(m[i, j])) for i in range(8) for j in range(40)], "query_id long, item_id long, score double")
    for strategy in ("random", "approx_topk", "approx_softmax", "variance"):
        rows = approx.incremental_cur(s.where("query_id >= 5"), s.where("query_id < 5"), 12, 3, 7, strategy, 5).collect()
        assert len(rows) == 15 and {r.n_scored for r in rows} == {12}
        assert all(r.score == pytest.approx(m[r.query_id, r.item_id]) for r in rows)
        again = approx.incremental_cur(s.where("query_id >= 5"), s.where("query_id < 5"), 12, 3, 7, strategy, 5).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    best = approx.incremental_cur(s.where("query_id >= 5"), s.where("query_id < 5"), 12, 3, 7, "approx_topk", 1).collect()
    assert all(r.item_id == int(np.argmax(m[r.query_id])) for r in best)  # the rank is 3, so that a few anchors tell all


def chain(spark, n=10):
    return frame(spark, [(i, i + 1, 1) for i in range(n - 1)], "src long, dst long, pos int")


def test_distances_on_a_chain_and_in_two_parts(spark):
    d = graphs.distances(chain(spark), frame(spark, [(i,) for i in range(10)], "source long"))
    assert {(r.source, r.node): r.dist for r in d.collect()} == {(a, b): abs(a - b) for a in range(10) for b in range(10)}
    s = graphs.shape(d).first()
    assert (s.radius, s.diameter, s.centres) == (5, 9, 2)
    assert graphs.within_hops(d, 1).count() == 28
    parts = frame(spark, [(0, 1, 1), (2, 3, 1)], "src long, dst long, pos int")
    assert graphs.distances(parts, frame(spark, [(0,)], "source long")).count() == 2


def test_beam_search_budgets_masks_and_ends(spark):
    n = 6
    complete = frame(spark, [(a, b, b) for a in range(n) for b in range(n) if a != b], "src long, dst long, pos int")
    s = frame(spark, [(q, i, float((i * 7 + q) % n)) for q in range(3) for i in range(n)], "query_id long, item_id long, score double")
    entry = frame(spark, [(q, 0) for q in range(3)], "query_id long, item_id long")
    found, cost = search.beam_search(entry, complete, search.lookup(s), search.Plan(k=2, beam=3))
    exact = {(r.query_id, r.rk, r.item_id) for r in scoring.ranked(s, 2).collect()}
    assert {(r.query_id, r.rk, r.item_id) for r in found.collect()} == exact
    for budget in (1, 2, 4):
        cost = search.beam_search(entry, complete, search.lookup(s), search.Plan(k=2, beam=3, budget=budget))[1].collect()
        assert all(r.n_scored <= budget for r in cost)
    soft = search.beam_search(entry, complete, search.lookup(s), search.Plan(k=2, beam=3, budget=2, mode="soft"))[1].collect()
    assert {r.n_scored for r in soft} == {n}
    hidden = frame(spark, [(q, 5) for q in range(3)], "query_id long, item_id long")
    found = search.beam_search(entry, complete, search.lookup(s), search.Plan(k=6, beam=6), masked=hidden)[0]
    assert found.where("item_id = 5").count() == 0
    cheap = s.withColumn("score", F.lit(9.0))
    found, cost = search.beam_search(entry, complete, search.lookup(s), search.Plan(k=6, beam=6), cheap, hidden, soft_mask=True)
    assert {r.score for r in found.where("item_id = 5").collect()} == {9.0} and {r.n_scored for r in cost.collect()} == {n - 1}
    lone = search.beam_search(entry, complete.where("src > 99"), search.lookup(s), search.Plan(k=2))[0]
    assert lone.count() == 3
    up = frame(spark, [(0, i, float(i)) for i in range(10)], "query_id long, item_id long, score double")
    walked = search.beam_search(entry.where("query_id = 0"), chain(spark), search.lookup(up), search.Plan(k=1, beam=1, backtrack=True))[0]
    assert walked.first().item_id == 9
    assert search.with_gold(entry, frame(spark, [(0, 4)], "query_id long, gold long")).count() == 4


def test_tree_search_with_all_leaves_is_exact_and_ties_split(spark, clouds):
    x, df = clouds
    items = df.withColumnRenamed("id", "item_id")
    made, leaves = tree.build(items, 10, 6, 1)
    assert leaves.count() == len(x)
    found, cost = tree.search(df.where("id < 5").withColumnRenamed("id", "query_id"), made, leaves, 3, 64, 6)
    s = x[:5] @ x.T
    assert {(r.query_id, r.rk): r.item_id for r in found.collect()} == {(q, k + 1): int(i) for q in range(5) for k, i in enumerate(np.argsort(-s[q])[:3])}
    assert {r.n_scored for r in cost.collect()} == {len(x)}
    same = items.withColumn("e", F.array(F.lit(1.0), F.lit(0.0)))
    sizes = [r["count"] for r in tree.build(same, 10, 6, 1)[1].groupBy("leaf").count().collect()]
    assert max(sizes) < len(x)
    assert tree.build(items.where("item_id < 0"), 10, 3, 1)[1].count() == 0


def test_graph_builders(spark, clouds):
    _, df = clouds
    assert graphs.random_graph(df, 4, 1).groupBy("src").count().where("count <> 4").count() == 0
    assert graphs.random_graph(df, 4, 1).where("src = dst").count() == 0
    knn = graphs.knn_graph(df, 5)
    assert graphs.knn_graph(df, 5, "l2", drop_first=True).where("src = dst").count() == 0  # in space a point is its own nearest
    world = graphs.small_world(knn, graphs.random_graph(df, 9, 2), 5)
    assert world.groupBy("src").count().where("count <> 5").count() == 0
    assert graphs.small_world(knn, knn, 5, long_range=False).groupBy("src").count().where("count <> 4").count() == 0
    pairs = frame(spark, [(1, 0, 1, 1.0), (1, 1, 2, 2.0), (1, 0, 2, 5.0), (2, 4, 5, 3.0)], "g long, a long, b long, w double")
    assert {r.g: list(r.weights) for r in graphs.spanning_weights(pairs, "g").collect()} == {1: [1.0, 2.0], 2: [3.0]}
    assert [r.ordinal for r in ordinals(df.select("id"), "id").orderBy("id").collect()] == list(range(120))


def test_lexical_formulas(spark):
    docs = frame(spark, [(1, "Red apple apple"), (2, "red pear"), (3, "blue sky"), (4, "blue sea and sky")], "doc_id long, text string")
    asked = frame(spark, [(7, "APPLE unknown"), (8, "blue")], "query_id long, text string")
    s = {(r.query_id, r.item_id): r.score for r in lexical.tfidf_scores(docs, asked).collect()}
    apple, red = math.log(5 / 2) + 1, math.log(5 / 3) + 1
    assert s[7, 1] == pytest.approx(2 * apple / math.hypot(2 * apple, red))
    assert set(s) == {(7, 1), (8, 3), (8, 4)}
    b = {(r.query_id, r.item_id): r.score for r in lexical.bm25_scores(docs, asked).collect()}
    idf = math.log(4 - 1 + 0.5) - math.log(1.5)
    assert b[7, 1] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (11 / 4))))
    empty = lexical.tfidf_scores(docs.where("doc_id < 0"), asked)
    assert empty.count() == 0


def test_context_window_quotas(spark):
    def window(left, mention, right, room):
        row = spark.range(1).select(texts.context_window(F.array(*map(F.lit, left)) if left else F.array().cast("array<int>"), F.array(*map(F.lit, mention)) if mention else F.array().cast("array<int>"), F.array(*map(F.lit, right)) if right else F.array().cast("array<int>"), room).alias("w")).first()
        return list(row.w)

    assert window([1, 2, 3], [9], [4, 5, 6], 5) == [2, 3, 9, 4, 5]
    assert window([1], [9], [4, 5, 6, 7], 5) == [1, 9, 4, 5, 6]
    assert window([1, 2, 3, 4], [9], [], 4) == [2, 3, 4, 9]
    assert window([1, 2], [7, 8, 9], [3], 3) == [7, 8, 9]  # no room is left for either side
    assert window([], [], [1, 2], 1) == [1]


def test_text_expressions_with_nulls(spark):
    df = frame(spark, [(None, None), ([], ""), ([5], "a b")], "ids array<int>, text string")
    rows = df.select(texts.fixed_length(F.col("ids"), 5, 1, 2).alias("f"), texts.words(F.col("text")).alias("w"), texts.cycled(F.col("ids"), 3).alias("c"), texts.padded_with_last(F.col("ids"), 2).alias("p")).collect()
    assert [list(r.f) if r.f else None for r in rows] == [None, [1, 2, 0, 0, 0], [1, 5, 2, 0, 0]]
    assert rows[1].c == [] and list(rows[2].c) == [5, 5, 5] and list(rows[2].p) == [5, 5]
    keys = frame(spark, [("x?curid=12", None), (" q ", None), (None, "d9"), ("y?curid=z", "k")], "i string, d string").select(texts.entity_key(F.col("i"), F.col("d")).alias("k"))
    assert [r.k for r in keys.collect()] == ["12", "q", "d9", "y?curid=z"]


def test_merge_and_union_assert_agreement(spark):
    a = frame(spark, [(1, 1, 0.5), (1, 2, 0.4)], "query_id long, item_id long, score double")
    b = frame(spark, [(1, 2, 0.40001), (1, 3, 0.1)], "query_id long, item_id long, score double")
    assert {(r.item_id, r.source) for r in joins.merge_candidates(a, b).collect()} == {(1, "left"), (2, "both"), (3, "right")}
    with pytest.raises(Exception, match="differ"):
        joins.merge_candidates(a, b.withColumn("score", F.lit(0.9))).collect()
    with pytest.raises(Exception, match="disagree"):
        setops.union_chunks([a, a.withColumn("score", F.lit(0.9))], ["query_id", "item_id"]).collect()
    empty = frame(spark, [(1, [])], "query_id long, indices array<long>")
    assert setops.overlap(empty, empty).first().common_frac == 0.0


def test_multi_gold_recall_denominators(spark):
    lists = frame(spark, [(q, k, 10 * q + k, 0.0) for q in (1, 2, 3) for k in (1, 2)], "query_id long, rk int, item_id long, score double")
    gold = frame(spark, [(2, 21), (3, 31), (3, 39), (3, 38)], "query_id long, item_id long")
    assert {r.k: r.recall for r in metrics.recall_at(lists, gold, [1, 2]).collect()} == {1: pytest.approx(2 / 3), 2: pytest.approx((0 + 1 + 0.5) / 3)}
    assert {r.k: r.precision for r in metrics.precision_at(lists, gold, [2]).collect()} == {2: pytest.approx(1 / 3)}


def test_significance_against_known_values(spark):
    a = [1, 1, 1, 0, 1, 1, 0, 1, 1, 1]
    b = [0, 1, 0, 0, 1, 0, 1, 0, 1, 0]
    p = frame(spark, [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "pair long, a int, b int")
    m = significance.mcnemar(p).first()
    assert (m.rr, m.rw, m.wr, m.ww, m.chi2) == (3, 5, 1, 1, pytest.approx(16 / 6))
    assert significance.chi2_1_p(3.841458820694124) == pytest.approx(0.05, abs=1e-6)
    assert significance.student_p(2.2621571628540993, 10) == pytest.approx(0.05, abs=1e-9)
    w = significance.wilcoxon(frame(spark, [(i, float(v), 0.0) for i, v in enumerate([1, -1, 2, 0, 3])], "pair long, a double, b double")).first()
    assert (w.n, w.w_plus, w.w_minus) == (4, 8.5, 1.5)
    same = p.withColumn("b", F.col("a"))
    assert significance.paired_t(same).first().t is None
    assert significance.permutation(same, 50, 1).first().p == 1.0
    assert significance.significance(same, "wilcoxon")[0] == 1.0
    with pytest.raises(ValueError):
        significance.significance(p, "none")


def test_viterbi_equals_trying_all_sequences(spark):
    rng = np.random.default_rng(2)
    p = rng.random((4, 3))
    p /= p.sum(1, keepdims=True)
    allowed = {(pos, t): [b for b in range(3) if rng.random() < 0.6] for pos in range(1, 4) for t in range(3)}
    probs = frame(spark, [(1, pos, t, float(p[pos, t])) for pos in range(4) for t in range(3)], "g int, pos int, token long, p double")
    pairs = frame(spark, [(pos, t, b) for (pos, t), b in allowed.items() if b], "pos int, token long, before array<long>")
    best = max((s for s in itertools.product(range(3), repeat=4) if all(s[i - 1] in allowed[i, s[i]] for i in range(1, 4))), key=lambda s: sum(math.log(p[i, t]) for i, t in enumerate(s)))
    got = sequence.viterbi(probs, pairs, "g").first()
    assert tuple(got.tokens) == best and got.log_p == pytest.approx(sum(math.log(p[i, t]) for i, t in enumerate(best)))


def test_losses_and_aggregates_on_small_rows(spark):
    row = frame(spark, [(1.0, [0.5, 2.0])], "pos double, negs array<double>").select(losses.cross_entropy(F.col("pos"), F.col("negs")).alias("ce"), losses.margin(F.col("pos"), F.col("negs"), 0.5).alias("m"), losses.mse(F.col("negs"), F.col("negs")).alias("z"), losses.distribution_cross_entropy(F.array(F.lit(0.5), F.lit(0.5)), F.col("negs")).alias("d")).first()
    assert row.ce == pytest.approx(math.log(math.exp(1) + math.exp(0.5) + math.exp(2)) - 1)
    assert row.m == pytest.approx(0.75) and row.z == 0.0
    assert row.d == pytest.approx(math.log(math.exp(0.5) + math.exp(2)) - 1.25)
    h = {r.bin: r.n for r in aggregates.histogram(frame(spark, [(0.0,), (0.49,), (0.5,), (1.0,), (None,), (7.0,)], "v double"), "v", 0.0, 1.0, 2).collect()}
    assert h == {0: 2, 1: 2}
    assert aggregates.errors(frame(spark, [], "query_id long, exact double, approx double")).first().l1 is None


def test_negatives(spark):
    q, items = frame(spark, [(i,) for i in range(20)], "query_id long"), frame(spark, [(i,) for i in range(60)], "item_id long")
    pos = frame(spark, [(i, j) for i in range(20) for j in range(i, i + 30)], "query_id long, item_id long")
    got = negatives.random_negatives(q, items, pos, 5, 3)
    assert got.groupBy("query_id").count().where("count = 5").count() == 20
    assert got.join(pos, (got.query_id == pos.query_id) & (got.neg_id == pos.item_id)).count() == 0
    assert got.select("query_id", "neg_id").distinct().count() == 100
    parts = {r.part: r["count"] for r in negatives.split_train_dev(items, "item_id", 0.25, 1).groupBy("part").count().collect()}
    assert parts == {"train": 45, "dev": 15}


def test_settings_and_reports(spark):
    s = report.Settings().updated(top_k=5)
    assert report.Settings.of_arguments(["--top_k", "5"]) == s and '"top_k": 5' in s.text() and "top_k=5" in s.folder()
    with pytest.raises(ValueError):
        s.updated(none=1)
    names = frame(spark, [("fixed_anc_cur~top_k=1~seed=4",), ("other~a=1",)], "n string").select(report.canonical(F.col("n")).alias("n"))
    assert [r.n for r in names.collect()] == ["fixed_anc_cur~top_k=1~seed=None", "other~a=1"]


def test_vector_expressions(spark):
    row = frame(spark, [([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>").select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.l2(F.col("a"), F.col("b")).alias("l"), vectors.mips_item(F.col("a"), F.lit(13.0)).alias("m")).first()
    assert (row.d, row.c, row.l, list(row.m)) == (24.0, pytest.approx(0.96), pytest.approx(math.sqrt(2)), [3.0, 4.0, 12.0])

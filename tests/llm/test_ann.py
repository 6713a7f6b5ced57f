import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import ann


def nearest(ids, x, q, k):
    s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
    s[q] = -np.inf
    order = np.lexsort((ids, -np.round(s, 12)))[:k]
    return [(int(ids[i]), s[i]) for i in order if s[i] > -np.inf]


def test_chi_square():
    assert ann.chi_square(15.50731305586545) == pytest.approx(0.95, abs=1e-9)
    assert ann.quantile(0.95) == pytest.approx(15.50731305586545, abs=1e-6)


def test_tree_boxes_hold_their_points():
    p = np.random.default_rng(0).normal(size=(500, ann.M))
    p[:200] = p[0]
    tree = ann.Tree(p, 16)
    leaf = tree.leaf_of(p)
    for x, k in zip(p, leaf, strict=True):
        assert tree.distances(x)[k] == 0
    lone = ann.Tree(np.repeat(p[:1], 50, axis=0), 16)
    assert len(lone.low) == 1


def test_recall_with_clusters_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 24))
    x[500:560] = x[500]
    x = x.astype(np.float32).astype(np.float64)
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(7)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 50):
        found = sorted(got[q])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        expected = nearest(ids, x, q, 5)
        hits += len({f[1] for f in found} & {e[0] for e in expected})
        for _, v, s in found:
            assert s == pytest.approx(x[v] @ x[q] / (np.linalg.norm(x[v]) * np.linalg.norm(x[q])), abs=1e-12)
    assert hits / 150 >= 0.95
    assert [f[1] for f in sorted(got[500])] == [501, 502, 503, 504, 505]  # ties go to the smaller id


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1): (7, pytest.approx(2**-0.5)), (0, 2): (50, 0.0), (50, 1): (7, pytest.approx(2**-0.5)), (50, 2): (0, 0.0)}
    assert ann.search(df.where("vec_id = 1"), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.lit(True)).count() == 0
    twice = df.where("vec_id in (0, 7)").unionByName(df.where("vec_id = 7"))
    assert ann.search(twice, F.col("vec_id") == 0).count() >= 1


def test_each_length_is_searched(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 1.0, 0.0]), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (50, 1, 51)]


def test_recall_on_the_tables(spark, data):
    from rankweave.llm.queries import op2_ann

    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in op2_ann(spark, data).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    at = {int(i): k for k, i in enumerate(ids)}
    expected = {q: {e[0] for e in nearest(ids, x, at[q], 5)} for q in got}
    assert len(got) == (ids % 50 == 0).sum()
    assert sum(len(got[q] & expected[q]) for q in got) / (5 * len(got)) >= 0.9


def test_very_large_and_small_components(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 0.0]), (2, [3e200, 4e200]), (3, [5e-324, 5e-324])]
    got = {r.vec_id: r.score for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    assert got == {1: pytest.approx(2**-0.5), 2: pytest.approx(7 / (5 * 2**0.5)), 3: pytest.approx(1.0)}

import random

from rankweave.operators import graphs


def test_distances_go_as_far_as_the_graph(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "src long, dst long")
    every = spark.createDataFrame([(i,) for i in [*range(21), 100, 101]], "source long")
    got = {(r.source, r.node): r.dist for r in graphs.distances(line, every).collect()}
    assert got == {(a, b): abs(a - b) for a in range(21) for b in range(21)} | {(100, 100): 0, (100, 101): 1, (101, 100): 1, (101, 101): 0}


def test_shape_of_a_line(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    every = spark.createDataFrame([(i,) for i in range(21)], "source long")
    assert [tuple(r) for r in graphs.shape(graphs.distances(line, every)).collect()] == [(10, 20, 1)]


def test_sources_walk_within_their_tasks_or_by_joins(spark, monkeypatch):
    r = random.Random(5)
    edges = spark.createDataFrame([(r.randrange(60), r.randrange(60)) for _ in range(55)] + [(7, 7), (200, 200)], "src long, dst long")
    sources = spark.createDataFrame([(i,) for i in [*range(0, 60, 3), 200, 999, None, 3]], "source int")
    for most in (None, 2):
        walked = graphs.distances(edges, sources, most)
        assert "MapInArrow" in walked._jdf.queryExecution().executedPlan().toString()  # nothing of the levels is shuffled
        with monkeypatch.context() as m:
            m.setattr(graphs, "GRAPH_EDGES", 0)
            joined = graphs.distances(edges, sources, most)
        assert walked.schema == joined.schema or [f.dataType for f in walked.schema] == [f.dataType for f in joined.schema]
        assert sorted(map(str, walked.collect())) == sorted(map(str, joined.collect()))


def test_few_answers_meet_the_distances_by_a_broadcast(spark, monkeypatch):
    line = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    dist = graphs.distances(line, spark.createDataFrame([(0,), (5,)], "source long"))
    answers = spark.createDataFrame([(0, 1), (0, 1), (0, 4), (5, 99), (8, 9)], "source long, node long")
    few = sorted(map(tuple, graphs.hop_accuracy(dist, answers, [1, 4]).collect()))
    monkeypatch.setattr(graphs, "ANSWERS", 0)
    assert few == sorted(map(tuple, graphs.hop_accuracy(dist, answers, [1, 4]).collect())) == [(1, 0.4), (4, 0.6)]

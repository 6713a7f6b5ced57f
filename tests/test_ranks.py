import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import composed, ranks, scoring
from rankweave.plans import catalogue


def pairs_of(spark, rows, every=4):
    return scoring.Pairs(spark.createDataFrame(rows[::every], "query_id long, e array<double>"), spark.createDataFrame(rows, "item_id long, e array<double>"))


def told(df):
    return {(r["query_id"], r["item_id"]): r["score"] for r in df.collect()}


ROWS = {
    "ties": [(i, [float(i * 7 % 11) - 5, float(i % 3)]) for i in range(60)],
    "one common vector": [(i, [1.0, 2.0] if i % 2 else [i * 0.37 % 1, 1 - i * 0.61 % 1]) for i in range(80)],
    "one far vector": [(i, [1e9, 1e9] if i == 9 else [i * 0.37 % 1, 1 - i * 0.61 % 1]) for i in range(80)],
    "all equal": [(i, [1.0, 0.5]) for i in range(30)],
    "all zero": [(i, [0.0, 0.0]) for i in range(30)],
    "repeated rows": [(i // 2, [i * 0.37 % 1, 1 - i * 0.61 % 1]) for i in range(60)],
}


@pytest.mark.parametrize("rows", ROWS.values(), ids=ROWS)
@pytest.mark.parametrize("cells,bins", [(50, 3), (4_000_000, 8192)])
def test_normal_scores_of_pairs_are_those_of_their_rows(spark, rows, cells, bins):
    pairs = pairs_of(spark, rows)
    by_score = {}
    qs, xs = pairs.queries.collect(), pairs.items.collect()
    cell = [(q[0], x[0], sum(a * b for a, b in zip(q[1], x[1], strict=True))) for q in qs for x in xs if q[0] != x[0]]
    for _, _, s in cell:
        by_score[s] = by_score.get(s, 0) + 1
    z, before = {}, 0
    for s in sorted(by_score):
        z[s] = float(ranks.normal_quantile(np.array([(before + by_score[s] / 2) / len(cell)]))[0])
        before += by_score[s]
    got = sorted((r["query_id"], r["item_id"], r["score"]) for r in ranks.normal_scores(pairs, cells, bins).collect())
    assert got == sorted((q, x, z[s]) for q, x, s in cell)


def test_normal_scores_agree_with_joined_ranks(spark):
    pairs = pairs_of(spark, ROWS["ties"])
    assert told(composed.normal_scores(pairs)) == pytest.approx(told(composed.normal_scores(pairs.rows())))


@pytest.mark.parametrize("rows", [[(i, [float("nan") if i == 3 else i * 0.5, 1.0]) for i in range(12)], []])
def test_normal_scores_of_odd_vectors_take_the_join(spark, rows):
    pairs = pairs_of(spark, rows)
    assert ranks.normal_scores(pairs) is None and composed.normal_scores(pairs).count() == pairs.rows().count()


def test_gaps_round_trip():
    for cells in ([0], [5], [254, 255, 256, 1000, 70_000], list(range(300)), [510, 765, 1020]):
        assert ranks.from_gaps(ranks.gaps(np.array(cells))).tolist() == cells


def test_normal_scores_shuffles_no_scores(spark, data):
    found = catalogue.QUERIES["normal_scores"](spark, data)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert found.columns == ["score", "query_id", "item_id"] and found.where(F.isnan("score")).count() == 0

import pytest
from pyspark.sql import functions as F

from rankweave.operators import approx
from rankweave.plans import catalogue


@pytest.mark.parametrize("name", ["exhaustive_rerank", "listwise_rank"])
def test_pairs_are_not_broadcast(spark, data, name):
    """All pairs of queries and items must not be a broadcast side, however small Spark takes them for."""
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_the_block_comes_as_columns(spark, monkeypatch):
    rows = [(q, i, float(10 * q + i)) for q in (3, 1, 2) for i in (7, 5, 6) if (q, i) != (2, 6)]
    scores = spark.createDataFrame(rows, "query_id long, item_id long, score double")
    collected = []
    collect = type(scores).collect
    monkeypatch.setattr(type(scores), "collect", lambda x: collected.append(x) or collect(x))
    got = approx.block(scores, scores.select("query_id").where("query_id < 3").distinct(), scores.select(F.col("item_id")).distinct())
    assert got[0].tolist() == [[15, 16, 17], [25, 0, 27]] and got[1:] == ([1, 2], [5, 6, 7])
    assert not collected  # cells as rows take over ten times the memory

import math

import pytest
from pyspark.sql import functions as F

from rankweave.operators import aggregates, scoring
from rankweave.plans import catalogue


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 2.0, 5.0, None], [3.5] * 9, [-1e300, 1e-300, 0.0, 7.0, 1e300], [i * 0.37 % 1 for i in range(500)], [float("-inf"), 1.0, 2.0, float("inf")], [None]])
@pytest.mark.parametrize("few", [2, 100_000])
def test_quantiles_are_percentiles(spark, values, few):
    df = spark.createDataFrame([(v,) for v in values], "score double")
    shares = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]
    told = list(df.agg(*[F.percentile("score", F.lit(p)) for p in shares]).first())
    got = aggregates.quantiles(df, "score", shares, bins=4, few=few)
    assert all(a == b or math.isclose(a, b, rel_tol=1e-12) or math.isnan(a) and math.isnan(b) for a, b in zip(got, told, strict=True))


@pytest.mark.parametrize("bins,few", [(64, 2_000_000), (64, 3)])
def test_summary_of_pairs(spark, bins, few):
    rows = [(i, [float(i * 7 % 11) - 5, float(i % 3)]) for i in range(40)]
    pairs = scoring.Pairs(spark.createDataFrame(rows[::4], "query_id long, e array<double>"), spark.createDataFrame(rows, "item_id long, e array<double>"))
    told = pairs.rows().agg(*aggregates.summary(F.col("score"))).first()
    got = aggregates.pairs_summary(pairs, bins=bins, few=few)
    assert got.columns == list(told.asDict()) and got.first() == pytest.approx(told)


def test_score_summary_holds_no_map_of_values(spark, data):
    plan = catalogue.QUERIES["score_summary"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


@pytest.mark.parametrize("rows", [[(i, [1.0, 2.0] if i % 3 else [i * 0.37 % 1, 1.0]) for i in range(60)], [(i, [1.0, 2.0]) for i in range(9)], [(i, [1e9 if i == 8 else i * 1e-9, 1.0]) for i in range(40)]], ids=["one common vector", "all equal", "one far vector"])
@pytest.mark.parametrize("bins,few", [(4, 3), (64, 20)])
def test_summary_forms_no_pairs_where_many_lie_near_a_percentile(spark, monkeypatch, rows, bins, few):
    pairs = scoring.Pairs(spark.createDataFrame(rows[::4], "query_id long, e array<double>"), spark.createDataFrame(rows, "item_id long, e array<double>"))
    told = pairs.rows().agg(*aggregates.summary(F.col("score"))).first()

    def formed(self):
        raise AssertionError("pairs are formed")

    monkeypatch.setattr(scoring.Pairs, "rows", formed)
    assert aggregates.pairs_summary(pairs, bins=bins, few=few).first() == pytest.approx(told)

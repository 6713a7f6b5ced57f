import pytest

from rankweave.operators import index
from rankweave.plans import catalogue
from tests.compare import connected, spark_rows, sql_rows


@pytest.mark.parametrize("name", ["knn_graph", "path_steps", "weighted_ball"])
def test_graph_queries_are_exact_at_any_size(spark, data, monkeypatch, name):
    monkeypatch.setattr(index, "EXACT_UP_TO", 20)  # as if the table were larger than the bound
    assert spark_rows(catalogue.QUERIES[name](spark, data)) == sql_rows(connected(data), catalogue.ORACLE_SQL[name])

from rankweave.operators import setops


def test_a_query_without_a_list_counts_as_zero(spark):
    found = spark.createDataFrame([(1, [1, 2]), (3, [5])], "query_id long, indices array<long>")
    gold = spark.createDataFrame([(1, [2, 9]), (2, [4, 7])], "query_id long, indices array<long>")
    assert sorted(map(tuple, setops.recall_of(found, gold).collect())) == [(1, 0.5), (2, 0.0)]
    got = sorted(map(tuple, setops.overlap(found, gold).collect()))
    assert got == [(1, 1, 1, 2, 0.5, 0.5), (2, 0, 0, 0, 0.0, 0.0), (3, 0, 1, 1, 0.0, 1.0)]

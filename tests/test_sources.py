import json

import pytest
from pyspark.sql import functions as F

from rankweave.operators import scoring
from rankweave.sources import readers, sinks
from rankweave.streaming import live


def put(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_entities_and_mentions(spark, tmp_path):
    e = put(tmp_path / "e.json", [{"document_id": "a", "title": "A", "text": "x"}, {"idx": "w?curid=7", "title": "B", "text": "y"}, {"idx": " c ", "title": "C", "text": None}])
    m = put(tmp_path / "m.json", [{"label_id": "7", "context_left": "L", "mention": "M", "context_right": "R", "type": "t"}, {"label_id": "none", "context_left": "", "mention": "", "context_right": ""}])
    items, linked = readers.entity_linking(spark, e, m)
    assert [(r.item_id, r.kb_id) for r in items.orderBy("item_id").collect()] == [(0, "a"), (1, "7"), (2, "c")]
    assert [(r.query_id, r.gold, r.mention) for r in linked.collect()] == [(0, 1, "m")]
    with pytest.raises(Exception, match="unknown key"):
        readers.mentions_of_domains(spark, m, items.withColumn("domain", F.lit("t"))).collect()
    with pytest.raises(ValueError, match="two entities"):
        readers.entities(spark, put(tmp_path / "twice.json", [{"document_id": "a"}, {"document_id": "a"}]))
    with pytest.raises(ValueError):
        readers.read(spark, "nothing")


def test_lines_number_many_files_in_order(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(5):
        (tmp_path / "d" / f"p{i}.txt").write_text("".join(f"{i}-{j}\n" for j in range(7)))
    rows = readers.lines(spark, str(tmp_path / "d")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.value) for r in rows] == [(7 * i + j, f"{i}-{j}") for i in range(5) for j in range(7)]


def test_other_formats(spark, tmp_path):
    inputs, labels = readers.multi_label(spark, put(tmp_path / "x.json", [{"title": "Ab", "target_ind": [1, 0]}]), put(tmp_path / "l.json", [{"title": "P"}, {"title": "Q"}]))
    assert (inputs.first().input, list(inputs.first().label_idxs), labels.count()) == ("ab", [1, 0], 2)
    assert readers.multi_label(spark, str(tmp_path / "x.json"), str(tmp_path / "l.json"), lower=False)[0].first().input == "Ab"
    (tmp_path / "q.json").write_text(json.dumps([{"question": "why", "ctxs": [{"title": "T", "text": "U"}]}]))
    assert readers.passages(readers.questions(spark, str(tmp_path / "q.json"))).first().passage == "T [TAG] U"
    (tmp_path / "s.txt").write_text("2 5\n1:0.5 4:1\n\n")
    assert {tuple(r) for r in readers.sparse_rows(spark, str(tmp_path / "s.txt")).collect()} == {(0, 1, 0.5), (0, 4, 1.0)}
    (tmp_path / "f.txt").write_text("0 3\n1 2\n")
    assert readers.filter_pairs(spark, str(tmp_path / "f.txt")).count() == 2
    (tmp_path / "r.json").write_text(json.dumps({"indices": [[4, 2], [1]], "scores": [[0.9, 0.1], [0.5]]}))
    assert [tuple(r) for r in readers.ranked_lists(spark, str(tmp_path / "r.json")).orderBy("query_id", "rk").collect()] == [(0, 1, 4, 0.9), (0, 2, 2, 0.1), (1, 1, 1, 0.5)]
    (tmp_path / "g.json").write_text("[5, 6]")
    assert [tuple(r) for r in readers.gold_list(spark, str(tmp_path / "g.json")).orderBy("query_id").collect()] == [(0, 5), (1, 6)]
    (tmp_path / "m.csv").write_text("a,b\n1.5,x\n2,\n")
    assert {(r.metric, r.value, r.word) for r in readers.metrics_csv(spark, str(tmp_path / "m.csv")).collect()} == {("a", 1.5, "1.5"), ("b", None, "x"), ("a", 2.0, "2")}
    (tmp_path / "long.csv").write_text("n\n" + "".join(f"{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)  # several partitions
    try:
        assert readers.metrics_csv(spark, str(tmp_path / "long.csv")).where("pos <> value").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "v.txt").write_text("0.5\n\n1\n")
    assert [r.value for r in readers.floats(spark, str(tmp_path / "v.txt")).orderBy("pair").collect()] == [0.5, 1.0]
    (tmp_path / "res1.json").write_text(json.dumps({"k=1": {"mrr": 3}, "arg_dict": {"a": 1}}))
    assert [tuple(r) for r in readers.result_files(spark, str(tmp_path / "res*.json")).collect()] == [("res1.json", "k=1", "mrr", "3")]
    (tmp_path / "t.json").write_text(json.dumps([{"title": "P"}, {"title": "Q"}]) + "\n")
    assert [(r.rk, r.title) for r in readers.external_titles(spark, str(tmp_path / "t.json")).orderBy("rk").collect()] == [(1, "P"), (2, "Q")]
    assert readers.registry(spark, [readers.Domain("d", "train", "e", "m")]).first().split == "train"


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    lists = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 6, 0.25)], "query_id long, rk int, item_id long, score double")
    sinks.write_ranked(lists, str(tmp_path / "r"))
    back = spark.read.json(str(tmp_path / "r")).first()
    assert (back.indices, back.scores) == ([5, 6], [0.5, 0.25])
    assert sorted(map(tuple, readers.read(spark, "ranked_rows", str(tmp_path / "r")).collect())) == sorted(map(tuple, lists.collect()))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_ranked(lists, str(tmp_path / "r"))
    sinks.write_ranked(lists, str(tmp_path / "r"), overwrite=True)
    sinks.write_table(lists.select("query_id", "item_id", "score"), str(tmp_path / "s"))
    assert readers.scores(spark, str(tmp_path / "s")).count() == 2
    sinks.write_predictions(lists, spark.createDataFrame([(1, 5)], "query_id long, item_id long"), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first().gt_labels == [5]
    sinks.write_by_domain(lists.withColumn("type", F.lit("t")), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d" / "type=t")).count() == 2
    metrics = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0), (0, "b", 3.0)], "pos int, metric string, value double")
    sinks.write_metrics(metrics, ["a", "b"], str(tmp_path / "m"))
    assert {(r.metric, r.value) for r in readers.metrics_csv(spark, str(tmp_path / "m")).collect()} == {("a", 1.0), ("a", 2.0), ("b", 3.0)}
    sinks.write_graph(lists, lists, str(tmp_path / "g"))
    sinks.write_report(lists, str(tmp_path / "c"))


def test_streamed_queries_get_the_batch_answers(spark, tmp_path):
    vectors = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)]
    items = spark.createDataFrame(vectors, "item_id long, e array<double>")
    queries = spark.createDataFrame(vectors[:6], "query_id long, e array<double>")
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, e array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.answer(stream, items, 3, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"n={n}")), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scoring.topk(queries, items, 3).select(got.columns).collect()))


def test_stream_windows_drop_late_events(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0), ("2024-01-01 01:10:00", "b", 5.0)]
    df = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    got = {(r.start.hour, r.event_type): (r.n, r.mean) for r in live.windowed(df, "1 hour", "1 hour").collect()}
    assert got == {(0, "a"): (2, 2.0), (1, "b"): (1, 5.0)}
    assert live.running(spark.createDataFrame([("x", 1.0), ("x", 0.0)], "domain string, rr double")).first().mean == 0.5

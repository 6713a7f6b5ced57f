import numpy as np
from pyspark.sql import functions as F

from rankweave.llm import quality as Q

GOOD = "The old house stood by the river, and nobody knew who had built it. Then spring came. "
BAD = ["BUY!! NOW!! CHEAP!! OFFER!! " * 20, "a | b | cc | dd | ee | ff | " * 20, "the%%% of&&& cat### dog*** " * 20, ("spam " * 9 + "eggs " * 9) * 6]


def test_estimate_finds_the_labellers_accuracies():
    rng = np.random.default_rng(0)
    n, truth = 20_000, rng.random(20_000) < 0.8
    accuracy = np.linspace(0.7, 0.98, len(Q.LABELLERS))
    votes = np.where(rng.random((n, len(accuracy))) < accuracy, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    kinds, counts = np.unique(votes.astype(np.int8), axis=0, return_counts=True)
    weak = Q.estimate(kinds, counts.astype(float))
    assert abs(weak.prior - 0.8) < 0.02 and np.abs(weak.accuracy() - accuracy).max() < 0.03
    assert ((weak.posterior(votes) > 0.5) == truth).mean() > 0.97
    assert Q.estimate(np.zeros((0, len(accuracy)), np.int8), np.zeros(0)).prior == 0.5


def test_votes():
    votes, features, _ = Q._per_text([GOOD * 3, *BAD, "", "x"])
    assert (votes[0] >= 0).all() and votes[0].sum() > 3
    assert all(v.min() < 0 for v in votes[1:5]) and not votes[5].any()
    assert features.shape == (7, Q.BUCKETS) and np.isfinite(features).all()
    alone = Q._per_text([BAD[1]])
    assert (alone[0][0] == votes[2]).all() and np.allclose(alone[1][0], features[2])


def test_frames(spark):
    rows = [(i, GOOD * (1 + i % 5)) for i in range(40)] + [(100 + i, b) for i, b in enumerate(BAD * 3)] + [(200, None), (201, ""), (202, " \n"), (202, " \n")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, kept double")
    out = Q.classify(df, Q.train(df))
    assert out.columns == ["doc_id", "text", "quality_score", "weak_posterior", "kept"]
    assert {r.doc_id for r in out.where("kept").collect()} == set(range(40))
    assert {r.quality_score for r in out.where("doc_id >= 200").collect()} == {0.0}
    none = df.where("doc_id >= 200")
    assert Q.classify(none, Q.train(none)).where("kept").count() == 0
    assert Q.classify(df.where("false"), Q.train(df.where("false"))).count() == 0


def test_agrees_with_given_labels(spark, data):
    from rankweave.llm.queries import op8_quality

    out = op8_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    assert out.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("double"))).first()[0] >= 0.95


def test_copies_count_once_in_the_scorers_sample(spark, data):
    from pyspark.sql import functions as F

    from rankweave.llm import quality
    from rankweave.session import cut

    df = spark.read.parquet(f"{data}/documents.parquet").where(F.length("text") > 200).select("text").distinct()
    hot = cut(df.orderBy(F.pmod(F.xxhash64(F.lit(29), F.col("text")), F.lit(1 << 30))).limit(1))
    many = df.unionByName(hot.crossJoin(spark.range(300)).select("text"))
    alone = (quality.train(hot, train_docs=40).weights != 0).sum()
    assert (quality.train(many, train_docs=40).weights != 0).sum() > alone > 0

"""Queries of dense and lexical retrieval, ranked lists and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.functions import texts, vectors
from rankweave.operators import aggregates, joins, lexical, metrics, scoring, setops
from rankweave.plans.common import CHEAP, GOLD, I, Q, R, S, cheap, exact, gold, gold_set, items, pairs, queries, scored, table
from rankweave.sources.readers import passages

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _six_signed(df: DataFrame, *names: str) -> DataFrame:
    """As ``_six``, but a negative number that rounds to nothing is -0.0, as in SQL: inside lists the two are told apart."""
    return df.withColumns({n: F.when(F.round(n, 6) == 0, F.col(n) * 0.0).otherwise(F.round(n, 6)) for n in names})


@query(f"WITH {R} SELECT query_id, rk, item_id, round(score, 6) AS score FROM ex WHERE rk <= 10")
def exact_topk(spark: SparkSession, d: str) -> DataFrame:
    return _six(exact(spark, d, 10), "score")


@query(f"""WITH {Q}, {I}, s AS (SELECT query_id, item_id, list_dot_product(q.e, i.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(i.e, i.e))) AS score FROM q JOIN i ON query_id <> item_id)
SELECT query_id, rk, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rk FROM s) WHERE rk <= 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _six(scoring.topk(queries(spark, d), items(spark, d), 10, "cosine"), "score")


@query(f"""WITH {Q}, {I}, s AS (SELECT query_id, item_id, list_distance(q.e, i.e) AS dist FROM q JOIN i ON query_id <> item_id)
SELECT query_id, rk, item_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, item_id) AS rk FROM s) WHERE rk <= 10""")
def l2_topk(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.topk(queries(spark, d), items(spark, d), 10, "l2")
    return found.select("query_id", "rk", "item_id", F.round(-F.col("score"), 6).alias("dist"))


@query(f"""WITH {R}, f AS (SELECT query_id, item_id, score FROM ch WHERE rk <= 50)
SELECT query_id, rk, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rk FROM f) WHERE rk <= 10""")
def retrieve_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The cheap scorer's first 50, scored exactly: only they meet the items' vectors again."""
    found = cheap(spark, d, 50).select("query_id", "item_id")
    q, x = queries(spark, d).select("query_id", F.col("e").alias("q")), items(spark, d).select("item_id", "e")
    scored = found.join(q, "query_id").join(x, "item_id").select("query_id", "item_id", vectors.dot(F.col("q"), F.col("e")).alias("score"))
    return _six(scoring.ranked(scored, 10), "score")


@query(f"""WITH {R}, f AS (SELECT a.query_id, count(b.item_id) AS common FROM (SELECT * FROM ex WHERE rk <= 10) a LEFT JOIN (SELECT * FROM ch WHERE rk <= 10) b USING (query_id, item_id) GROUP BY 1)
SELECT round(avg(common), 6) AS common_mean, round(stddev_pop(common), 6) AS common_std, round(quantile_cont(common, 0.5), 6) AS common_p50, round(avg(common / 10), 6) AS common_frac, round(avg(1 - common / 10), 6) AS diff_frac FROM f""")
def retrieval_overlap(spark: SparkSession, d: str) -> DataFrame:
    both = setops.overlap(scoring.packed(exact(spark, d, 10)), scoring.packed(cheap(spark, d, 10)))
    out = both.agg(*aggregates.mean_std_median("common"), F.avg("common_frac").alias("common_frac"), F.avg("diff_frac").alias("diff_frac"))
    return _six(out, *out.columns)


@query(f"""WITH {R}, ks AS (SELECT unnest([1, 5, 10, 50]) AS k), f AS (SELECT k, a.query_id, count(b.item_id) AS c FROM ks JOIN ex a ON a.rk <= 10 LEFT JOIN ch b ON a.query_id = b.query_id AND a.item_id = b.item_id AND b.rk <= k GROUP BY 1, 2)
SELECT k, round(avg(c / 10), 6) AS recall FROM f GROUP BY k""")
def multi_k_recall(spark: SparkSession, d: str) -> DataFrame:
    """One retrieval at the largest k serves all."""
    lists = scoring.prefixes(cheap(spark, d, 50), [1, 5, 10, 50])
    best = exact(spark, d, 10).select("query_id", "item_id", F.lit(1).alias("best"))
    hits = lists.join(best, ["query_id", "item_id"], "left").groupBy("query_id", "k").agg((F.count("best") / 10).alias("r"))
    return _six(hits.groupBy("k").agg(F.avg("r").alias("recall")), "recall")


@query(f"""WITH {R}, {GOLD}, r AS (SELECT g.query_id, coalesce(1.0 / ex.rk, 0) AS rr FROM gold g LEFT JOIN ex ON ex.query_id = g.query_id AND ex.item_id = g.gold AND rk <= 64)
SELECT round(100 * avg((rr = 1)::INT), 2) AS acc, round(100 * avg(rr), 2) AS mrr, round(100 * avg((rr > 0)::INT), 2) AS recall, round(100 * avg((rr > 1 / 6.0)::INT), 2) AS recall_5, round(100 * avg((rr > 1 / 11.0)::INT), 2) AS recall_10,
round(100 * avg((rr > 1 / 65.0)::INT), 2) AS recall_64, round(100 * avg(CASE WHEN rr > 0 THEN (rr = 1)::INT END), 2) AS norm_acc, round(100 * avg(CASE WHEN rr > 0 THEN rr END), 2) AS norm_mrr FROM r""")
def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rank_metrics(exact(spark, d, 64), gold(spark, d).select("query_id", "gold"))


@query(f"""WITH {R}, ks AS (SELECT unnest(range(1, 10)) AS k), f AS (SELECT k, query_id, sum(same::INT) / k AS p FROM ks JOIN ex ON rk <= k GROUP BY 1, 2)
SELECT k::INT AS k, round(avg(p), 6) AS precision FROM f GROUP BY 1""")
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _six(metrics.precision_at(exact(spark, d, 10), gold_set(spark, d), list(range(1, 10))), "precision")


@query(f"""WITH {R}, n AS (SELECT query_id, sum(same::INT) AS n FROM s GROUP BY 1), f AS (SELECT query_id, rk, sum(same::INT) OVER (PARTITION BY query_id ORDER BY rk) AS seen FROM ex WHERE rk <= 20)
SELECT rk AS k, round(avg(seen / greatest(least(rk, n), 1)), 6) AS recall FROM f JOIN n USING (query_id) WHERE rk IN (1, 3, 5, 10, 20) GROUP BY 1""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _six(metrics.recall_at(exact(spark, d, 20), gold_set(spark, d), [1, 3, 5, 10, 20]), "recall")


@query(f"""WITH {R}, w AS (SELECT item_id, 1 + 1.0 / (SELECT count(*) FROM embeddings b WHERE b.label = i.label) AS inv FROM i), ks AS (SELECT unnest([1, 3, 5]) AS k),
f AS (SELECT k, query_id, sum(same::INT * inv) / k AS p FROM ks JOIN ex ON rk <= k JOIN w USING (item_id) GROUP BY 1, 2)
SELECT k, round(avg(p), 6) AS psp FROM f GROUP BY 1""")
def psp_hits(spark: SparkSession, d: str) -> DataFrame:
    sizes = items(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    inverse = items(spark, d).join(sizes, "label").select("item_id", (1 + 1.0 / F.col("n")).alias("inv_psp"))
    return _six(metrics.propensity_hits(exact(spark, d, 5), gold_set(spark, d), inverse, [1, 3, 5]), "psp")


@query(f"""WITH {R}, {GOLD}, r AS (SELECT g.query_id, g.label, coalesce(1.0 / ex.rk, 0) AS rr FROM gold g LEFT JOIN ex ON ex.query_id = g.query_id AND ex.item_id = g.gold AND rk <= 64), dom AS (SELECT label, avg(rr) AS v, count(*) AS n FROM r GROUP BY 1)
SELECT round(avg(v), 6) AS macro, round(sum(v * n) / sum(n), 6) AS micro, sum(n)::BIGINT AS n FROM dom""")
def macro_micro(spark: SparkSession, d: str) -> DataFrame:
    rr = metrics.reciprocal_rank(exact(spark, d, 64), gold(spark, d).select("query_id", "gold")).join(gold(spark, d).select("query_id", "label"), "query_id")
    return _six(aggregates.macro_micro(rr, "label", "rr"), "macro", "micro")


@query("SELECT coalesce(lang, 'all') AS domain, round(avg(n_chars), 6) AS mean, count(n_chars) AS n FROM documents WHERE lang IS NOT NULL GROUP BY GROUPING SETS ((lang), ())")
def domain_means(spark: SparkSession, d: str) -> DataFrame:
    return _six(aggregates.by_domain_and_all(table(spark, d, "documents").where("lang is not null"), "lang", "n_chars"), "mean")


@query(f"""WITH {S} SELECT count(score) AS n, round(min(score), 6) AS low, round(max(score), 6) AS high, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
{", ".join(f"round(quantile_cont(score, {p / 100}), 6) AS p{p}" for p in (1, 10, 50, 90, 99))} FROM s""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.pairs_summary(scored(spark, d))
    return _six(out, *[c for c in out.columns if c != "n"])


@query(f"WITH {S} SELECT least(floor((score + 1) / 0.02), 99)::INT AS bin, count(*) AS n FROM s WHERE score BETWEEN -1 AND 1 GROUP BY 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram(pairs(spark, d), "score", -1.0, 1.0, 100)


@query(f"""WITH {R}, f AS (SELECT CASE WHEN rk <= 10 THEN 'head' ELSE 'tail' END AS grp, cheap - score AS e, score FROM ex)
SELECT grp, round(sum(abs(e)), 4) AS l1, round(avg(abs(e)), 6) AS mean_abs, round(avg(e / score), 3) AS mean_pct, round(avg(abs(e / score)), 3) AS mean_abs_pct, round(sqrt(sum(e * e)), 5) AS frobenius FROM f GROUP BY 1""")
def approx_error(spark: SparkSession, d: str) -> DataFrame:
    head = scoring.ranked(pairs(spark, d)).select(F.when(F.col("rk") <= 10, "head").otherwise("tail").alias("grp"), F.col("score").alias("exact"), F.col("cheap").alias("approx"))
    out = aggregates.errors(head, "grp")
    return out.select("grp", F.round("l1", 4).alias("l1"), F.round("mean_abs", 6).alias("mean_abs"), F.round("mean_pct", 3).alias("mean_pct"), F.round("mean_abs_pct", 3).alias("mean_abs_pct"), F.round("frobenius", 5).alias("frobenius"))


@query(f"WITH {S} SELECT round(max(t), 5) AS infinity FROM (SELECT query_id, sum(abs(cheap - score)) AS t FROM s GROUP BY 1)")
def error_infinity_norm(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.infinity_norm(pairs(spark, d).select("query_id", F.col("score").alias("exact"), F.col("cheap").alias("approx"))).select(F.round("infinity", 5).alias("infinity"))


@query(f"WITH {S} SELECT item_id, round(sum(score), 6) AS score_sum, count(*) AS n FROM s GROUP BY 1")
def column_sums(spark: SparkSession, d: str) -> DataFrame:
    return _six(pairs(spark, d).groupBy("item_id").agg(F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("n")), "score_sum")


@query(f"""WITH {R}, p AS (SELECT query_id, sum(CASE WHEN rk <= 10 THEN same::INT END) / 10 AS v FROM ex GROUP BY 1), c AS (SELECT query_id, sum(CASE WHEN rk <= 10 THEN same::INT END) / 10 AS v FROM ch GROUP BY 1), f AS (SELECT p.v - c.v AS d FROM p JOIN c USING (query_id))
SELECT count(d) AS n, round(min(d), 6) AS low, round(max(d), 6) AS high, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90 FROM f""")
def system_difference(spark: SparkSession, d: str) -> DataFrame:
    out = aggregates.compare_systems(label_precision(spark, d, "exact"), label_precision(spark, d, "cheap"), "p")
    return _six(out, *[c for c in out.columns if c != "n"])


def label_precision(spark: SparkSession, d: str, system: str, k: int = 10) -> DataFrame:
    """(query_id, p): the share of the first k that have the query's label."""
    lists = (exact if system == "exact" else cheap)(spark, d, k)
    labelled = lists.join(items(spark, d).select("item_id", F.col("label").alias("y")), "item_id").join(queries(spark, d).select("query_id", "label"), "query_id")
    return labelled.groupBy("query_id").agg((F.sum((F.col("y") == F.col("label")).cast("int")) / k).alias("p"), F.max(F.when(F.col("rk") == 1, (F.col("y") == F.col("label")).cast("int"))).alias("top1"))


TERMS = r"""c AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY ALL),
b AS MATERIALIZED (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM c GROUP BY term),
cw AS (SELECT doc_id, term, tf * idf AS x FROM c JOIN idf USING (term)), bw AS (SELECT query_id, term, tf * idf AS x FROM b JOIN idf USING (term)),
cn AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM cw GROUP BY 1), bn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM bw GROUP BY 1),
t AS MATERIALIZED (SELECT query_id, doc_id AS item_id, sum((cw.x / cn.n) * (bw.x / bn.n)) AS score FROM cw JOIN cn USING (doc_id) JOIN bw USING (term) JOIN bn USING (query_id) GROUP BY ALL)"""


def _tfidf(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.tfidf_scores(table(spark, d, "documents").select("doc_id", "text"), asked)


@query(f"WITH {TERMS} SELECT query_id, rk, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rk FROM t) WHERE rk <= 10")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _six(scoring.ranked(_tfidf(spark, d).withColumn("score", F.round("score", 9)), 10), "score")


@query(f"""WITH {TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rk FROM t), top AS (SELECT query_id, item_id AS pos FROM r WHERE rk = 1)
SELECT query_id, (rk - 1)::INT AS rk, item_id AS neg_id, 1.0::DOUBLE AS score FROM r WHERE rk BETWEEN 2 AND 6""")
def tfidf_negatives(spark: SparkSession, d: str) -> DataFrame:
    """The best text counts as the positive; the next five are negatives, each with score 1."""
    from rankweave.operators.negatives import hard_negatives

    lists = scoring.ranked(_tfidf(spark, d).withColumn("score", F.round("score", 9)), 6)
    found = hard_negatives(lists, lists.where("rk = 1"), 5)
    return found.withColumn("score", F.lit(1.0))


@query("""WITH c AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM documents) GROUP BY ALL),
b AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS term FROM benchmark) GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS len FROM c GROUP BY 1), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM len) AS total),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM c, n GROUP BY term, n), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
t AS (SELECT query_id, doc_id AS item_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len * n / total))) AS score FROM c JOIN b USING (term) JOIN idf USING (term) JOIN len USING (doc_id), n GROUP BY ALL)
SELECT query_id, rk, item_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, item_id) AS rk FROM t) WHERE rk <= 10""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = lexical.bm25_scores(table(spark, d, "documents").select("doc_id", "text"), asked)
    return scoring.ranked(found.withColumn("score", F.round("score", 8)), 10).withColumn("score", F.round("score", 5))


@query(f"WITH {R}, {GOLD} SELECT g.query_id, g.gold, rk AS gold_rk FROM gold g LEFT JOIN ex ON ex.query_id = g.query_id AND item_id = gold AND rk <= 50")
def gold_rank(spark: SparkSession, d: str) -> DataFrame:
    return scoring.gold_rank(exact(spark, d, 50), gold(spark, d).select("query_id", "gold"))


@query(f"WITH {R} SELECT query_id, item_id, round(score, 6) AS score FROM ex WHERE rk = 1")
def argmax(spark: SparkSession, d: str) -> DataFrame:
    return _six(scoring.argmax(pairs(spark, d)), "score")


@query(f"WITH {S} SELECT query_id, rk, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS rk FROM s) WHERE rk <= 5")
def bottom_k(spark: SparkSession, d: str) -> DataFrame:
    return _six(scoring.ranked(pairs(spark, d), 5, largest=False).drop("cheap"), "score")


@query(f"WITH {R} SELECT query_id, rk, item_id, 11 - rk AS score FROM ex WHERE rk <= 10")
def synthetic_scores(spark: SparkSession, d: str) -> DataFrame:
    """A list packed to arrays and unpacked again, its scores replaced by k..1."""
    lists = scoring.unpacked(scoring.packed(exact(spark, d, 10)))
    return lists.select("query_id", "rk", "item_id", (F.lit(11) - F.col("rk")).alias("score"))


@query(f"WITH {R}, f AS (SELECT query_id, rk, item_id, lead(item_id) OVER (PARTITION BY query_id ORDER BY rk) AS next_id FROM ex WHERE rk <= 6) SELECT query_id, rk, item_id, next_id FROM f WHERE next_id IS NOT NULL")
def consecutive_pairs(spark: SparkSession, d: str) -> DataFrame:
    after = F.lead("item_id").over(Window.partitionBy("query_id").orderBy("rk"))
    return exact(spark, d, 6).withColumn("next_id", after).where("next_id is not null").select("query_id", "rk", "item_id", "next_id")


@query(f"WITH {R} SELECT query_id, rk, sum(same::INT) OVER (PARTITION BY query_id ORDER BY rk)::BIGINT AS hits FROM ex WHERE rk <= 10")
def cumulative_hits(spark: SparkSession, d: str) -> DataFrame:
    hit = gold_set(spark, d).withColumn("h", F.lit(1))
    seen = F.sum(F.coalesce("h", F.lit(0))).over(Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0))
    return exact(spark, d, 10).join(hit, ["query_id", "item_id"], "left").select("query_id", "rk", seen.alias("hits"))


@query(f"WITH {R}, f AS (SELECT query_id, item_id > coalesce(lag(item_id) OVER (PARTITION BY query_id ORDER BY rk), -1) AS up FROM ex WHERE rk <= 4) SELECT query_id, bool_and(up) AS increasing FROM f GROUP BY 1")
def increasing_ids(spark: SparkSession, d: str) -> DataFrame:
    return scoring.is_increasing(exact(spark, d, 4), "query_id", "rk", "item_id")


@query(f"""WITH {R}, f AS (SELECT query_id, list(item_id ORDER BY rk) AS a FROM ex WHERE rk <= 4 GROUP BY 1)
SELECT query_id, list_concat(a, [a[4], a[4]]) AS padded, list_concat(a, a, a)[1:10] AS cycled FROM f""")
def padded_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = scoring.packed(exact(spark, d, 4))
    return lists.select("query_id", texts.padded_with_last(F.col("indices"), 6).alias("padded"), texts.cycled(F.col("indices"), 10).alias("cycled"))


@query(f"""WITH {Q}, {I}, m AS (SELECT max(sqrt(list_dot_product(e, e))) AS m FROM i)
SELECT item_id, round(sqrt(greatest(m * m - list_dot_product(e, e), 0)), 4) AS extra, len(e) + 1 AS dims FROM i, m""")
def mips_augment(spark: SparkSession, d: str) -> DataFrame:
    x = items(spark, d)
    most = x.agg(F.max(vectors.norm(F.col("e"))).alias("m"))
    made = x.crossJoin(F.broadcast(most)).select("item_id", vectors.mips_item(F.col("e"), F.col("m")).alias("a"))
    return made.select("item_id", F.round(F.element_at("a", -1), 4).alias("extra"), F.size("a").alias("dims"))


@query(f"""WITH {R}, a AS (SELECT query_id, item_id, score FROM ex WHERE rk <= 10), b AS (SELECT query_id, item_id, score FROM ch WHERE rk <= 10)
SELECT query_id, item_id, round(coalesce(a.score, b.score), 6) AS score, CASE WHEN b.score IS NULL THEN 'left' WHEN a.score IS NULL THEN 'right' ELSE 'both' END AS source FROM a FULL JOIN b USING (query_id, item_id)""")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    right = scoring.gather(cheap(spark, d, 10), pairs(spark, d))
    return _six(joins.merge_candidates(exact(spark, d, 10), right), "score")


@query(f"WITH {R} SELECT query_id, rk, item_id, round(score, 6) AS score FROM ex WHERE rk <= 3")
def union_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A retrieval in three overlapping chunks of queries, put together again."""
    q = queries(spark, d)
    chunks = [_six(scoring.topk(part, items(spark, d), 3), "score") for part in (q.where("query_id % 60 <> 0"), q.where("query_id % 40 = 0"), q.where("query_id % 60 = 0"))]
    return setops.union_chunks(chunks, ["query_id", "rk"])


@query(f"WITH {R} SELECT query_id, item_id FROM (SELECT query_id, item_id FROM ch WHERE rk <= 20 EXCEPT SELECT query_id, item_id FROM ex WHERE rk <= 20)")
def difference(spark: SparkSession, d: str) -> DataFrame:
    return joins.without(cheap(spark, d, 20).select("query_id", "item_id"), exact(spark, d, 20))


@query(f"WITH {R} SELECT DISTINCT item_id FROM (SELECT item_id FROM ex WHERE rk <= 5 UNION ALL SELECT query_id FROM q)")
def distinct_union(spark: SparkSession, d: str) -> DataFrame:
    return exact(spark, d, 5).select("item_id").unionByName(queries(spark, d).select(F.col("query_id").alias("item_id"))).distinct()


@query("""WITH m AS (SELECT o_custkey AS query_id, l_partkey AS item_id, sum(l_quantity)::DOUBLE AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT query_id, rk, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rk FROM m) WHERE rk <= 3""")
def relational_topk(spark: SparkSession, d: str) -> DataFrame:
    """A sparse score matrix from relations: quantities by customer and part."""
    o, line = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    cells = o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("item_id")).agg(F.sum("l_quantity").cast("double").alias("score"))
    return scoring.ranked(cells, 3)


@query("""SELECT o_orderkey AS query_id, c_custkey AS gold FROM orders JOIN customer ON o_custkey = c_custkey""")
def link_gold(spark: SparkSession, d: str) -> DataFrame:
    mentions = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("label_id"))
    entities = table(spark, d, "customer").select(F.col("c_custkey").alias("kb_id"), F.col("c_custkey").alias("item_id"))
    return joins.link_gold(mentions, entities).select("query_id", "gold")


@query("""SELECT c_custkey AS query_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def unlinked(spark: SparkSession, d: str) -> DataFrame:
    mentions = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("label_id"))
    return joins.unlinked(mentions, table(spark, d, "orders").select(F.col("o_custkey").alias("kb_id"))).select("query_id")


@query("""WITH n AS (SELECT p_type AS title, max(p_partkey) AS item_id FROM part GROUP BY 1) SELECT p_partkey AS query_id, item_id FROM part JOIN n ON p_type = title""")
def titles_to_ids(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "part").select(F.col("p_type").alias("title"), F.col("p_partkey").alias("item_id"))
    lists = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("title"))
    return joins.titles_to_ids(lists, entities).select("query_id", "item_id")


@query(f"""WITH {I}, cells AS (SELECT item_id AS id, label, unnest(range(1, len(e) + 1)) AS pos, unnest(e) AS x FROM i), m AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY ALL), f AS (SELECT id, label, sum(x * m) AS d FROM cells JOIN m USING (label, pos) GROUP BY ALL)
SELECT label, count(*) AS n, round(avg(d), 6) AS mean_dot, round(stddev_pop(d), 6) AS std_dot FROM f GROUP BY 1""")
def embedding_variation(spark: SparkSession, d: str) -> DataFrame:
    return _six(aggregates.embedding_variation(items(spark, d).withColumnRenamed("item_id", "id"), "label"), "mean_dot", "std_dot")


def cheap_metric():
    return CHEAP


def conversation_passages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as questions with passages: the first turn asks, the others are passages titled by their role."""
    turns = table(spark, d, "conversations")
    first = turns.where("turn = 0").select("conv_id", F.col("text").alias("question"))
    later = turns.where("turn > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text"))).alias("ctxs"))
    return passages(first.join(later, "conv_id").select(F.concat_ws("|", F.col("conv_id").cast("string"), "question").alias("question"), "ctxs"))


QUERIES["question_passages"] = conversation_passages
ORACLE_SQL["question_passages"] = """WITH a AS (SELECT conv_id, concat_ws('|', conv_id::VARCHAR, text) AS question FROM conversations WHERE turn = 0), b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, concat_ws(' [TAG] ', role, text) AS passage FROM conversations WHERE turn > 0)
SELECT question, pos::INT AS pos, passage FROM a JOIN b USING (conv_id)"""

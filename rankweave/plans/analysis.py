"""Queries of sampling, training rows, decoding, losses, significance tests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import texts
from rankweave.operators import aggregates, joins, losses, metrics, negatives, report, scoring, sequence, significance
from rankweave.plans.common import GOLD, I, Q, R, S, cheap, exact, gold, gold_set, items, md5_key, nodes, pairs, queries, table, uniform
from rankweave.plans.graph import KNN
from rankweave.plans.retrieval import _six, label_precision
from rankweave.streaming.live import windowed

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# Negatives and splits

G2 = f"{GOLD}, pos AS (SELECT query_id, gold AS item_id FROM gold)"


def _positives(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("query_id", F.col("gold").alias("item_id"))


@query(f"""WITH {S}, {G2}, o AS MATERIALIZED (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ordinal FROM i), t AS (SELECT count(*) AS n FROM o),
x AS (SELECT query_id, item_id FROM pos UNION SELECT query_id, query_id FROM q), most AS (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM x GROUP BY query_id)),
draws AS (SELECT query_id, unnest(range(1, 4 * 8 + 25 + floor(4.0 * 8 * m / greatest(1, n - m))::BIGINT)) AS draw FROM q, most, t),
p AS (SELECT query_id, o.item_id, min(draw) AS draw FROM draws, t JOIN o ON ordinal = floor({uniform(21, 'query_id', 'draw')} * n) GROUP BY ALL)
SELECT query_id, rk, neg_id FROM (SELECT query_id, item_id AS neg_id, row_number() OVER (PARTITION BY query_id ORDER BY draw) AS rk FROM p ANTI JOIN x USING (query_id, item_id)) WHERE rk <= 8""")
def random_negatives(spark: SparkSession, d: str) -> DataFrame:
    own = queries(spark, d).select("query_id", F.col("query_id").alias("item_id"))
    return negatives.random_negatives(queries(spark, d), items(spark, d), _positives(spark, d), 8, 21, own)


HARD = f"{R}, {G2}, h AS MATERIALIZED (SELECT query_id, item_id AS neg_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rk FROM (SELECT * FROM ex WHERE rk <= 21) ANTI JOIN pos USING (query_id, item_id))"


@query(f"WITH {HARD} SELECT query_id, rk, neg_id, round(score, 6) AS score FROM h WHERE rk <= 20")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return _six(negatives.hard_negatives(exact(spark, d, 21), _positives(spark, d), 20), "score")


@query(f"""WITH {R}, {G2}, h AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY cheap DESC, item_id) AS k FROM (SELECT * FROM ch WHERE rk <= 41) ANTI JOIN pos USING (query_id, item_id))
SELECT query_id, rk, neg_id, round(score, 6) AS score FROM (SELECT query_id, item_id AS neg_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rk FROM h WHERE k <= 40) WHERE rk <= 10""")
def reranked_negatives(spark: SparkSession, d: str) -> DataFrame:
    return _six(negatives.reranked_negatives(cheap(spark, d, 41), _positives(spark, d), pairs(spark, d), 40, 10), "score")


@query(f"WITH {R}, t AS (SELECT * FROM ex WHERE rk <= 12) SELECT p.query_id, p.item_id AS pos_id, n.item_id AS neg_id FROM t p JOIN t n USING (query_id) WHERE p.rk <= 2 AND n.rk > 8 AND p.item_id <> n.item_id")
def triplets(spark: SparkSession, d: str) -> DataFrame:
    return negatives.triplets(pairs(spark, d), 2, 4, 12)


DIST = f"""{KNN}, und AS MATERIALIZED (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn), sources AS (SELECT DISTINCT item_id AS id FROM pos),
walk(source, node, dist) AS (SELECT id, id, 0 FROM sources UNION SELECT source, dst, dist + 1 FROM walk JOIN und ON node = src WHERE dist < 3), dist AS MATERIALIZED (SELECT source, node, min(dist) AS dist FROM walk GROUP BY ALL)"""


def _balls(spark: SparkSession, d: str) -> DataFrame:
    from rankweave.operators.graphs import distances, knn_graph

    return distances(knn_graph(nodes(spark, d).select("id", "e"), 5, index="exact"), _positives(spark, d).select(F.col("item_id").alias("source")).distinct(), 3)


@query(f"WITH RECURSIVE {HARD}, {DIST} SELECT h.query_id, h.rk, h.neg_id, min(dist) + 1 AS nodes FROM h JOIN pos p ON p.query_id = h.query_id LEFT JOIN dist ON source = p.item_id AND node = neg_id WHERE rk <= 10 GROUP BY ALL")
def negatives_with_distance(spark: SparkSession, d: str) -> DataFrame:
    hard = negatives.hard_negatives(exact(spark, d, 21), _positives(spark, d), 10)
    return negatives.with_distance(hard, _positives(spark, d), _balls(spark, d))


@query(f"""WITH RECURSIVE {R}, {G2}, {DIST}, b AS (SELECT query_id, node AS neg_id, dist, ln({uniform(31, 'query_id', 'node')}) * pow(5.0, dist) AS w FROM pos JOIN dist ON source = item_id WHERE dist > 0)
SELECT query_id, rk, neg_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, neg_id) AS rk FROM b) WHERE rk <= 6""")
def weighted_ball(spark: SparkSession, d: str) -> DataFrame:
    return negatives.weighted_ball(_balls(spark, d), _positives(spark, d), 5, 6, 31)


@query(f"""WITH {R}, {KNN}, pth AS (SELECT query_id, rk AS step, item_id AS node, lead(item_id) OVER (PARTITION BY query_id ORDER BY rk) AS pos_id FROM ex WHERE rk <= 4),
o AS (SELECT query_id, step, node, pos_id, list_concat([node], coalesce(list(dst ORDER BY pos) FILTER (WHERE dst <> pos_id), [])) AS a FROM pth LEFT JOIN knn ON src = node WHERE pos_id IS NOT NULL GROUP BY query_id, step, node, pos_id)
SELECT query_id, step, node, pos_id, list_concat(a, a, a, a, a, a, a, a)[1:8] AS neg_ids FROM o""")
def path_steps(spark: SparkSession, d: str) -> DataFrame:
    from rankweave.operators.graphs import knn_graph

    paths = exact(spark, d, 4).select("query_id", F.col("rk").alias("step"), F.col("item_id").alias("node"))
    return negatives.path_steps(paths, knn_graph(nodes(spark, d).select("id", "e"), 5, index="exact"), 8)


@query(f"WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY {md5_key(13, 'doc_id')}, doc_id) AS r FROM documents) SELECT doc_id, CASE WHEN r <= ceil((SELECT count(*) FROM documents) * (1 - 0.2)) THEN 'train' ELSE 'dev' END AS part FROM k")
def train_dev_split(spark: SparkSession, d: str) -> DataFrame:
    return negatives.split_train_dev(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2, 13).select("doc_id", "part")


@query(f"SELECT split, doc_id, CASE WHEN {uniform(17, 'split', 'doc_id')} < 0.7 THEN 'train' ELSE 'test' END AS part FROM documents, (SELECT unnest([1, 2, 3]) AS split)")
def repeated_splits(spark: SparkSession, d: str) -> DataFrame:
    return negatives.repeated_splits(table(spark, d, "documents"), "doc_id", 3, 0.7, 17)


def _multi(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their parts as labels."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), "l_linenumber", "l_partkey")
    return line.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("label_idxs"))


@query("SELECT l_orderkey AS query_id, l_partkey AS item_id, count(*) AS n FROM lineitem GROUP BY ALL")
def flatten_positives(spark: SparkSession, d: str) -> DataFrame:
    return negatives.flattened(_multi(spark, d)).groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT l_orderkey AS query_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS p FROM lineitem) SELECT query_id, (p // 3)::INT AS chunk, list(l_partkey ORDER BY p) AS labels FROM f GROUP BY ALL")
def chunked_positives(spark: SparkSession, d: str) -> DataFrame:
    return negatives.chunked(_multi(spark, d), 3)


@query(f"WITH {HARD} SELECT query_id, ((rk - 1) // 8)::INT AS batch, list(neg_id ORDER BY rk) AS neg_ids FROM h WHERE rk <= 20 GROUP BY ALL")
def negative_batches(spark: SparkSession, d: str) -> DataFrame:
    return negatives.negative_batches(negatives.hard_negatives(exact(spark, d, 21), _positives(spark, d), 20), 8)


@query(f"WITH {HARD} SELECT query_id, item_id, 1 AS label FROM pos UNION ALL SELECT query_id, neg_id, 0 FROM h WHERE rk <= 5")
def labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return negatives.labelled_pairs(_positives(spark, d), negatives.hard_negatives(exact(spark, d, 21), _positives(spark, d), 5))


@query(f"WITH {HARD}, l AS (SELECT query_id, score AS s FROM s JOIN pos USING (query_id, item_id)), a AS (SELECT query_id, sum((h.score >= l.s)::INT) AS above FROM h JOIN l USING (query_id) WHERE rk <= 20 GROUP BY 1) SELECT query_id, 1 + coalesce(above, 0) AS pos_rk, round(1.0 / (1 + coalesce(above, 0)), 6) AS rr FROM l LEFT JOIN a USING (query_id)")
def listwise_rank(spark: SparkSession, d: str) -> DataFrame:
    pos = scoring.gather(_positives(spark, d), pairs(spark, d))
    return _six(metrics.listwise(pos, negatives.hard_negatives(exact(spark, d, 21), _positives(spark, d), 20)), "rr")


# Tokens


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Documents' words as numbers: their lengths and first letters."""
    words = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.transform(words, lambda w: F.length(w) + 10).alias("ids"))


TOK = "t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w) + 10) AS ids FROM documents)"


@query(f"WITH {TOK}, f AS (SELECT doc_id, list_concat([1], ids[1:30], [2]) AS a FROM t) SELECT doc_id, list_resize(a, 32, 0) AS ids FROM f")
def fixed_length_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("doc_id", texts.fixed_length(F.col("ids"), 32, 1, 2).alias("ids"))


@query(f"""WITH {TOK}, p AS (SELECT doc_id, ids[1:len(ids) // 2] AS l, ids[len(ids) // 2 + 1:len(ids) // 2 + 2] AS m, ids[len(ids) // 2 + 3:] AS r FROM t), z AS (SELECT *, 16 - len(m) AS free FROM p),
y AS (SELECT *, free // 2 AS hl, free - free // 2 AS hr FROM z), w AS (SELECT *, least(len(l), hl + greatest(hr - len(r), 0)) AS tl, least(len(r), hr + greatest(hl - len(l), 0)) AS tr FROM y)
SELECT doc_id, list_concat(CASE WHEN tl = 0 THEN []::BIGINT[] ELSE l[len(l) - tl + 1:] END, m, r[1:tr]) AS ids FROM w""")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    half, n = F.floor(F.size("ids") / 2).cast("int"), F.size("ids")
    left, mention = F.slice("ids", F.lit(1), half), F.slice("ids", half + 1, F.lit(2))
    right = F.slice("ids", half + 3, F.greatest(n - half - 2, F.lit(0)))
    return _tokens(spark, d).select("doc_id", texts.context_window(left, mention, right, 16).alias("ids"))


@query(f"WITH {TOK} SELECT doc_id, list_concat(ids, ids[2:]) AS ids, list_transform(list_concat(ids, ids[2:]), lambda x, i: (i > len(ids) AND x > 0)::INT) AS segments FROM t")
def pair_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A document's whole tokens on both sides."""
    both = texts.pair(F.col("own"), F.col("own"))  # another name than the result's, which the lambda would read
    return _tokens(spark, d).withColumnRenamed("ids", "own").select("doc_id", both.alias("ids"), texts.segments(both, F.size("own")).alias("segments"))


@query(f"WITH {TOK}, f AS (SELECT doc_id, list_resize(list_concat([1], ids[1:30], [2]), 32, 0) AS a FROM t) SELECT doc_id, list_sum(list_transform(a, lambda x: (x <> 0)::INT))::BIGINT AS attended FROM f")
def attention_masks(spark: SparkSession, d: str) -> DataFrame:
    mask = texts.attention(texts.fixed_length(F.col("ids"), 32, 1, 2))
    return _tokens(spark, d).select("doc_id", F.aggregate(mask, F.lit(0), lambda s, x: s + x).cast("bigint").alias("attended"))


@query(f"WITH {TOK} SELECT ids, max(doc_id) AS item_id FROM t GROUP BY 1")
def ids_of_tokens(spark: SparkSession, d: str) -> DataFrame:
    return negatives.ids_of_tokens(_tokens(spark, d).select("ids", F.col("doc_id").alias("id")))


# Decoding: the share of each label at each of the first eight components, by the size of the components.

PROBS = "cells AS (SELECT label, unnest(range(0, 8)) AS pos, unnest(embedding[1:8]) AS x FROM embeddings), m AS (SELECT pos, label AS token, sum(abs(x::DOUBLE)) AS w FROM cells GROUP BY ALL), pr AS MATERIALIZED (SELECT pos, token, w / sum(w) OVER (PARTITION BY pos) AS p FROM m), lab AS (SELECT vec_id AS item_id, unnest(range(0, 8)) AS pos, unnest(list_transform(embedding[1:8], lambda x: floor(abs(x * 40)) % 10)) AS token FROM embeddings)"


def _probs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    cells = table(spark, d, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 8)).alias("pos", "x"))
    m = cells.groupBy("pos", F.col("label").cast("long").alias("token")).agg(F.sum(F.abs(F.col("x").cast("double"))).alias("w"))
    return m.select("pos", "token", (F.col("w") / F.sum("w").over(Window.partitionBy("pos"))).alias("p"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    token = F.transform(F.slice("embedding", 1, 8), lambda x: (F.floor(F.abs(x * F.lit(40.0).cast("float"))) % 10).cast("long"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), token.alias("ids"))


@query(f"WITH {PROBS}, b AS (SELECT pos, token, p, row_number() OVER (PARTITION BY pos ORDER BY p DESC, token) AS r FROM pr) SELECT list(token ORDER BY pos) AS tokens, round(sum(ln(p)), 6) AS log_p FROM b WHERE r = 1")
def greedy_decode(spark: SparkSession, d: str) -> DataFrame:
    return _six(sequence.greedy(_probs(spark, d)), "log_p")


@query(f"WITH {PROBS} SELECT item_id, round(sum(ln(p)), 6) AS score FROM lab JOIN pr USING (pos, token) GROUP BY 1")
def label_greedy(spark: SparkSession, d: str) -> DataFrame:
    return _six(sequence.label_scores(_probs(spark, d), _labels(spark, d)), "score")


@query(f"WITH {PROBS} SELECT pos::INT AS pos, list(DISTINCT token::BIGINT ORDER BY token::BIGINT) AS tokens FROM lab GROUP BY 1")
def allowed_tokens(spark: SparkSession, d: str) -> DataFrame:
    return sequence.allowed_tokens(_labels(spark, d))


@query(f"WITH {PROBS}, l AS (SELECT pos, token, lag(token) OVER (PARTITION BY item_id ORDER BY pos) AS b FROM lab) SELECT pos::INT AS pos, token::BIGINT AS token, list(b::BIGINT ORDER BY b) AS before FROM l WHERE b IS NOT NULL GROUP BY ALL")
def token_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.token_pairs(_labels(spark, d))


@query()
def viterbi(spark: SparkSession, d: str) -> DataFrame:
    return sequence.viterbi(_probs(spark, d).withColumn("one", F.lit(1)), sequence.token_pairs(_labels(spark, d)), "one")


# Losses

LISTS = f"{HARD}, l AS (SELECT query_id, score AS pos FROM s JOIN pos USING (query_id, item_id)), n AS (SELECT query_id, list(score ORDER BY rk) AS negs FROM h WHERE rk <= 8 GROUP BY 1), z AS MATERIALIZED (SELECT * FROM l JOIN n USING (query_id))"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    pos = scoring.gather(_positives(spark, d), pairs(spark, d)).select("query_id", F.col("score").alias("pos"))
    negs = negatives.hard_negatives(exact(spark, d, 21), _positives(spark, d), 8).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "score"))), lambda s: s["score"]).alias("negs"))
    return pos.join(negs, "query_id")


@query(f"WITH {LISTS} SELECT query_id, round(ln(exp(pos) + list_sum(list_transform(negs, lambda x: exp(x)))) - pos, 6) AS loss FROM z")
def ce_loss(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("query_id", F.round(losses.cross_entropy(F.col("pos"), F.col("negs")), 6).alias("loss"))


@query(f"WITH {LISTS} SELECT query_id, round(ln(exp(pos) + list_sum(list_transform(list_reverse_sort(negs)[1:3], lambda x: exp(x)))) - pos, 6) AS loss FROM z")
def topk_ce_loss(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("query_id", F.round(losses.topk_cross_entropy(F.col("pos"), F.col("negs"), 3), 6).alias("loss"))


@query(f"""WITH {LISTS}, c AS (SELECT query_id, pos, unnest(range(1, len(negs) + 1)) AS r, unnest(negs) AS s FROM z),
t AS (SELECT *, exp(-r) / sum(exp(-r)) OVER (PARTITION BY query_id) AS soft, (1.0::DOUBLE / r) / sum(1.0::DOUBLE / r) OVER (PARTITION BY query_id) AS share, ln(exp(pos) + sum(exp(s)) OVER (PARTITION BY query_id)) AS total FROM c)
SELECT query_id, round(any_value((total - pos) / 2) + sum(soft / 2 * (total - s)), 6) AS softmax, round(any_value((total - pos) / 2) + sum(share / 2 * (total - s)), 6) AS linear FROM t GROUP BY 1""")
def rank_ce_loss(spark: SparkSession, d: str) -> DataFrame:
    """Targets from the negatives' ranks, as distances."""
    dists = F.sequence(F.lit(1), F.size("negs"))
    by = {name: losses.rank_cross_entropy(F.col("pos"), F.col("negs"), dists, how) for name, how in (("softmax", "negate_softmax"), ("linear", "reciprocal_linear"))}
    return _lists(spark, d).select("query_id", *[F.round(c, 6).alias(name) for name, c in by.items()])


@query(f"""WITH {R}, t AS (SELECT query_id, score AS a, cheap AS b FROM ex WHERE rk <= 10), u AS (SELECT *, exp(a) / sum(exp(a)) OVER (PARTITION BY query_id) AS p, ln(sum(exp(b)) OVER (PARTITION BY query_id)) AS total FROM t)
SELECT query_id, round(sum(p * (total - b)), 6) AS ce, round(avg((a - b) * (a - b)), 6) AS mse FROM u GROUP BY 1""")
def distillation_loss(spark: SparkSession, d: str) -> DataFrame:
    """The cheap scorer as the student of the exact one on each query's ten best."""
    both = scoring.gather(exact(spark, d, 10), pairs(spark, d), "cheap").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rk", "score", "cheap"))).alias("a"))
    teacher, student = F.col("a.score"), F.col("a.cheap")
    return both.select("query_id", F.round(losses.distillation(teacher, student), 6).alias("ce"), F.round(losses.mse(teacher, student), 6).alias("mse"))


@query(f"""WITH {Q}, {I}, {GOLD}, r AS (SELECT query_id, q.e AS q, i.e AS p, (row_number() OVER (ORDER BY query_id) - 1) // 8 AS batch FROM q JOIN gold USING (query_id) JOIN i ON i.item_id = gold),
c AS MATERIALIZED (SELECT a.batch, a.query_id, a.query_id = b.query_id AS own, list_dot_product(a.q, b.p) AS s FROM r a JOIN r b USING (batch)),
x AS (SELECT batch, ln(sum(exp(s))) - sum(s) FILTER (own) AS ce FROM c GROUP BY batch, query_id), h AS (SELECT batch, greatest(0.2 - CASE WHEN own THEN s ELSE -s END, 0) AS h FROM c),
m AS (SELECT batch, avg(h) AS hinge, avg(h * h) AS hinge_sq FROM h GROUP BY 1)
SELECT batch, round(avg(ce), 6) AS ce, round(any_value(hinge), 6) AS hinge, round(any_value(hinge_sq), 6) AS hinge_sq FROM x JOIN m USING (batch) GROUP BY 1""")
def in_batch_loss(spark: SparkSession, d: str) -> DataFrame:
    """Queries in batches of eight, each against its batch's positives."""
    vectors = items(spark, d).select(F.col("item_id").alias("gold"), F.col("e").alias("pos"))
    rows = queries(spark, d).select("query_id", F.col("e").alias("q")).join(gold(spark, d).select("query_id", "gold"), "query_id").join(vectors, "gold").select("query_id", "q", "pos")
    return _six(losses.in_batch(rows, 8, 0.2), "ce", "hinge", "hinge_sq")


@query(f"""WITH {HARD}, best AS (SELECT neg_id, query_id, row_number() OVER (ORDER BY query_id) - 1 AS ordinal FROM h WHERE rk = 1), g AS (SELECT item_id, row_number() OVER (ORDER BY query_id) - 1 AS ordinal FROM pos)
SELECT ordinal, query_id, neg_id, item_id FROM best JOIN g USING (ordinal)""")
def zipped_rows(spark: SparkSession, d: str) -> DataFrame:
    """The n-th query's hardest negative beside the n-th positive, by place alone."""
    best = negatives.hard_negatives(exact(spark, d, 21), _positives(spark, d), 20).where("rk = 1").select("query_id", "neg_id")
    return joins.zipped(best, _positives(spark, d).select(F.col("query_id").alias("gold_query"), "item_id"), "query_id", "gold_query").drop("gold_query")


@query(f"WITH {LISTS} SELECT query_id, round(list_sum(list_transform(negs, lambda x: greatest(x - pos + 0.5, 0))) / len(negs), 6) AS loss FROM z")
def margin_loss(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("query_id", F.round(losses.margin(F.col("pos"), F.col("negs"), 0.5), 6).alias("loss"))


@query(f"""WITH {LISTS}, k AS (SELECT query_id, list_concat([CASE WHEN pos > 0.2 THEN 0 ELSE pos END], list_transform(negs, lambda x: CASE WHEN -x > 0.2 THEN 0 ELSE -x END)) AS k FROM z)
SELECT query_id, round(list_sum(list_transform(k, lambda x: greatest(0.2 - x, 0))) / len(k), 6) AS loss, round(list_sum(list_transform(k, lambda x: pow(greatest(0.2 - x, 0), 2))) / len(k), 6) AS squared FROM k""")
def hinge_loss(spark: SparkSession, d: str) -> DataFrame:
    every = F.concat(F.array("pos"), "negs")
    signs = F.concat(F.array(F.lit(1.0)), F.transform("negs", lambda x: F.lit(-1.0)))
    return _lists(spark, d).select("query_id", F.round(losses.hinge(every, signs, 0.2), 6).alias("loss"), F.round(losses.hinge(every, signs, 0.2, True), 6).alias("squared"))


@query(f"WITH {S} SELECT query_id, item_id, round(greatest(score, 0) - score * same::INT + ln(1 + exp(-abs(score))), 6) AS loss FROM s")
def bce_loss(spark: SparkSession, d: str) -> DataFrame:
    marked = pairs(spark, d).join(gold_set(spark, d).withColumn("y", F.lit(1.0)), ["query_id", "item_id"], "left")
    return marked.select("query_id", "item_id", F.round(losses.bce(F.col("score"), F.coalesce("y", F.lit(0.0))), 6).alias("loss"))


@query(f"""WITH {LISTS}, a AS (SELECT query_id, unnest(range(1, len(negs) + 1)) AS r, unnest(negs) AS s FROM z)
SELECT a.query_id, round(avg(greatest(b.s - a.s + 0.05, 0)), 6) AS loss FROM a JOIN a b ON a.query_id = b.query_id AND b.r > a.r GROUP BY 1""")
def rank_margin_loss(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("query_id", F.round(losses.rank_margin(F.col("negs"), F.sequence(F.lit(1), F.size("negs")), 0.05), 6).alias("loss"))


@query(f"""WITH RECURSIVE {R}, {G2}, {DIST}, b AS (SELECT query_id, node, exp(-dist::DOUBLE) AS v FROM pos JOIN dist ON source = item_id WHERE dist > 0)
SELECT query_id, node, round(v / sum(v) OVER (PARTITION BY query_id), 8) AS prob FROM b""")
def distance_probabilities(spark: SparkSession, d: str) -> DataFrame:
    ball = _balls(spark, d).where("dist > 0").join(_positives(spark, d).select("query_id", F.col("item_id").alias("source")), "source")
    return losses.distance_probabilities(ball, "dist", "negate_softmax").select("query_id", "node", F.round("prob", 8).alias("prob"))


# Significance: two systems' precision among the first 10, and whether their first item has the right label.

PAIRS = f"{R}, a AS (SELECT query_id, sum(same::INT) FILTER (WHERE rk <= 10) / 10 AS p, max(same::INT) FILTER (WHERE rk = 1) AS t FROM ex GROUP BY 1), b AS (SELECT query_id, sum(same::INT) FILTER (WHERE rk <= 10) / 10 AS p, max(same::INT) FILTER (WHERE rk = 1) AS t FROM ch GROUP BY 1), x AS MATERIALIZED (SELECT a.query_id AS pair, a.p AS a, b.p AS b, a.t AS ta, b.t AS tb FROM a JOIN b USING (query_id))"


def _pairs(spark: SparkSession, d: str, column: str = "p") -> DataFrame:
    a, b = label_precision(spark, d, "exact"), label_precision(spark, d, "cheap")
    return a.select(F.col("query_id").alias("pair"), F.col(column).alias("a")).join(b.select(F.col("query_id").alias("pair"), F.col(column).alias("b")), "pair")


@query(f"WITH {PAIRS}, c AS (SELECT count_if(ta = 1 AND tb = 1) AS rr, count_if(ta = 1 AND tb = 0) AS rw, count_if(ta = 0 AND tb = 1) AS wr, count_if(ta = 0 AND tb = 0) AS ww FROM x) SELECT rr, rw, wr, ww, round(CASE WHEN rw + wr > 0 THEN (rw - wr) * (rw - wr) / (rw + wr) ELSE 0 END, 6) AS chi2 FROM c")
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return _six(significance.mcnemar(_pairs(spark, d, "top1")), "chi2")


@query(f"WITH {PAIRS} SELECT count(*) AS n, round(avg(a - b), 6) AS mean, round(CASE WHEN stddev_samp(a - b) > 0 THEN avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) END, 5) AS t FROM x")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    return significance.paired_t(_pairs(spark, d)).select("n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@query(f"""WITH {PAIRS}, f AS (SELECT round(a - b, 6) AS d FROM x WHERE round(a - b, 6) <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM f), w AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r)
SELECT n, w_plus, w_minus, least(w_plus, w_minus) AS w FROM w""")
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    diff = _pairs(spark, d).select("pair", F.round(F.col("a") - F.col("b"), 6).alias("a"), F.lit(0.0).alias("b"))
    return significance.wilcoxon(diff)


@query(f"""WITH {PAIRS}, m AS (SELECT r, abs(avg(CASE WHEN substr({md5_key(41, 'r', 'pair')}, 1, 1) < '8' THEN a - b ELSE b - a END)) AS m FROM x, (SELECT unnest(range(1, 501)) AS r) GROUP BY 1), o AS (SELECT abs(avg(a - b)) AS o FROM x)
SELECT round(o, 6) AS observed, count_if(round(m, 12) >= round(o, 12)) AS hits, round((count_if(round(m, 12) >= round(o, 12)) + 1) / 501, 6) AS p FROM m, o GROUP BY o""")
def permutation_test(spark: SparkSession, d: str) -> DataFrame:
    return _six(significance.permutation(_pairs(spark, d), 500, 41), "observed", "p")


@query(f"""WITH {PAIRS}, y AS (SELECT row_number() OVER (ORDER BY pair) - 1 AS i, a - b AS d FROM x), c AS (SELECT count(*) AS n, avg(d) AS o FROM y), g AS (SELECT r, i AS slot FROM y, (SELECT unnest(range(1, 201)) AS r)),
m AS (SELECT r, avg(d) AS m FROM g, c JOIN y ON y.i = floor({uniform(43, 'r', 'slot')} * n) GROUP BY 1)
SELECT round(o, 6) AS observed, count_if(round(m, 12) > round(2 * o, 12)) AS hits, round(count_if(round(m, 12) > round(2 * o, 12)) / 200, 6) AS p FROM m, c GROUP BY o""")
def bootstrap_test(spark: SparkSession, d: str) -> DataFrame:
    return _six(significance.bootstrap(_pairs(spark, d), 200, 43), "observed", "p")


@query()
def significance_report(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t, *(round(v, 6) for v in significance.significance(_pairs(spark, d, "top1" if t == "mcnemar" else "p"), t, 200))) for t in ("mcnemar", "t", "wilcoxon", "permutation", "bootstrap")]
    return spark.createDataFrame(rows, "test string, p double, normality double")


# Reports: recall of the exact 10 best by the cheap retriever (and by cur-like anchors) for several sizes, by label.

RES = f"{R}, ks AS (SELECT unnest([10, 20, 50, 100]) AS k), res AS MATERIALIZED (SELECT 'bienc' AS method, k AS k_retvr, q.label, avg((c.rk <= k)::INT) AS value FROM ks, ex JOIN ch c USING (query_id, item_id) JOIN q USING (query_id) WHERE ex.rk <= 10 GROUP BY ALL)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.ranked(pairs(spark, d).select("query_id", "item_id", F.col("cheap").alias("score")), rk="c").select("query_id", "item_id", "c")
    best = exact(spark, d, 10).join(found, ["query_id", "item_id"]).join(queries(spark, d).select("query_id", "label"), "query_id").withColumn("k_retvr", F.explode(F.array(*map(F.lit, (10, 20, 50, 100)))))
    return best.groupBy(F.lit("bienc").alias("method"), "k_retvr", "label").agg(F.avg((F.col("c") <= F.col("k_retvr")).cast("double")).alias("value"))


@query(f"WITH {RES} SELECT label, " + ", ".join(f'round(max(value) FILTER (WHERE k_retvr = {k}), 6) AS "k{k}"' for k in (10, 20, 50, 100)) + " FROM res GROUP BY 1")
def pivot_report(spark: SparkSession, d: str) -> DataFrame:
    wide = report.pivoted(_results(spark, d), ["label"], "k_retvr", [10, 20, 50, 100])
    return wide.select("label", *[F.round(f"`{k}`", 6).alias(f"k{k}") for k in (10, 20, 50, 100)])


@query(f"WITH {RES}, e AS (SELECT unnest([0, 10, 20, 60]) AS lo, unnest([10, 20, 60, 200]) AS hi), b AS (SELECT lo, hi, value, k_retvr, row_number() OVER (PARTITION BY lo ORDER BY value DESC, k_retvr) AS r FROM res JOIN e ON k_retvr > lo AND k_retvr <= hi) SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi, round(value, 6) AS best, k_retvr AS at_cost FROM b WHERE r = 1")
def cost_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _six(aggregates.cost_buckets(_results(spark, d), [0, 10, 20, 60, 200], "k_retvr", "value"), "best")


@query(f"WITH {RES}, b AS (SELECT label, value, k_retvr, row_number() OVER (PARTITION BY label ORDER BY value DESC, k_retvr) AS r FROM res) SELECT label, round(value, 6) AS value, k_retvr FROM b WHERE r = 1")
def best_by(spark: SparkSession, d: str) -> DataFrame:
    return _six(aggregates.best_by(_results(spark, d), ["label"], "value", "k_retvr"), "value")


@query(f"WITH {RES} SELECT method, k_retvr, round(avg(value), 6) AS value FROM res GROUP BY ALL")
def mean_over_labels(spark: SparkSession, d: str) -> DataFrame:
    return _six(aggregates.mean_over(_results(spark, d), ["method", "k_retvr"]), "value")


@query(f"""WITH {RES}, two AS (SELECT method, k_retvr, 0 AS n_anchor_i, value, label FROM res UNION ALL SELECT 'cur', k_retvr, 30, value, label FROM res), c AS (SELECT method, label, unnest([20, 50, 100]) AS budget, CASE WHEN method = 'cur' THEN k_retvr + n_anchor_i ELSE k_retvr END AS c, value, n_anchor_i FROM two)
SELECT method, label, budget, round(max(value), 6) AS value, arg_max(n_anchor_i, value) AS split FROM c WHERE c <= budget GROUP BY ALL""")
def equal_cost(spark: SparkSession, d: str) -> DataFrame:
    res = _results(spark, d)
    two = res.withColumn("n_anchor_i", F.lit(0)).unionByName(res.withColumn("method", F.lit("cur")).withColumn("n_anchor_i", F.lit(30)))
    return _six(report.best_at_equal_cost(two, ["method", "label"], [20, 50, 100]), "value")


@query(f"WITH {RES}, pts AS (SELECT m AS method, k AS k_retvr, l AS label, s AS n_anchor_i FROM (SELECT unnest(['bienc']) AS m), (SELECT unnest([10, 50]) AS k), (SELECT DISTINCT label AS l FROM res), (SELECT unnest([0, 10, 20]) AS s)) SELECT p.method, p.k_retvr, p.label, p.n_anchor_i, round(value, 6) AS value FROM pts p JOIN res USING (method, k_retvr, label)")
def grid_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A grid over anchors, which this method ignores: every anchor count shows the one value."""
    res = _results(spark, d).withColumn("n_anchor_i", F.lit(0))
    labels = [r[0] for r in res.select("label").distinct().collect()]
    points = report.grid(spark, method=["bienc"], k_retvr=[10, 50], label=labels, n_anchor_i=[0, 10, 20]).select("method", F.col("k_retvr").cast("int"), F.col("label").cast("int"), F.col("n_anchor_i").cast("int"))
    found = report.looked_up(points, res, ["method", "k_retvr", "label", "n_anchor_i"], {"bienc": ["n_anchor_i"]})
    return _six(found.select("method", "k_retvr", "label", "n_anchor_i", "value"), "value")


@query(f"WITH {RES}, al AS (SELECT unnest(['bienc', 'cur']) AS row, unnest(['dense', 'low rank']) AS name) SELECT name, round(coalesce(max(value), 0), 6) AS value FROM al LEFT JOIN res ON row = method GROUP BY 1")
def alias_report(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([("bienc", "dense"), ("cur", "low rank")], "row string, name string")
    return _six(report.renamed(_results(spark, d).withColumnRenamed("method", "row"), aliases), "value")


@query("SELECT n_name AS name, 'bienc~top_k=' || n_nationkey || '~anc=None~seed=None' AS short, split_part('(' || n_nationkey || ', ' || n_regionkey || ')', ',', 1)[2:]::DOUBLE AS first FROM nation")
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    name = F.concat(F.lit("bienc~top_k="), "n_nationkey", F.lit("~anc=3~seed=7"))
    pair = F.concat(F.lit("("), "n_nationkey", F.lit(", "), "n_regionkey", F.lit(")"))
    return n.select(F.col("n_name").alias("name"), report.canonical(name).alias("short"), texts.number_pair(pair)[0].alias("first"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN (page_id * 3)::VARCHAR ELSE trim(' k' || page_id || ' ') END AS kb_id, lower(concat_ws(' ', url, page_id::VARCHAR)) AS text FROM pages")
def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    idx = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("en?curid="), (F.col("page_id") * 3).cast("string"))).otherwise(F.concat(F.lit(" k"), "page_id", F.lit(" ")))
    return p.select("page_id", texts.entity_key(idx, F.lit(None).cast("string")).alias("kb_id"), F.lower(F.concat_ws(" ", "url", F.col("page_id").cast("string"))).alias("text"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """The streaming extension's windows over the events as a batch."""
    return _six(windowed(table(spark, d, "events"), "1 hour", "1 day"), "mean")



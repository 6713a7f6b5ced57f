"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import ann, bpe_dropout, html_extract, langid, mpegts, ngram_join, packing, quality, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learn = ~langid.held_out() & F.col("doc_id").isNotNull()
    model = langid.train(docs, learn)
    named = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(named, model).drop("text")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_bpe_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_dropout.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), seed=20240501, rate=0.1)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = warc.build(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return built.select(
        "page_id", "url", "refers_to", "metadata_id", "conversion_id", "source_block_digest", "source_payload_digest", "metadata_digest", "conversion_digest", "n_links",
        F.length("text").alias("n_chars"), F.length("metadata").alias("metadata_bytes"), F.length("conversion").alias("conversion_bytes"), "problem",
    )


def tokenizer_path() -> str:
    """The public tokenizer's file, which every machine has in the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), keep_runs=1_500_000)


def op7_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.train(docs)).drop("text")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urlfilter.judge(pages.select("page_id", "url"), URL_RULES, urlfilter.page_edges(pages)).drop("url")


def url_alias_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter over edges that the tables' pages lack: each page's address redirects to that of the page before, but for every third."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("target"))
    edges = pages.where("page_id % 3 <> 0").join(before, "page_id").select(F.col("url").alias("source"), "target")
    return urlfilter.judge(pages, URL_RULES, edges).drop("url")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ann": op2_ann,
    "op3_bpe_dropout": op3_bpe_dropout,
    "op4_html_extract": op4_html_extract,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_mpegts": op7_mpegts,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "url_alias_verdicts": url_alias_verdicts,
    "op10_ngram_join": op10_ngram_join,
}

_JUDGED = r"""
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS MATERIALIZED (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
won AS MATERIALIZED (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)"""

ORACLE_SQL: dict[str, str] = {
    # The tables' pages hold no canonical link or refresh, so that no address has an alias.
    "op9_url_filter": f"""
WITH {_JUDGED}
SELECT s.page_id, s.host, s.path, w.rule, coalesce(w.v, 'allow') AS verdict
FROM split s LEFT JOIN won w ON s.page_id IS NOT DISTINCT FROM w.page_id
""",
    "url_alias_verdicts": f"""
WITH RECURSIVE {_JUDGED}, keyed AS MATERIALIZED (
  SELECT s.page_id, s.host, s.path, w.rule, w.v, nullif(s.host || regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '') AS key FROM split s LEFT JOIN won w USING (page_id)
), ends AS (SELECT a.key AS x, b.key AS y FROM keyed a JOIN keyed b ON b.page_id + 1 = a.page_id WHERE a.page_id % 3 <> 0),
both_ways AS MATERIALIZED (SELECT x, y FROM ends WHERE x <> y UNION SELECT y, x FROM ends WHERE x <> y),
reached(key, other) AS (SELECT x, x FROM both_ways UNION SELECT r.key, b.y FROM reached r JOIN both_ways b ON b.x = r.other),
decided AS (SELECT r.key, bool_or(k.v = 'allow') AS allowed, bool_or(k.v = 'block') AS blocked FROM reached r JOIN keyed k ON k.key = r.other GROUP BY r.key)
SELECT k.page_id, k.host, k.path, k.rule, coalesce(k.v, CASE WHEN d.blocked AND NOT coalesce(d.allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN decided d USING (key)
""",
    "op10_ngram_join": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
shared AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT doc_id, any_value(n.n) AS n_shingles, min(other) AS component_id, (SELECT count(*) FROM links l WHERE l.x = doc_id) AS n_links FROM n JOIN reached USING (doc_id) GROUP BY doc_id
""",
}

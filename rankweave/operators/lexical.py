"""TF-IDF and BM25 retrieval by term joins; nothing is ever made dense.

Document frequencies come from one aggregate over distinct (document, term) pairs.  Scores of a
query set meet the postings on the term, so only documents that share a term make rows; a term that
very many documents share is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.session import cut


WORD = re.compile(r"\w{2,}")


def term_counts(docs: DataFrame, doc_id: str, text: str, kind: str = "words") -> DataFrame:
    """(doc_id, term, tf) with ``words`` (lower case, two characters at least) or ``spaced`` terms.

    A document's terms are counted where its row is, so that no row of every occurrence is shuffled.
    """
    split = (lambda t: WORD.findall(t.lower())) if kind == "words" else (lambda t: t.split(" "))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo in range(0, len(texts), 200):
                counts = [Counter(split(t)) if t is not None else {} for t in texts[lo : lo + 200]]
                owner = np.repeat(np.arange(lo, lo + len(counts)), [len(c) for c in counts])
                terms = pa.array([t for c in counts for t in c], pa.string())
                times = pa.array(np.fromiter((n for c in counts for n in c.values()), np.int64, len(owner)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), terms, times], names=["doc_id", "term", "tf"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {id_type}, term string, tf long")


def idf_smooth(counts: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf) with ln((1+N)/(1+df))+1."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf_weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(doc_id, term, w): tf times idf, each document's weights of length 1; unknown terms are dropped."""
    raw = counts.join(idf, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    size = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return raw.join(size, "doc_id").select("doc_id", "term", (F.col("x") / F.col("size")).alias("w"))


def tfidf_scores(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, item_id, score) of all pairs that share a term.

    Only documents' postings of the queries' terms are multiplied; the others count in the lengths alone.
    """
    counts = term_counts(docs, doc_id, text)
    idf = cut(idf_smooth(counts, docs.count()))
    asked = tfidf_weights(term_counts(queries, query_id, text), idf).select(F.col("doc_id").alias("query_id"), "term", F.col("w").alias("qw"))
    raw = counts.join(idf, "term").select(F.col("doc_id").alias("item_id"), "term", (F.col("tf") * F.col("idf")).alias("x"))
    size = raw.groupBy("item_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dots = raw.join(asked, "term").groupBy("query_id", "item_id").agg(F.sum(F.col("x") * F.col("qw")).alias("dot"))
    return dots.join(size, "item_id").select("query_id", "item_id", (F.col("dot") / F.col("size")).alias("score"))


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text", k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(query_id, item_id, score): Okapi BM25 over space-separated terms, queries in lower case.

    A negative idf becomes ``floor`` times the mean idf; a query's repeated term counts repeatedly.
    """
    length = F.size(F.split(text, " "))
    n, total = docs.agg(F.count(F.lit(1)), F.sum(F.when(F.col(text).isNotNull(), length))).first()
    counts = term_counts(docs, doc_id, text, "spaced")
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = cut(df.select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    low = floor * (raw.agg(F.avg("raw")).first()[0] or 0.0)
    idf = raw.select("term", F.when(F.col("raw") < 0, low).otherwise(F.col("raw")).alias("idf"))
    asked = term_counts(queries.withColumn(text, F.lower(text)), query_id, text, "spaced").select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("times"))
    lengths = docs.select(F.col(doc_id).alias("doc_id"), length.alias("len"))
    hit = counts.join(asked.join(idf, "term"), "term").join(lengths, "doc_id")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") * n / (total or 1)))
    return hit.groupBy("query_id", F.col("doc_id").alias("item_id")).agg(F.sum(part).alias("score"))

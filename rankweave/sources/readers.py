"""Readers of the engine's inputs, each with its schema; nothing is inferred.

Where files carry no ids, a row's position in its file becomes its id: lines are numbered by file and
place with one pass of counts, not by collecting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.functions.texts import entity_key
from rankweave.operators.joins import link_gold, link_gold_strict
from rankweave.operators.ordering import ordinals
from rankweave.operators.scoring import unpacked
from rankweave.session import cut


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(ordinal, value): text lines numbered from 0 in the order of files and places.

    Files are split for reading; partitions keep the order of (file, offset), so a line's number is
    its number within its partition plus the sizes of those before.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    raw = cut(raw)
    sizes = raw.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = raw.join(F.broadcast(sizes.withColumn("_o", offset)), ["_f", "_b"])
    within = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m")) - 1
    return placed.select((within + F.col("_o")).cast("long").alias("ordinal"), "value")


def entities(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """(item_id, kb_id, title, text, domain) of entity lines; a key that two lines share fails the job."""
    fields = "idx string, document_id string, title string, text string"
    parsed = lines(spark, path).select("ordinal", F.from_json("value", fields).alias("x"))
    out = parsed.select(F.col("ordinal").alias("item_id"), entity_key(F.col("x.idx"), F.col("x.document_id")).alias("kb_id"), "x.title", "x.text", F.lit(domain).alias("domain"))
    twice = out.groupBy("kb_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two entities have the key {twice[0]['kb_id']}")
    return out


MENTION = "label_id string, context_left string, mention string, context_right string, type string"


def raw_mentions(spark: SparkSession, path: str) -> DataFrame:
    parsed = lines(spark, path).select("ordinal", F.from_json("value", MENTION).alias("x"))
    lower = [F.lower(F.col(f"x.{c}")).alias(c) for c in ("context_left", "mention", "context_right")]
    return parsed.select(F.col("ordinal").alias("query_id"), "x.label_id", *lower, F.col("x.type").alias("domain"))


def mentions(spark: SparkSession, path: str, entity_table: DataFrame) -> DataFrame:
    """Mentions with the item of their label; those whose label is unknown are dropped."""
    return link_gold(raw_mentions(spark, path), entity_table)


def mentions_of_domains(spark: SparkSession, path: str, entity_table: DataFrame) -> DataFrame:
    """Mentions of several domains, the label looked up within the domain; an unknown one fails the job."""
    return link_gold_strict(raw_mentions(spark, path), entity_table, on=("domain",))


def entity_linking(spark: SparkSession, entity_path: str, mention_path: str) -> tuple[DataFrame, DataFrame]:
    items = entities(spark, entity_path)
    return items, mentions(spark, mention_path, items)


def multi_label(spark: SparkSession, path: str, label_path: str, lower: bool = True) -> tuple[DataFrame, DataFrame]:
    """((query_id, input, label_idxs), (item_id, title)) of multi-label lines."""

    def parsed(p: str, fields: str) -> DataFrame:
        value = F.lower("value") if lower else F.col("value")
        return lines(spark, p).select("ordinal", F.from_json(value, fields).alias("x"))

    inputs = parsed(path, "title string, target_ind array<long>").select(F.col("ordinal").alias("query_id"), F.col("x.title").alias("input"), F.col("x.target_ind").alias("label_idxs"))
    labels = parsed(label_path, "title string").select(F.col("ordinal").alias("item_id"), "x.title")
    return inputs, labels


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, ctxs) of a JSON array of questions with passages."""
    return spark.read.schema("question string, ctxs array<struct<title: string, text: string, score: string>>").json(path, multiLine=True)


def passages(table: DataFrame, tag: str = "[TAG]") -> DataFrame:
    """(question, pos, passage): one row for each passage, its title, the tag and its text."""
    return table.select("question", F.posexplode("ctxs").alias("pos", "c")).select("question", "pos", F.concat_ws(f" {tag} ", "c.title", "c.text").alias("passage"))


def scores(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, item_id, score)."""
    return spark.read.schema("query_id long, item_id long, score double").parquet(path)


def item_scores(spark: SparkSession, path: str) -> DataFrame:
    """(item_x, item_y, rk, score)."""
    return spark.read.schema("item_x long, item_y long, rk int, score double").parquet(path)


def tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, ids array<int>").parquet(path)


def edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level int, src long, dst long, pos int").parquet(path)


def sparse_rows(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, item_id, score) of text with a line of ``item:value`` pairs for each query, after a line of sizes."""
    body = lines(spark, path).where("ordinal > 0")
    cells = body.select((F.col("ordinal") - 1).alias("query_id"), F.explode(F.split(F.trim("value"), r"\s+")).alias("c")).where("c <> ''")
    parts = F.split("c", ":")
    return cells.select("query_id", parts[0].cast("long").alias("item_id"), parts[1].cast("double").alias("score"))


def filter_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, item_id) of lines with two numbers."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("long").alias("query_id"), parts[1].cast("long").alias("item_id"))


def ranked_lists(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rk, item_id, score) of a document {indices, scores} of two nested lists."""
    doc = spark.read.schema("indices array<array<long>>, scores array<array<double>>").json(path, multiLine=True)
    rows = doc.select(F.posexplode(F.arrays_zip("indices", "scores")).alias("query_id", "r"))
    cells = rows.select(F.col("query_id").cast("long"), F.posexplode(F.arrays_zip(F.col("r.indices").alias("i"), F.col("r.scores").alias("s"))).alias("p", "c"))
    return cells.select("query_id", (F.col("p") + 1).alias("rk"), F.col("c.i").alias("item_id"), F.col("c.s").alias("score"))


def ranked_rows(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rk, item_id, score) of lines (query_id, indices, scores), as ``write_ranked`` writes them."""
    return unpacked(spark.read.schema("query_id long, indices array<long>, scores array<double>").json(path))


def gold_list(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, gold) of a JSON list of numbers."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<long>").alias("g"))
    return whole.select(F.posexplode("g").alias("q", "gold")).select(F.col("q").cast("long").alias("query_id"), "gold")


def metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """(pos, metric, value, word) of a table with a column for each metric; empty cells are left out."""
    table = spark.read.csv(path, header=True)
    names = table.columns
    table = ordinals(table.withColumn("_line", F.monotonically_increasing_id()), "_line", "pos")
    cells = table.select("pos", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("word")) for c in names])).alias("x")).select("pos", "x.*")
    return cells.where("word is not null and word <> ''").select("pos", "metric", F.col("word").try_cast("double").alias("value"), "word")


def floats(spark: SparkSession, path: str) -> DataFrame:
    """(pair, value) of one number a line."""
    return lines(spark, path).where(F.trim("value") != "").select(F.col("ordinal").alias("pair"), F.trim("value").cast("double").alias("value"))


def result_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, key, metric, value) of many result documents {key: {metric: value or list}}; settings are left out."""
    text = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "map<string, map<string, string>>").alias("m"))
    rows = text.select("file", F.explode("m").alias("key", "v")).where(~F.col("key").isin("data_info", "arg_dict", "other_args"))
    return rows.select("file", "key", F.explode("v").alias("metric", "value"))


def external_titles(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rk, title) of lines that each hold a list of titles."""
    parsed = lines(spark, path).select(F.col("ordinal").alias("query_id"), F.posexplode(F.from_json("value", "array<struct<title: string>>")).alias("p", "x"))
    return parsed.select("query_id", (F.col("p") + 1).alias("rk"), "x.title")


READERS: dict[str, Callable] = {"xmc": multi_label, "ent_link": entity_linking, "nq": questions, "scores": scores, "ranked": ranked_lists, "ranked_rows": ranked_rows}


def read(spark: SparkSession, data_type: str, *paths: str):
    """By kind of data."""
    if data_type not in READERS:
        raise ValueError(f"no reader for {data_type}")
    return READERS[data_type](spark, *paths)


@dataclass(frozen=True)
class Domain:
    name: str
    split: str
    entities: str
    mentions: str


def registry(spark: SparkSession, domains: list[Domain]) -> DataFrame:
    """The known domains with their split and files."""
    return spark.createDataFrame([(d.name, d.split, d.entities, d.mentions) for d in domains], "domain string, split string, entities string, mentions string")

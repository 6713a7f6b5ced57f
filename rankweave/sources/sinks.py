"""Writers; each refuses to overwrite unless told to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.scoring import packed


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Scores, tokens, vectors, edges, trees: as Parquet."""
    df.write.mode(_mode(overwrite)).partitionBy(*partition_by).parquet(path)


def write_ranked(lists: DataFrame, path: str, overwrite: bool = False) -> None:
    """Ranked lists as JSON lines (query_id, indices, scores)."""
    packed(lists).write.mode(_mode(overwrite)).json(path)


def write_predictions(lists: DataFrame, gold: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines (query_id, gt_labels, curr_pred)."""
    labels = gold.groupBy("query_id").agg(F.sort_array(F.collect_set("item_id")).alias("gt_labels"))
    packed(lists).select("query_id", F.col("indices").alias("curr_pred")).join(labels, "query_id", "left").write.mode(_mode(overwrite)).json(path)


def write_by_domain(df: DataFrame, path: str, column: str = "type", overwrite: bool = False) -> None:
    """JSON lines in a folder for each domain."""
    df.write.mode(_mode(overwrite)).partitionBy(column).json(path)


def write_metrics(metrics: DataFrame, names: list[str], path: str, overwrite: bool = False) -> None:
    """(pos, metric, value) as a table with a column for each metric, short ones padded with empty cells."""
    wide = metrics.groupBy("pos").pivot("metric", names).agg(F.first("value")).orderBy("pos")
    wide.select(*[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(n) for n in names]).write.mode(_mode(overwrite)).csv(path, header=True, emptyValue="")


def write_report(table: DataFrame, path: str, overwrite: bool = False) -> None:
    table.write.mode(_mode(overwrite)).csv(path, header=True)


def write_graph(edges: DataFrame, nodes: DataFrame, path: str, overwrite: bool = False) -> None:
    """A graph as two tables."""
    write_table(edges, f"{path}/edges", overwrite)
    write_table(nodes, f"{path}/nodes", overwrite)

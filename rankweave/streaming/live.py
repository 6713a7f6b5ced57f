"""Queries that arrive as a stream: top items for each micro-batch, and running figures.

An extension: batch results are the same as those of the batch operators over all queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankweave.operators.scoring import topk


def answer(queries: DataFrame, items: DataFrame, k: int, write: Callable[[DataFrame, int], None], checkpoint: str, metric: str = "ip", trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream of (query_id, e) whose micro-batches are answered over all items and given to ``write``.

    ``write`` gets the batch's number, so that a batch that is run again can replace its first run.
    """

    def each(batch: DataFrame, number: int) -> None:
        write(topk(batch, items, k, metric), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(events: DataFrame, width: str, late: str, time: str = "ts", group: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and mean values of events in tumbling windows; events later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select("w.start", "w.end", group, "n", "mean")


def running(results: DataFrame, group: str = "domain", value: str = "rr") -> DataFrame:
    """Running mean of a metric by group, for the complete or update mode."""
    return results.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))

"""Incremental consolidation, duplicate suppression and routing in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dealloom.operators.consolidate import signed
from dealloom.sources.tables import route
from dealloom.streaming.keyed_table import PARTITIONS, merge


def best_so_far(deals: DataFrame) -> DataFrame:
    """Best deal of each (restaurant, time signature) as far as the stream has come; for update or complete mode.

    The state is one row per cluster: the score, the sequence number and the row's text.
    """
    keyed = signed(deals)
    order = F.struct("score", (-F.col("seq")).alias("early"))
    best = keyed.groupBy("restaurant_slug", "time_signature").agg(F.max_by(F.struct("seq", "score", "title"), order).alias("b"), F.count("*").alias("n"))
    return best.select("restaurant_slug", "time_signature", "b.*", "n")


def without_repeats(deals: DataFrame, keys: list[str], time: str = "scraped_at", late: str = "1 hour") -> DataFrame:
    """Re-delivered deals go if they come within the watermark; time is cast to a timestamp with a zone."""
    return deals.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def fan_out(items: DataFrame, kind: str, sinks: dict[str, str], checkpoint: str, counted: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Each kind of item to its own Parquet folder, one subfolder per batch, so that a repeated batch overwrites itself.

    A batch is read and written once, in folders by kind that are then moved to their sinks. counted
    gets the number of each batch and its counters, observed on the way: rows, one for each kind, and other.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = route(batch, kind, {name: f"{path}/batch={number}" for name, path in sinks.items()})
        if counted:
            counted(number, seen)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(updates: DataFrame, path: str, checkpoint: str, keys: list[str], partitions: int = PARTITIONS) -> StreamingQuery:
    """Update-mode results merged into a keyed table: a batch rewrites the partitions that hold its keys, readers see whole versions (keyed_table.current)."""

    def write(batch: DataFrame, number: int) -> None:
        merge(batch, number, path, keys, partitions)

    return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Ranks over a whole table without a window that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealloom.sources.tables import checkpointed

_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row of the partition below


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows and their place (1, 2, 3 ...) in the order given.

    Ranges of the order go to partitions that are sorted and kept by a checkpoint; a row's rank is its
    place there after the rows of the partitions before. Only one count for each partition meets in
    one task. Rows that are equal in the order get places in no set order, and may part between partitions.
    """
    tie = F.monotonically_increasing_id()
    order = [*order, F.col("_tie")]
    placed = checkpointed(rows.withColumn("_tie", tie).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie"))
    placed = placed.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_id", _ROW_BITS), "_at": F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)})
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(offsets), "_part")
    return out.select(*rows.columns, (F.col("_before") + F.col("_at") + 1).alias(name))

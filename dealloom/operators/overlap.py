"""Greedy removal of overlapping deals of a restaurant."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealloom.functions.times import day_mask, minute_of_day


class _Kept:
    """Times of the kept rows of one day set, to be met all at once."""

    def __init__(self) -> None:
        self.times, self.n, self.untimed = np.zeros((2, 8)), 0, False

    def add(self, start: float, end: float) -> None:
        if np.isnan(start):
            self.untimed = True
            return
        if self.n == self.times.shape[1]:
            self.times = np.hstack([self.times, np.zeros_like(self.times)])
        self.times[:, self.n] = start, end
        self.n += 1

    def covers(self, start: float, end: float, share: float) -> bool:
        if np.isnan(start):
            return self.untimed or self.n > 0
        a, b = self.times[:, : self.n]
        same = (a == start) & (b == end)
        return bool((same | (np.minimum(b, end) - np.maximum(a, start) >= share * np.minimum(b - a, end - start))).any())


def _kept(pdf: pd.DataFrame, share: float) -> pd.DataFrame:
    """The sure, complete and early rows first; a row goes if a kept one has all its days and covers its time."""
    pdf = pdf.sort_values(["confidence_score", "complete", "seq"], ascending=[False, False, True])
    by_days: dict[int, _Kept] = {}
    rows = []
    for seq, mask, start, end in pdf[["seq", "mask", "start", "end"]].itertuples(index=False):
        if not any(mask & ~m == 0 and kept.covers(start, end, share) for m, kept in by_days.items()):
            by_days.setdefault(mask, _Kept()).add(start, end)
            rows.append(seq)
    return pd.DataFrame({"seq": rows})


def without_overlaps(deals: DataFrame, by: str = "restaurant_slug", share: float = 0.5) -> DataFrame:
    """seq of the deals that stay.

    A row goes if a row that is kept before it has all its days and the same time, or a share of the
    shorter of both times; one without both times goes if a kept row has all its days at all. Equal
    (days, start, end) rows of a restaurant are first cut to their best one by an aggregation: at
    most 128 day sets and the distinct times are left, so a restaurant with most rows is a small group.
    """
    start, end = minute_of_day(F.col("start_time")), minute_of_day(F.col("end_time"))
    late = F.when(end <= start, end + 1440).otherwise(end)
    timed = start.isNotNull() & end.isNotNull()
    rows = deals.select(by, "seq", "confidence_score", day_mask(F.col("days")).alias("mask"), F.when(timed, start).alias("start"), F.when(timed, late).alias("end"))
    complete = (F.col("start").isNotNull()).cast("int") + (F.col("mask") > 0).cast("int")
    order = F.struct("confidence_score", (-F.col("seq")).alias("early"))
    best = rows.groupBy(by, "mask", "start", "end").agg(F.max_by(F.struct("seq", "confidence_score"), order).alias("b"))
    best = best.select(by, "mask", F.col("start").cast("double"), F.col("end").cast("double"), "b.*").withColumn("complete", complete)
    return best.groupBy(by).applyInPandas(lambda pdf: _kept(pdf, share), "seq long")

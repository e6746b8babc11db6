"""Restaurants as a website shows them: place, whether they are open, and their first sure deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealloom.functions.times import WEEK, compact_days

SURE = 0.7  # confidence of a deal that is shown
SHOWN = 3  # deals of a restaurant


def _day(at: Column, later: Column | int = 0) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEK)), (F.pmod(F.weekday(at) + later, F.lit(7)) + 1).cast("int"))


def open_now(hours: Column, at: Column) -> Column:
    """Whether a place is open at a time, by its map of day to (open, close, closed) in HH:MM; null without hours.

    A day that is missing or closed is closed, one with an open end is open. A close at or before the
    opening is on the next day.
    """
    now = F.date_format(at, "HH:mm")
    of = lambda later: F.try_element_at(hours, _day(at, later))
    today, before = of(0), of(6)
    up = lambda d: d.isNotNull() & ~F.coalesce(d["closed"], F.lit(False))
    late = lambda d: d["close"] <= d["open"]
    whole = today["open"].isNull() | today["close"].isNull()
    own = up(today) & (whole | F.when(late(today), now >= today["open"]).otherwise(now.between(today["open"], today["close"])))
    from_before = up(before) & F.coalesce(late(before) & (now <= before["close"]), F.lit(False))
    return F.when(F.size(hours) > 0, own | from_before)


def opens(hours: Column, at: Column) -> Column:
    """When a closed place opens next: today in hours and minutes, tomorrow, or a day of the week; null if it is open or never opens."""
    now = F.hour(at) * 60 + F.minute(at)

    def label(k: Column) -> Column:
        day = F.try_element_at(hours, _day(at, k))
        minute = F.substring(day["open"], 1, 2).cast("int") * 60 + F.substring(day["open"], 4, 2).cast("int")
        wait = minute - now
        today = F.when(wait > 0, F.concat(F.lit("Opens in "), F.floor(wait / 60).cast("string"), F.lit("h "), (wait % 60).cast("string"), F.lit("m")))
        other = F.when(k == 1, F.concat(F.lit("Opens tomorrow at "), day["open"])).otherwise(F.concat(F.lit("Opens "), F.initcap(_day(at, k)), F.lit(" at "), day["open"]))
        return F.when(day.isNotNull() & ~F.coalesce(day["closed"], F.lit(False)) & day["open"].isNotNull(), F.when(k == 0, today).otherwise(other))

    first = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(6)), label), lambda x: x.isNotNull()), F.lit(0))
    return F.when(~open_now(hours, at), first)


def deal_line(days: Column, start: Column, end: Column, all_day: Column, prices: Column) -> Column:
    """'Mon-Fri 3 pm - 6 pm ($5, $6)'; what is not there is left out."""
    when = F.when(F.coalesce(all_day, F.lit(False)), "All Day").when(start.isNotNull() & end.isNotNull(), F.concat(start, F.lit(" - "), end))
    shown = F.when(F.size(prices) > 0, F.concat(F.lit("("), F.array_join(prices, ", "), F.lit(")")))
    return F.concat_ws(" ", F.nullif(compact_days(F.coalesce(days, F.array().cast("array<string>"))), F.lit("")), when, shown)


def website_rows(restaurants: DataFrame, deals: DataFrame, at: Column, order: str = "seq") -> DataFrame:
    """Restaurants (slug, hours and any other columns) with is_open_now, opens, the lines of their first sure deals, and how many deals there are.

    The first rows of each restaurant are found before they meet its row, so one with most deals
    brings no more than SHOWN of them.
    """
    n = deals.groupBy("slug").agg(F.count("*").alias("n_deals"))
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(order))
    sure = deals.filter(F.col("confidence") >= SURE).withColumn("_r", rank).filter(F.col("_r") <= SHOWN)
    line = deal_line(F.col("days"), F.col("start_time"), F.col("end_time"), F.col("is_all_day"), F.col("prices"))
    lines = sure.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("line")))).alias("_l")).select("slug", F.transform("_l", lambda x: x["line"]).alias("happy_hour_times"))
    out = restaurants.join(n, "slug", "left").join(lines, "slug", "left")
    return out.withColumns({
        "n_deals": F.coalesce("n_deals", F.lit(0)), "happy_hour_times": F.coalesce("happy_hour_times", F.array().cast("array<string>")), "live_data_available": F.coalesce(F.col("n_deals") > 0, F.lit(False)),
        "is_open_now": open_now(F.col("hours"), at), "opens": opens(F.col("hours"), at),
    })

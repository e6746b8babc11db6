"""Live status, freshness and next openings; the clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealloom.functions.times import WEEK, minute_of_day

DAY_MINUTES = 1440


def slots(schedules: DataFrame, key: str = "slug") -> DataFrame:
    """schedules (key, day, start, end) as day number and minutes; an end at or before the start is on the next day."""
    day = F.array_position(F.array(*map(F.lit, WEEK)), F.col("day")).cast("int") - 1
    out = schedules.select(key, day.alias("day"), minute_of_day(F.col("start")).alias("start"), minute_of_day(F.col("end")).alias("end"))
    out = out.filter("day >= 0 AND start IS NOT NULL AND end IS NOT NULL")
    return out.withColumn("end", F.when(F.col("end") <= F.col("start"), F.col("end") + DAY_MINUTES).otherwise(F.col("end")))


def live_status(slots_: DataFrame, as_of: Column, key: str = "slug", horizon: int = 180) -> DataFrame:
    """active, upcoming (starts within the horizon) or closed for each key, at a clock.

    Slots that began the day before and run past midnight count.
    """
    now = F.hour(as_of) * 60 + F.minute(as_of)
    today = F.weekday(as_of)
    ago = F.pmod(today - F.col("day"), F.lit(7)) * DAY_MINUTES + now - F.col("start")  # minutes since the last start
    active = (ago >= 0) & (ago <= F.col("end") - F.col("start"))
    wait = F.pmod(-ago, F.lit(7 * DAY_MINUTES))
    out = slots_.groupBy(key).agg(F.max(active).alias("on"), F.min(F.when(wait > 0, wait)).alias("wait"))
    state = F.when(F.col("on"), "active").when(F.col("wait") < horizon, "upcoming").otherwise("closed")
    return out.select(key, state.alias("status"), F.when(state == "upcoming", F.col("wait")).alias("minutes"))


def next_opening(slots_: DataFrame, as_of: Column, key: str = "slug") -> DataFrame:
    """Minutes until the next start within a week, and its label."""
    now = F.weekday(as_of) * DAY_MINUTES + F.hour(as_of) * 60 + F.minute(as_of)
    wait = F.pmod(F.col("day") * DAY_MINUTES + F.col("start") - now, F.lit(7 * DAY_MINUTES))
    best = slots_.groupBy(key).agg(F.min_by(F.struct("day", "start", wait.alias("wait")), wait).alias("b"))
    name = F.element_at(F.array(*[F.lit(d.title()) for d in WEEK]), F.col("b.day") + 1)
    clock = F.concat(F.lpad(F.floor(F.col("b.start") / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("b.start") % 60).cast("string"), 2, "0"))
    return best.select(key, F.col("b.wait").alias("wait"), F.concat(name, F.lit(" "), clock).alias("label"))


def stale(rows: DataFrame, as_of: Column, updated: str, days: int = 7) -> DataFrame:
    """Rows that were last updated so many days ago or more, or never."""
    return rows.filter(F.col(updated).isNull() | (F.col(updated) <= as_of - F.make_dt_interval(F.lit(days))))


# Days after which a class of data is due.
UPDATE_DAYS = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 90}


def due(rows: DataFrame, as_of: Column, updated: str, kind: Column | None = None, hours: Column | None = None) -> DataFrame:
    """Rows that are due again: by their class of data (any other is weekly), or after their own number of hours where they have one. Rows never updated are due."""
    days = F.coalesce(*[F.when(kind == k, d) for k, d in UPDATE_DAYS.items()], F.lit(UPDATE_DAYS["weekly"])) if kind is not None else F.lit(UPDATE_DAYS["weekly"])
    wait = F.coalesce(hours.cast("double"), days * F.lit(24.0)) if hours is not None else days * F.lit(24.0)
    age = (as_of.cast("timestamp").cast("double") - F.col(updated).cast("timestamp").cast("double")) / 3600
    return rows.filter(F.col(updated).isNull() | (age >= wait))


def status_rollup(status: DataFrame, *by: str) -> DataFrame:
    """Number of places, of active and upcoming ones, and a message, for each group; a place without status counts in the total."""
    n = status.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("active", "upcoming")])
    some = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    return n.withColumn("message", F.coalesce(some("active", " happy hours active now"), some("upcoming", " starting soon"), F.lit("No active happy hours")))


def freshness(rows: DataFrame, as_of: Column, updated: str, fresh_days: int = 2) -> DataFrame:
    """One row of counts and shares: rows, with an update, fresh ones."""
    fresh = F.col(updated) > as_of - F.make_dt_interval(F.lit(fresh_days))
    out = rows.agg(F.count("*").alias("n"), F.count(updated).alias("n_updated"), F.count_if(fresh).alias("n_fresh"))
    return out.withColumn("fresh_share", F.round(F.coalesce(F.try_divide("n_fresh", "n"), F.lit(0.0)), 4))


# Words that tell a specific offer.
OFFER_WORDS = ("$", "%", "off", "price", "special", "discount", "maki", "sake", "cocktail", "beer", "wine")


def relevant_now(deals: DataFrame, today: str, minute: int, most: int = 3) -> DataFrame:
    """The most relevant deals of each slug on a day at a minute, with relevance and rank.

    deals has slug, seq, days, is_all_day, start_minute, end_minute, title, description and
    confidence_score. Deals below 0.25 go, and sure ones (0.5 or more) of other days; unsure ones stay
    as a fallback. All day gives 50, now 150, within two hours 75, within six 25, a specific offer 25.
    """
    on = (F.size("days") <= 0) | F.array_contains("days", today)
    sure = F.coalesce("confidence_score", F.lit(0.0))
    start, end = F.col("start_minute"), F.col("end_minute")
    end = F.when(end < start, end + 1440).otherwise(end)
    wait = start - minute
    now = F.when(F.lit(minute).between(start, end), 150).when(wait.between(1, 120), 75).when(wait.between(121, 360), 25).otherwise(0)
    timed = F.when(F.col("is_all_day"), 50).when(start.isNotNull() & end.isNotNull(), now).otherwise(0)
    words = F.lower(F.concat_ws(" ", "title", "description"))
    offer = F.when(F.exists(F.array(*map(F.lit, OFFER_WORDS)), lambda w: F.contains(words, w)), 25).otherwise(0)
    rows = deals.filter((sure >= 0.25) & (on | (sure < 0.5))).withColumn("relevance", F.round(100.0 + timed + offer + sure * 20, 6))
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("relevance"), "seq"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most)


def failure_reasons(rows: DataFrame, reason: str, name: str, examples: int = 5) -> DataFrame:
    """Reason, n and the first names of each reason of failure; rows without one do not count."""
    failed = rows.select(F.col(reason).alias("reason"), F.col(name).alias("name")).filter("reason <> ''")
    first = failed.withColumn("r", F.row_number().over(Window.partitionBy("reason").orderBy("name"))).filter(F.col("r") <= examples)
    shown = first.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("examples"))
    return failed.groupBy("reason").agg(F.count("*").alias("n")).join(shown, "reason")

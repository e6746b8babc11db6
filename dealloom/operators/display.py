"""Deals as a page shows them: lines of hours, groups of offers with titles, quick summaries and totals of a restaurant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.functions import times as T

# Words that mark an offer, titles and descriptions without content, default texts, kinds of specials.
OFFER_WORDS = ("$", "%", "off", "price", "maki", "sake", "drink", "food", "appetizer", "cocktail", "beer", "wine")
GENERIC_TITLES = ("happy hour", "tuesday special", "daily special", "time-based special", "multi-day happy hour")
GENERIC_TEXTS = ("", "happy hour", "special")
NO_OFFER, NO_SUMMARY = "Happy hour specials available", "Check restaurant for details"
RENAMED_TITLES = ("multi-day happy hour", "time-based special", "happy hour")
SPECIALS = (
    ("Sushi Specials", ("maki", "sushi", "roll")), ("Drink Specials", ("sake", "wine", "beer", "cocktail", "drink")),
    ("Food Specials", ("food", "appetizer", "app")), ("Discount Specials", ("25% off", "half off", "half-off")),
)
_DAY = "(?:" + "|".join(T.WEEK) + ")"
_CLOCK = r"\d{1,2}(?::\d{2})?\s*(?:am|pm)"
# Fixed patterns: parts of a description that repeat its schedule.
REPEATED = (rf"every\s+{_DAY},?\s*all\s+day", rf"\s+{_DAY}$", rf"{_CLOCK}\s*-\s*{_CLOCK}[\s‍]*{_DAY}", rf"^\s*{_CLOCK}\s*-\s*{_CLOCK}\s*$", "[‍‌ ]+", r"\s+")
# Hours and ends of a time range that cannot be.
IMPOSSIBLE = ("30:", "40:", "50:", "60:", "70:", "80:", "90:", "AM - PM", "PM - AM")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words as it is written, signs included."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def without_schedule(description: Column) -> Column:
    """A description without what its schedule says; null is an empty one."""
    text = F.coalesce(description, F.lit(""))
    for pattern in REPEATED[:4]:
        text = F.regexp_replace(text, f"(?i){pattern}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, REPEATED[4], " "), REPEATED[5], " "))


def _is_set(days: Column, names: tuple[str, ...]) -> Column:
    return (F.size(days) == len(names)) & (F.size(F.array_intersect(days, F.array(*map(F.lit, names)))) == len(names))


def _span(start: Column, end: Column) -> Column:
    """'start - end', or null without both."""
    return F.when((start != "") & (end != ""), F.concat(start, F.lit(" - "), end))


def group_title(days: Column, start: Column, end: Column, all_day: Column) -> Column:
    """Days and time of a group in words: 'Weekday 3 pm - 6 pm', 'Daily All Day', 'Special Offer'."""
    days, n = T.day_list(F.coalesce(days, F.array().cast("array<string>"))), F.size(T.day_list(F.coalesce(days, F.array().cast("array<string>"))))
    time = F.when(F.coalesce(all_day, F.lit(False)), "All Day").otherwise(_span(start, end))
    more = F.when(n > 3, F.concat(F.lit(" + "), n - 3, F.lit(" more"))).otherwise("")
    some = F.concat(F.array_join(F.transform(F.slice(days, 1, 3), F.initcap), ", "), more)
    name = F.when(n == 7, "Daily").when(_is_set(days, T.WEEK[:5]), "Weekday").when(_is_set(days, T.WEEK[5:]), "Weekend").otherwise(some)
    bare = F.when(F.coalesce(all_day, F.lit(False)), "All Day Special").otherwise(F.coalesce(time, F.lit("Special Offer")))
    return F.when(n == 0, bare).otherwise(F.concat(name, F.lit(" "), F.coalesce(time, F.lit("Special"))))


def display_title(title: Column, description: Column, days: Column, start: Column, end: Column, all_day: Column) -> Column:
    """A generic title gives way to one from the description's words, or else from the schedule; other titles stay."""
    text = F.lower(F.coalesce(description, F.lit("")))
    days = T.day_list(F.coalesce(days, F.array().cast("array<string>")))
    one = F.when(F.size(days) == 1, F.initcap(F.get(days, F.lit(0))))
    full = F.when(F.size(days) == 7, "Daily ").when(_is_set(days, T.WEEK[5:]), "Weekend ").when(_is_set(days, T.WEEK[:5]), "Weekday ").otherwise(F.coalesce(F.concat(one, F.lit(" ")), F.lit("")))
    by_time = (
        F.when(F.coalesce(all_day, F.lit(False)), F.coalesce(F.concat(one, F.lit(" All-Day Special")), F.lit("All-Day Happy Hour")))
        .when(_span(start, end).isNotNull(), F.concat(full, F.lit("Happy Hour")))
        .otherwise("Special Offers")
    )
    by_words = F.coalesce(*[F.when(_has(text, words), name) for name, words in SPECIALS])
    return F.when(F.lower(title).isin(*RENAMED_TITLES), F.coalesce(by_words, by_time)).otherwise(title)


def _place(title: Column, several: Column) -> Column:
    """Where a deal holds, by its title; a bare 'bar' or 'table' tells it only beside 'happy hour' and other deals."""
    t = F.lower(title)
    loose = several & t.contains("happy hour")
    sure = F.when(t.contains("at the bar"), " (Bar)").when(t.contains("at tables"), " (Tables)").when(t.contains("at bar"), " (Bar)")
    return F.coalesce(sure, F.when(loose & t.contains("bar"), " (Bar)").when(loose & t.contains("table"), " (Tables)"), F.lit(""))


def display_groups(deals: DataFrame, key: str = "slug") -> DataFrame:
    """Lines of a restaurant's page, one row each: its hours as one group, its offers by days and time.

    deals has the key, title, description, days (array), start, end, all_day, prices (array) and
    confidence. A deal with days gives a line of hours; a deal with words of an offer gives a line of
    its group, unless it is the restaurant's only deal and its price stands with its hours. Equal lines are one,
    with the highest confidence; a group without a line has a default one. n_deals counts the lines of
    hours and the deals of an offer group. Lines are aggregated before they meet, so a restaurant with
    most of the deals is no hot group.
    """
    none = F.array().cast("array<string>")
    d = deals.select(
        key, *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("title", "description")], T.day_list(F.coalesce("days", none)).alias("days"), "start", "end",
        F.coalesce("all_day", F.lit(False)).alias("all_day"), F.nullif(F.array_join(F.coalesce("prices", none), ", "), F.lit("")).alias("price"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    ).withColumn("days", F.array_sort(F.transform("days", lambda x: F.array_position(F.array(*map(F.lit, T.WEEK)), x))))
    d = d.withColumn("days", F.transform("days", lambda i: F.get(F.array(*map(F.lit, T.WEEK)), (i - 1).cast("int"))))
    several = d.groupBy(F.col(key).alias("_key")).agg((F.count("*") > 1).alias("several"))
    d = d.join(several, F.col(key).eqNullSafe(F.col("_key"))).withColumn("text", without_schedule(F.col("description")))
    dated = F.size("days") > 0
    scheduled = dated | (F.coalesce("start", F.lit("")) != "") | F.col("all_day")
    time = F.when(F.col("all_day"), "All Day").otherwise(F.coalesce(_span(F.col("start"), F.col("end")), F.lit("Happy Hour")))
    hours = F.when(dated, F.concat(T.compact_days(F.col("days")), F.lit(": "), time, _place(F.col("title"), F.col("several")), F.coalesce(F.concat(F.lit(" - "), "price"), F.lit(""))))
    words = _has(F.lower(F.concat_ws(" ", "title", "text")), OFFER_WORDS)
    offered = words & ~(F.col("price").isNotNull() & scheduled & ~F.col("several"))
    title = F.when(~F.lower("title").isin(*GENERIC_TITLES), F.nullif("title", F.lit("")))
    named = F.when(title.isNotNull() & ~F.contains(F.lower("text"), F.lower(title)), F.concat(title, F.lit(": "), "text")).otherwise(F.col("text"))
    offer = F.when(~F.lower("text").isin(*GENERIC_TEXTS), named)
    shape = ["days", "start", "end", "all_day"]
    by = [key, "is_schedule", *shape]
    kept = ["confidence", F.lit(1).alias("n")]
    empty = [none.alias("days"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(False).alias("all_day")]
    # Lines are columns of their own first: beside an alias of the same name, a select would read the alias within lambdas.
    rows = d.withColumn("line", hours).filter(scheduled).select(key, F.lit(True).alias("is_schedule"), *empty, "line", *kept)
    rows = rows.unionByName(d.withColumn("line", offer).filter(offered).select(key, F.lit(False).alias("is_schedule"), *shape, "line", *kept))
    lines = rows.groupBy(*by, "line").agg(F.max("confidence").alias("confidence"), F.sum("n").alias("n"))
    groups = lines.groupBy(*by).agg(F.max("confidence").alias("group_confidence"), F.sum("n").alias("n"), F.count("line").alias("n_lines"))
    groups = groups.select(*[F.col(c).alias(f"_{c}") for c in by], "group_confidence", F.when(F.col("is_schedule"), F.col("n_lines")).otherwise(F.col("n")).alias("n_deals"), "n_lines")
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    out = lines.join(groups, match).filter("line IS NOT NULL OR (n_lines = 0 AND NOT is_schedule)")
    special = F.when(F.size("days") == 1, F.concat(F.initcap(F.get("days", F.lit(0))), F.lit(" Specials"))).otherwise("Special Offers")
    group = F.when(F.col("is_schedule"), "Happy Hours").otherwise(special)
    return out.select(*by, group.alias("group"), F.coalesce("line", F.lit(NO_OFFER)).alias("line"), "confidence", "group_confidence", "n_deals")


def kept_timeframe(text: Column, longest: int = 20, any_case: bool = False) -> Column:
    """A time range as it is if it can be one, 'All Day', or null; the form for reports, which rewrites nothing."""
    t = F.trim(text)
    seen = F.upper(t) if any_case else t
    possible = ~_has(t, IMPOSSIBLE) & (F.length(t) <= longest)
    return F.when(possible, F.when(F.lower(t) == "all day", "All Day").when(_has(seen, ("PM", "AM", ":")), t))


def user_schedule(curated: Column, days: Column, times: Column, most: int = 5) -> tuple[Column, Column]:
    """(weekly, summary): the curated map's list of days and times, or else what was extracted; summary in one line.

    The first `most` extracted times count, as far as they are times. A daily entry leads the
    summary, then the first one; without any there is a default text and an empty list.
    """
    found = F.filter(F.transform(F.slice(F.coalesce(times, F.array().cast("array<string>")), 1, most), T.timeframe), lambda t: t.isNotNull())
    names = T.day_titles(F.coalesce(days, F.array().cast("array<string>")))
    entries = F.map_entries(curated)
    label = lambda k: F.array_join(F.transform(F.split(k, "_"), lambda d: F.initcap(T.day_name(d))), ", ")
    daily = F.get(F.filter(entries, lambda e: F.lower(e["key"]).contains("daily")), F.lit(0))
    first = F.get(entries, F.lit(0))
    line = lambda a, b: F.concat(a, F.lit(" • "), b)
    is_curated = F.coalesce(F.size(curated) > 0, F.lit(False)) & curated.isNotNull()
    extracted = F.when(F.size(found) > 0, F.array(F.struct(names.alias("days"), found.alias("times"))))
    weekly = F.when(is_curated, T.weekly_schedule(curated)).otherwise(F.coalesce(extracted, F.filter(T.weekly_schedule(F.create_map(F.lit("x"), F.lit("x"))), lambda x: F.lit(False))))
    short = F.when(is_curated, F.coalesce(line(F.lit("Daily"), daily["value"]), line(label(first["key"]), first["value"]))).when(F.size(found) > 0, line(F.array_join(F.slice(names, 1, 3), ", "), F.get(found, F.lit(0))))
    return weekly, F.coalesce(short, F.lit(NO_SUMMARY))


def deals_summary(deals: DataFrame, key: str = "slug", page: str = "page") -> DataFrame:
    """One row per restaurant: deals, food and drink ones, distinct timeframes, days and restrictions, mean prices, confidence.

    deals has the key, the page, kind, price, timeframe, day, restriction and the page's confidence.
    A price counts if it is a dollar sign and a number. Mean prices are those of the last page that
    has one, confidence is the last page's. Pages are summed first, so only pages meet in a restaurant.
    """
    price = F.when(F.col("price").startswith("$"), F.expr("try_cast(substring(price, 2) AS DOUBLE)"))
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, price))
    lists = {"timeframes": "timeframe", "days": "day", "restrictions": "restriction"}
    pages = deals.groupBy(key, page).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("food", "drink")], *[mean(k).alias(k) for k in ("food", "drink")],
        *[F.collect_set(c).alias(name) for name, c in lists.items()], F.max("confidence").alias("confidence"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(page)))
    return pages.groupBy(key).agg(
        F.sum("n").alias("total_deals"), F.sum("n_food").alias("food_deals"), F.sum("n_drink").alias("drink_deals"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(name)))).alias(name) for name in lists],
        *[F.coalesce(F.round(last(k), 2), F.lit(0.0)).alias(f"average_{k}_price") for k in ("food", "drink")], F.max_by("confidence", page).alias("confidence"),
    )

"""Mentions of times, days and prices in text as rows, and deals from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.functions.arrays import let, running_sums
from dealloom.functions.deals import first_match
from dealloom.functions.times import WEEK, day_name

# Forms of times, days and prices.
TIME_RANGE = r"(?i)(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*[-–~]\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)|(\d{1,2})(?::(\d{2}))?\s*(am|pm)\s*[-–~]\s*close|all\s+day"
DAYS = r"(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\s*[-–~]\s*(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*|weekdays?|weekends?|every\s+day|daily|(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?"
PRICE = r"\$\d+(?:\.\d{2})?"
# Words that tell food and drink.
DEAL_WORDS = {"drink": ("beer", "wine", "cocktail", "drink", "margarita", "martini"), "food": ("taco", "burger", "oyster", "pizza", "appetizer", "wings")}


def unmarked(text: Column) -> Column:
    """The text with spaces for the two marks."""
    return F.when(F.contains(text, F.lit("\u0001")) | F.contains(text, F.lit("\u0002")), F.translate(text, "\u0001\u0002", "  ")).otherwise(text)


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places (from 0): array of (start, text).

    Matches are put between two marks (those already in the text become spaces), the text is split at
    the first, and the places are running sums of the lengths. A text without a match is only searched once.
    """
    parts = F.split(F.regexp_replace(unmarked(text), f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})", "\u0001$1\u0002"), "\u0001")
    kind = "array<struct<start:int,text:string>>"

    def placed(parts: Column) -> Column:
        # Each part but the first begins with a match and one mark behind it.
        ends = running_sums(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda part, i: F.length(part) - F.when(i > 0, 1).otherwise(0)))
        return F.zip_with(ends, F.slice(parts, F.lit(2), F.size(parts) - 1), lambda at, part: F.struct(at.alias("start"), F.substring_index(part, "\u0002", 1).alias("text"))).cast(kind)

    found = let(parts, lambda p: F.when(F.size(p) > 1, placed(p)))
    some = text.rlike(pattern) | F.contains(text, F.lit("\u0001")) | F.contains(text, F.lit("\u0002"))
    return F.coalesce(F.when(some, found), F.array().cast(kind))


def mentions(sections: DataFrame, key: Sequence[str], patterns: dict[str, str], text: str = "text") -> DataFrame:
    """One row per match: key, kind of pattern, number, place and text."""
    each = F.flatten(F.array(*[_tagged(F.col(text), kind, p) for kind, p in patterns.items()]))
    return sections.select(*key, F.explode(each).alias("m")).select(*key, "m.*")


def _tagged(text: Column, kind: str, pattern: str) -> Column:
    return F.transform(matches(text, pattern), lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), m["start"].alias("start"), m["text"].alias("match")))


def nearest_day(place: Column, days: Column, before: int = 20, around: int = 30) -> Column:
    """The day mention that stands up to `before` characters before a place, else the closest within `around`, else daily if it is mentioned."""
    ahead = F.filter(days, lambda d: (place - d["start"]).between(1, before))
    near = F.filter(days, lambda d: F.abs(place - d["start"]) <= around)
    closest = F.array_min(F.transform(near, lambda d: F.struct(F.abs(place - d["start"]).alias("far"), d["start"].alias("start"), d["text"].alias("text"))))
    daily = F.exists(days, lambda d: F.lower(d["text"]).contains("daily"))
    return F.coalesce(F.get(ahead, F.lit(0))["text"], closest["text"], F.when(daily, "daily"))


def day_array(text: Column) -> Column:
    """Days of 'Mon - Fri', 'weekends', 'daily' or 'Tue'; ranges wrap round the week."""
    t = F.lower(F.trim(text))
    week = F.array(*map(F.lit, WEEK))
    number = lambda k: F.array_position(week, day_name(F.substring(F.regexp_extract(t, r"^([a-z]{3})[a-z]*\s*[-–~]\s*([a-z]{3})", k), 1, 3))).cast("int") - 1
    first, last = number(1), number(2)
    span = F.transform(F.sequence(F.lit(0), F.pmod(last - first, F.lit(7))), lambda i: F.element_at(week, (F.pmod(first + i, F.lit(7)) + 1).cast("int")))
    one = day_name(F.substring(t, 1, 3))
    return (
        F.when(t.rlike("weekday"), F.slice(week, 1, 5)).when(t.rlike("weekend"), F.slice(week, 6, 2)).when(t.rlike(r"daily|every\s+day"), week)
        .when((first >= 0) & (last >= 0), span).when(F.array_contains(week, one), F.array(one)).otherwise(F.array().cast("array<string>"))
    )


def confidence(has_time: Column, has_days: Column, text: Column) -> Column:
    """0.5, and more for a time, days, the words happy hour and a price; at most 1."""
    add = lambda c, w: F.when(c, w).otherwise(0.0)
    score = F.lit(0.5) + add(has_time, 0.3) + add(has_days, 0.2) + add(F.lower(text).contains("happy hour"), 0.3) + add(text.rlike(r"\$\d"), 0.1)
    return F.round(F.least(score, F.lit(1.0)), 6)


def section_deals(sections: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Deals of each section: one per time range with its nearest day; without times one for its days; else one if the words happy hour are there."""
    t = F.col(text)
    rows = sections.select(*key, t.alias("t"), matches(t, TIME_RANGE).alias("times"), matches(t, DAYS).alias("days"))
    none = F.lit(None).cast("string")
    timed = F.transform("times", lambda m: F.struct(m["text"].alias("time"), nearest_day(m["start"], F.col("days")).alias("day"), confidence(F.lit(True), F.size("days") > 0, F.col("t")).alias("confidence")))
    dayed = F.array(F.struct(none.alias("time"), F.get("days", F.lit(0))["text"].alias("day"), confidence(F.lit(False), F.lit(True), F.col("t")).alias("confidence")))
    bare = F.array(F.struct(none.alias("time"), none.alias("day"), F.lit(0.5).alias("confidence")))
    empty = F.filter(bare, lambda x: F.lit(False))
    found = F.when(F.size("times") > 0, timed).when(F.size("days") > 0, dayed).when(F.lower("t").contains("happy hour"), bare).otherwise(empty)
    return rows.select(*key, F.substring("t", 1, 150).alias("snippet"), F.posexplode(found).alias("pos", "d")).select(*key, "pos", "d.*", "snippet")


def priced_lines(lines: DataFrame, key: Sequence[str], line: str = "line", low: float = 3, high: float = 50) -> DataFrame:
    """Lines with prices as deals: title, lowest price, category; short titles and prices out of range are left out."""
    text = F.col(line)
    price = F.regexp_extract(text, r"\$(\d+(?:\.\d{2})?)", 1).try_cast("double")
    title = F.trim(F.regexp_replace(F.regexp_replace(text, PRICE, " "), r"\s+", " "))
    rows = lines.withColumns({"price": price, "title": title}).filter(F.col("price").between(low, high) & (F.length("title") >= 3) & ~F.lower("title").isin("min", "each", "order"))
    return rows.select(*key, "title", "price", first_match(F.lower("title"), DEAL_WORDS, "unknown").alias("category"))


def distinct_mentions(text: Column, pattern: str, most: int) -> Column:
    """Distinct matches in lower case, in alphabetical order."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))), 1, most)


def contacts(pages: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Phones, addresses and social handles in each text: at most 2, 3 and 1 per network."""
    t = F.col(text)
    social = lambda site: F.nullif(F.lower(F.regexp_extract(t, rf"(?i){site}\.com/([A-Za-z0-9._]{{3,30}})", 1)), F.lit(""))
    phones = F.slice(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}"), F.lit(0)), lambda p: F.regexp_replace(p, r"\D", ""))), 1, 2)
    mails = F.slice(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), F.lit(0))), 1, 3)
    return pages.select(*key, phones.alias("phones"), mails.alias("emails"), social("instagram").alias("instagram"), social("facebook").alias("facebook"))


def document_deals(lines: DataFrame, doc: str = "page_id", pos: str = "pos", line: str = "line", words: str = "happy hour|special", around: int = 5) -> DataFrame:
    """Priced lines at most so many lines away from a line with one of the words; documents without such lines give all their priced lines.

    near says which of the two a line is.
    """
    from pyspark.sql import Window

    hit = F.lower(F.col(line)).rlike(words)
    near = F.max(hit).over(Window.partitionBy(doc).orderBy(pos).rowsBetween(-around, around))
    rows = lines.withColumn("near", near)
    rows = rows.withColumn("any", F.max("near").over(Window.partitionBy(doc))).filter(F.col("near") | ~F.col("any")).drop("any")
    return priced_lines(rows, (doc, pos, "near"), line, 3, 200)


def legacy_entries(rows: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Entries between bars: days and a time range, a bare time range, or all day; anything else with the confidence 0.1."""
    parts = rows.select(*key, F.posexplode(F.split(F.col(text), r"\s*\|\s*")).alias("pos", "entry")).filter("trim(entry) <> ''")
    time = r"(\d{1,2}(?::\d{2})?\s*(?:am|pm)?\s*-\s*(?:\d{1,2}(?::\d{2})?\s*(?:am|pm)|close))"
    e = F.lower("entry")
    span = F.nullif(F.regexp_extract(e, time, 1), F.lit(""))
    days = F.nullif(F.regexp_extract(e, DAYS, 0), F.lit(""))
    sure = F.when(span.isNotNull() & days.isNotNull(), 0.9).when(span.isNotNull(), 0.7).when(e.contains("all day"), 0.6).otherwise(0.1)
    return parts.select(*key, "pos", days.alias("days"), span.alias("time"), e.contains("all day").alias("is_all_day"), sure.alias("confidence"))

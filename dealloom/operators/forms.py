"""Deals in the usual forms of prose: ordered patterns, places, no two deals from overlapping words, a few per text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.functions.arrays import let
from dealloom.functions.times import WEEK, day_name, shown_time
from dealloom.operators.extract import matches

# The forms in their order. H is an hour with or without minutes, T one with am or pm, DAY a day, ANY_DAY one that may be short.
H = r"\d{1,2}(?::\d{2})?"
T = rf"{H}\s*(?:am|pm)"
DAY = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
ANY_DAY = f"{DAY}|mon|tue|wed|thu|fri|sat|sun"
FORMS = (
    ("hours_then_day", rf"({T})\s*-\s*({T}).*?(?:{DAY})"),
    ("day_range", rf"happy\s+hours?\s*({DAY})\s*-\s*({DAY})\s*:\s*({T})\s*-?\s*({T})?"),
    ("every_day_two_ranges", rf"every\s+day\s+({H})\s*-\s*({H})\s*pm\s*&\s*({H})\s*-\s*({H})\s*pm"),
    ("two_ranges", rf"({H})\s*-\s*({H})\s*pm\s*&\s*({H})\s*-\s*({H})\s*pm"),
    ("hours_every_day", rf"(?:available\s+)?({H})\s*-\s*({H})\s*pm\s+every\s+day"),
    ("every_day_hours", rf"every\s+day\s+({H})\s*-\s*({H})\s*pm"),
    ("prices", r"(\$\d+(?:\s+\$\d+)*)\s+happy\s+hour"),
    ("late", rf"({H})\s*pm\s*-?\s*close\s+(?:thurs?|thu)\s*-\s*(?:sats?|sat)"),
    ("share_on_day", rf"(?:\d+%\s*off|half-off).*?every\s+({ANY_DAY}),?\s*all\s+day"),
    ("day", rf"(?:every\s+)?({ANY_DAY})(?:\s*,?\s*all\s+day|\s*all\s+day)?"),
    ("named_hours_then_day", rf"happy\s+hour.*?({H})\s*(?:am|pm)\s*-\s*({H})\s*(?:am|pm).*?(?:{ANY_DAY})"),
    ("part_of_week", rf"(?:discounted|drink|special).*?({H})\s*-\s*({H})\s*pm.*?(?:weekdays|weekends)"),
    ("all_week", r"(sun|sunday)\s*-\s*(sat|saturday)\s*-?\s*all\s+day"),
    ("named_all_week", r"happy\s+hour.*?(sun|sunday)\s*-\s*(sat|saturday).*?all\s+day"),
)
# What is looked for where no form gives a deal.
BARE = (rf"happy hour.*?({T})", rf"({T}).*?happy hour", rf"drink specials.*?({T})")
GENERIC = (rf"happy\s+hour.*?({T})\s*-\s*({T})", rf"({T})\s*-\s*({T}).*?happy\s+hour", rf"daily.*?({T})\s*-\s*({T})")
MOST = 3  # deals of a text
SURE, PRICED, LOOSE, GUESS = 0.8, 0.6, 0.6, 0.4

DEAL = "struct<form:string,place:int,title:string,description:string,days:array<string>,start_time:string,end_time:string,is_all_day:boolean,confidence:double>"


def _span(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    """Whether a range of hours is there, and both ends; ends without am or pm are in the afternoon."""
    end = lambda k: shown_time(F.when(F.regexp_extract(text, pattern, k).rlike("[ap]m$"), F.regexp_extract(text, pattern, k)).otherwise(F.concat(F.regexp_extract(text, pattern, k), F.lit("pm"))))
    return (text.contains("every") if "every" in pattern else F.lit(True)) & text.rlike(pattern), end(1), end(2)


def read(form: Column, text: Column, place: Column) -> Column:
    """The deal that a match in lower case tells, or null: the first reading that fits gives title, days and times."""
    week = F.array(*map(F.lit, WEEK))
    none, text_of = F.lit(None).cast("string"), lambda s: F.lit(s)
    days_none = F.lit(None).cast("array<string>")
    prices = F.regexp_extract(text, FORMS[6][1], 1)
    after, after_start, after_end = _span(text, rf"({H})\s*-\s*({H})\s*pm\s+every\s+day")
    before, before_start, before_end = _span(text, rf"every\s+day\s+({H})\s*-\s*({H})\s*pm")
    bare, bare_start, bare_end = _span(text, rf"({H})\s*-\s*({H})\s*pm")
    full, full_start, full_end = _span(text, rf"({T})\s*-\s*({T})")
    late = text.contains("close") & text.rlike(FORMS[7][1])
    share = F.regexp_replace(F.initcap(F.regexp_extract(text, r"(\d+%\s*off|half-off)", 1)), "-off$", "-Off")
    named = F.regexp_extract(text, rf"every\s+({ANY_DAY})", 1)
    share_title = F.when(text.contains("vegan") & text.contains("maki"), "Vegan Maki Special").when(text.contains("sake"), "Sake Special").otherwise(F.concat(share, F.lit(" Special")))
    edge = lambda k: F.array_position(week, F.regexp_extract(text, FORMS[1][1], k)).cast("int")
    ranged = text.contains("happy") & text.rlike(FORMS[1][1]) & (edge(1) <= edge(2)) & (F.regexp_extract(text, FORMS[1][1], 4) != "")
    mentioned = F.array_distinct(F.regexp_extract_all(text, F.lit(DAY), F.lit(0)))
    label = F.when(F.size(mentioned) <= 3, F.concat(F.array_join(F.transform(mentioned, F.initcap), ", "), F.lit(" Happy Hour"))).otherwise("Weekly Happy Hour")
    weekdays, weekend = F.slice(week, 1, 5), F.slice(week, 6, 2)
    # Condition, title, days, start, end, all day, confidence.
    readings = (
        (text.contains("$") & (prices != ""), text_of("Happy Hour"), days_none, none, none, False, PRICED),
        (after, text_of("Daily Happy Hour"), week, after_start, after_end, False, SURE),
        (before, text_of("Daily Happy Hour"), week, before_start, before_end, False, SURE),
        (late, text_of("Late Night Happy Hour"), F.slice(week, 4, 3), shown_time(F.concat(F.regexp_extract(text, FORMS[7][1], 1), F.lit("pm"))), text_of("Close"), False, SURE),
        (text.contains("every") & text.rlike(FORMS[8][1]), share_title, F.array(day_name(named)), none, none, True, SURE),
        (text.contains("every") & (named != ""), F.concat(F.initcap(named), F.lit(" Special")), F.array(day_name(named)), none, none, True, SURE),
        (text.contains("weekdays") & bare, text_of("Weekday Happy Hour"), weekdays, bare_start, bare_end, False, SURE),
        (text.contains("weekends") & bare, text_of("Weekend Happy Hour"), weekend, bare_start, bare_end, False, SURE),
        (text.rlike(FORMS[12][1]), text_of("All Day Happy Hour"), week, none, none, True, SURE),
        (ranged, text_of("Weekly Happy Hour"), F.slice(week, edge(1), edge(2) - edge(1) + 1), full_start, full_end, False, SURE),
        (full & (F.size(mentioned) > 0), label, mentioned, full_start, full_end, False, SURE),
    )
    described = F.when(text.contains("$") & (prices != ""), F.concat(F.lit("Happy hour with items at "), prices, F.lit(" pricing"))).otherwise(text)
    deal = lambda title, days, start, end, all_day, sure: F.struct(title.alias("title"), days.alias("days"), start.alias("start_time"), end.alias("end_time"), F.lit(all_day).alias("is_all_day"), F.lit(sure).alias("confidence"))
    first = F.coalesce(*[F.when(condition, deal(*values)) for condition, *values in readings])
    whole = lambda d: F.when(d.isNotNull(), F.struct(form.alias("form"), place.alias("place"), d["title"].alias("title"), described.alias("description"), *[d[c].alias(c) for c in ("days", "start_time", "end_time", "is_all_day", "confidence")]).cast(DEAL))
    return let(first, whole)


def common_deals(docs: DataFrame, key: Sequence[str], text: str = "text", most: int = MOST, overlaps: bool = False) -> DataFrame:
    """key, pos and the first deals of each text, in the order of the forms and of their places.

    A match whose words overlap those of a deal before it gives none, unless overlaps is set. A text
    without any gets guesses of all day from the bare words. Everything happens within the row: no
    shuffle. Null and empty texts have no deals.
    """
    rows = docs.select(*key, F.lower(text).alias("_text"))
    tagged = lambda form: lambda m: F.struct(F.lit(form).alias("form"), m["start"].alias("start"), m["text"].alias("text"))
    found = F.flatten(F.array(*[F.transform(matches(F.col("_text"), pattern), tagged(form)) for form, pattern in FORMS]))
    read_all = F.transform(found, lambda m: F.struct(F.length(m["text"]).alias("size"), read(m["form"], m["text"], m["start"]).alias("deal")))
    rows = rows.withColumn("_found", F.filter(read_all, lambda m: m["deal"].isNotNull()))
    kind = "array<struct<size:int,deal:" + DEAL + ">>"
    clash = lambda one, two: (one["deal"]["place"] < two["deal"]["place"] + two["size"]) & (two["deal"]["place"] < one["deal"]["place"] + one["size"])
    free = lambda kept, m: ~F.exists(kept, lambda k: clash(k, m)) if not overlaps else F.lit(True)
    # The state holds no more than the deals that are given.
    chosen = F.aggregate("_found", F.array().cast(kind), lambda kept, m: F.when((F.size(kept) < most) & free(kept, m), F.array_append(kept, m)).otherwise(kept))
    guess = lambda m: F.struct(F.lit("bare").alias("form"), m["start"].alias("place"), F.lit("Happy Hour").alias("title"), F.substring(m["text"], 1, 100).alias("description"), F.lit(None).cast("array<string>").alias("days"), F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("end_time"), F.lit(True).alias("is_all_day"), F.lit(GUESS).alias("confidence")).cast(DEAL)
    guesses = F.slice(F.flatten(F.array(*[F.transform(matches(F.col("_text"), f"(?s:{p})"), guess) for p in BARE])), 1, most)
    deals = F.when(F.size("_found") > 0, F.transform(chosen, lambda m: m["deal"])).otherwise(guesses)
    return rows.select(*key, F.posexplode(deals).alias("pos", "deal")).select(*key, "pos", "deal.*")


def generic_deal(text: Column) -> Column:
    """One deal from the words happy hour or daily near a range of hours, by the first pattern that is found; null without one."""

    def read_one(low: Column) -> Column:
        part = lambda p, k: F.regexp_extract(low, p, k)
        deal = lambda p: F.struct(F.lit("Happy Hour").alias("title"), F.substring(part(p, 0), 1, 100).alias("description"), shown_time(part(p, 1)).alias("start_time"), shown_time(part(p, 2)).alias("end_time"), F.lit(LOOSE).alias("confidence"))
        return F.coalesce(*[F.when(low.rlike(p), deal(p)) for p in GENERIC])

    return let(F.lower(text), read_one)

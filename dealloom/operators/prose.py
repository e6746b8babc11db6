"""Deals from plain text: contexts of keywords, priced forms, rules of restaurants, removal of noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.functions.arrays import let
from dealloom.functions.deals import has_any
from dealloom.operators.extract import DAYS, matches, nearest_day
from dealloom.operators.rules import rule_errors

# Words that tell deals, noise, and forms of hours and priced lines.
KEYWORDS = ("happy hour", "happii hour", "drink specials", "bar specials", "cocktail hour", "wine hour", "discounted drinks", "deals", "all day happy", "daily specials")
NOISE = (
    "copyright", "privacy policy", "terms of service", "footer", "navigation", "header", "social media", "follow us", "newsletter", "careers", "gift cards", "reservations", "contact", "about us",
    "catering", "private dining", "events", "locations",
)
# Times: a range with dash or with "to", one of clock times without am and pm, and one up to the close.
RANGES = (
    r"(\d{1,2})\s*(:\d{2})?\s*(am|pm)?\s*[–\-~]\s*(\d{1,2})\s*(:\d{2})?\s*(am|pm)",
    r"(\d{1,2})\s*(:\d{2})?\s*(am|pm)?\s*to\s*(\d{1,2})\s*(:\d{2})?\s*(am|pm)",
    r"(\d{1,2})(:\d{2})()\s*[–\-~]\s*(\d{1,2})(:\d{2})()",
    r"(\d{1,2})\s*(:\d{2})?\s*(am|pm)\s*[–\-~]\s*(close)()()",
)
OPENING = (
    r"(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)[\s:]*\d{1,2}:\d{2}\s*[ap]m\s*[\-–]\s*\d{1,2}:\d{2}\s*[ap]m",
    r"Open\s+\d{1,2}:\d{2}\s*[ap]m\s*[\-–]\s*\d{1,2}:\d{2}\s*[ap]m",
    r"Hours?[\s:]+.*\d{1,2}:\d{2}\s*[ap]m\s*[\-–]\s*\d{1,2}:\d{2}\s*[ap]m",
    r"kitchen\s+hours?[\s:]+.*\d{1,2}:\d{2}\s*[ap]m\s*[\-–]\s*\d{1,2}:\d{2}\s*[ap]m",
    r"dining\s+hours?[\s:]+.*\d{1,2}:\d{2}\s*[ap]m\s*[\-–]\s*\d{1,2}:\d{2}\s*[ap]m",
    r"restaurant\s+hours?[\s:]+.*\d{1,2}:\d{2}\s*[ap]m\s*[\-–]\s*\d{1,2}:\d{2}\s*[ap]m",
)
DRINK_WORDS = ("cocktail", "spritz", "negroni", "martini", "wine", "chardonnay", "rosé", "pinot", "beer", "pilsner", "stout", "brewing")
FOOD_WORDS = ("food", "panino", "pizza", "oyster")
# Pattern, then the numbers of its groups: title, price, upper price, description (0: none).
PRICED = (
    (r"\$(\d+(?:\.\d{2})?)\s+(craft\s+cocktails?|artisanal\s+drinks?|signature\s+cocktails?|house\s+cocktails?)", 2, 1, 0, 0),
    (r"(\d+%|Half|50%)\s+off\s+([a-z\s]{3,30})", 2, 1, 0, 0),
    (r"\$(\d+(?:\.\d{2})?)\s+(wine|glasses?\s+of\s+wine|wine\s+flights?|by\s+the\s+glass)", 2, 1, 0, 0),
    (r"\$(\d+(?:\.\d{2})?)\s+([A-Z][A-Za-z\s&'-]{3,30}(?:cocktails?|martinis?|negronis?|spritzs?|mules?))", 2, 1, 0, 0),
    (r"\$(\d+(?:\.\d{2})?)\s+([a-z][a-z\s&'-]{3,30}(?:appetizers?|plates?|oysters?|shareables?))", 2, 1, 0, 0),
    (r"\$(\d+(?:\.\d{2})?)-\$(\d+(?:\.\d{2})?)\s+([a-z\s]{3,30})", 3, 1, 2, 0),
    (r"([A-Z][A-Z\s&'-]{3,30})\s+([a-z][^0-9\n]*?)\s{2,}(\d{1,2})(?:\s|$)", 1, 3, 0, 2),
    (r"([A-Z][A-Z\s&'-]{3,30})\s+([a-z][^$—]*?)\s*—\s*\$(\d+(?:\.\d{2})?)", 1, 3, 0, 2),
    (r"([A-Z][A-Z\s&'-]{3,30})\s*—\s*\$(\d+(?:\.\d{2})?)", 1, 2, 0, 0),
    (r"\$(\d+(?:\.\d{2})?)\s+each", 0, 1, 0, 0),
    (r"([A-Z][A-Z\s&'-]{3,30})\s+([a-z][^$\n]*?)\s+\$(\d+(?:\.\d{2})?)", 1, 3, 0, 2),
    (r"\$(\d+(?:\.\d{2})?)\s+([A-Z][A-Za-z\s&'-]{3,30})", 2, 1, 0, 0),
    (r"([A-Z][A-Z\s&'-]{3,30})\s{2,}(\d{1,2})(?:\s|$)", 1, 2, 0, 0),
    (r"(expertly\s+crafted|artfully\s+prepared|chef's\s+selection)\s+([a-z\s]{3,30})\s+for\s+\$(\d+(?:\.\d{2})?)", 2, 3, 0, 1),
)
# What a line has to hold for a form, by the form's number: forms that begin with words are slow to fail.
NEEDED = {2: r"(?i)\soff\s", 6: r"-\$", 7: r"\s\s\d", 8: "—", 9: "—", 10: "(?i)each", 11: r"\s\$\d", 13: r"\s\s\d", 14: r"(?i)\sfor\s+\$"}


def keyword_contexts(docs: DataFrame, key: Sequence[str], text: str = "text", words: Sequence[str] = KEYWORDS, around: int = 2) -> DataFrame:
    """Key, line and section: each line with a keyword and the lines around it; a text without such lines is one section, of line 0."""
    rows = docs.select(*key, F.col(text).alias("_text"), F.split(text, "\n").alias("_lines"))
    lines, n = F.col("_lines"), F.size("_lines")
    hits = F.filter(F.sequence(F.lit(1), n), lambda i: has_any(F.lower(F.element_at(lines, i)), tuple(words)))
    first = lambda i: F.greatest(i - around, F.lit(1))
    cut = F.transform(hits, lambda i: F.struct(i.alias("line"), F.array_join(F.slice(lines, first(i), F.least(i + around, n) - first(i) + 1), "\n").alias("section")))
    whole = F.array(F.struct(F.lit(0).alias("line"), F.col("_text").alias("section")))
    rows = rows.filter("trim(_text) <> ''").select(*key, F.explode(F.when(F.size(hits) > 0, cut).otherwise(whole)).alias("s"))
    return rows.select(*key, "s.line", "s.section")


def time_ranges(text: Column) -> Column:
    """Ranges of times in any of the usual forms, by their place: array of (start, text, form); of overlapping ones the earlier form stays."""
    tagged = lambda k: lambda m: F.struct(m["start"].alias("start"), m["text"].alias("text"), F.lit(k).alias("form"))
    found = F.concat(*[F.transform(matches(text, "(?i)" + p), tagged(k)) for k, p in enumerate(RANGES)])
    meet = lambda x, y: (x["start"] < y["start"] + F.length(y["text"])) & (y["start"] < x["start"] + F.length(x["text"])) & (x["form"] > y["form"])
    return F.get(F.transform(F.array(found), lambda all_: F.array_sort(F.filter(all_, lambda x: ~F.exists(all_, lambda y: meet(x, y))))), F.lit(0))


def text_deals(docs: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Deals of the contexts of each text: one for each range of times, with the nearest day; without times one for the first day.

    Minutes are kept. A range with one am or pm has it at both ends, one without any is pm. Equal
    deals of a text count once.
    """
    rows = keyword_contexts(docs, key, text)
    s = F.col("section")
    rows = rows.select(*key, "line", matches(s, DAYS).alias("days"), F.explode_outer(time_ranges(s)).alias("span"))

    def part(group: int) -> Column:
        """A group of the span's own form."""
        return F.coalesce(*[F.when(F.col("span.form") == k, F.regexp_extract("span.text", "(?i)" + p, group)) for k, p in enumerate(RANGES)])

    some = lambda c: F.nullif(c, F.lit(""))
    late = F.coalesce(some(part(6)), some(part(3)), F.lit("pm"))
    start = F.concat(part(1), part(2), F.lit(" "), F.coalesce(some(part(3)), late))
    end = F.when(F.lower(part(4)) == "close", "Close").otherwise(F.concat(part(4), part(5), F.lit(" "), late))
    timed = F.col("span").isNotNull()
    day = F.when(timed, nearest_day(F.col("span.start"), F.col("days"))).otherwise(F.get("days", F.lit(0))["text"])
    rows = rows.filter(timed | (F.size("days") > 0)).select(*key, "line", F.when(timed, start).alias("start_time"), F.when(timed, end).alias("end_time"), day.alias("day"))
    return rows.groupBy(*key, "start_time", "end_time", "day").agg(F.min("line").alias("line"))


def priced_forms(lines: DataFrame, key: Sequence[str], line: str = "line", section: str | None = None, low: float = 3, high: float = 50) -> DataFrame:
    """One row per form and match in each line: title, description, price as shown, kind.

    Shares (20 %, half) are always in range; of two prices both have to be. Titles under three
    characters, and those with minimum, each or order, are left out. A section of food or drinks
    tells the kind, else the words do.
    """
    rows = lines.select(*key, F.trim(line).alias("_line"), (F.col(section) if section else F.lit(None).cast("string")).alias("_section")).filter(F.length("_line") >= 5)
    kind = "array<struct<form:int,title:string,_one:string,_two:string,description:string>>"

    def found(k: int) -> Column:
        """The matches of a form with their parts; lines without what the form needs are not searched for it."""
        pattern, *places = "(?i)" + PRICED[k][0], *PRICED[k][1:]
        part = lambda m, g: F.trim(F.regexp_extract(m, pattern, g)) if g else F.lit(None).cast("string")

        def read(m: Column) -> Column:
            title, one, two, description = (part(m, g) for g in places)
            return F.struct(F.lit(k + 1).alias("form"), title.alias("title"), one.alias("_one"), two.alias("_two"), F.nullif(description, F.lit("")).alias("description"))

        all_of = F.transform(F.regexp_extract_all("_line", F.lit(pattern), F.lit(0)), read).cast(kind)
        return F.when(F.col("_line").rlike(NEEDED[k + 1]), all_of).otherwise(F.array().cast(kind)) if k + 1 in NEEDED else all_of

    rows = rows.select(*key, "_section", F.explode(F.flatten(F.array(*map(found, range(len(PRICED)))))).alias("f")).select(*key, "_section", "f.*")
    share = F.col("_one").rlike("(?i)%|half")
    one, two = F.col("_one").try_cast("double"), F.col("_two").try_cast("double")
    good = share | ((one >= low) & (F.coalesce(two, one) <= high))
    rows = rows.filter(good & (F.length("title") >= 3) & ~has_any(F.lower("title"), ("minimum", "each", "order")))
    words = F.lower(F.concat_ws(" ", "title", "description"))
    by_words = F.when(has_any(words, DRINK_WORDS), "drink").when(has_any(words, FOOD_WORDS), "food").otherwise("unknown")
    kind = F.when(F.col("_section") == "food", "food").when(F.col("_section").isin("cocktails", "drinks", "beer_wine"), "drink").otherwise(by_words)
    price = F.when(share, F.col("_one")).when(F.col("_two").isNotNull(), F.concat(F.lit("$"), "_one", F.lit("-$"), "_two")).otherwise(F.concat(F.lit("$"), "_one"))
    return rows.select(*key, "form", "title", "description", price.alias("price"), kind.alias("kind"))


def without_noise(text: Column, noise: Sequence[str] = NOISE, keep: Sequence[str] = KEYWORDS, around: int = 50) -> Column:
    """Text without the noise words, and without opening hours, in any of their forms, that have no keyword within so many characters."""
    less = text
    for word in noise:
        less = F.regexp_replace(less, f"(?i){word}", "")

    def without_hours(text: Column) -> Column:
        def cut(left: Column, m: Column) -> Column:
            near = F.substring(text, F.greatest(m["start"] - around, F.lit(0)) + 1, F.least(m["start"], F.lit(around)) + F.length(m["text"]) + around)
            return F.when(has_any(F.lower(near), tuple(keep)), left).otherwise(F.replace(left, m["text"], F.lit("")))

        # Of "Kitchen hours ..." and the "hours ..." in it only the whole counts.
        end = lambda m: m["start"] + F.length(m["text"])
        outer = lambda all_: F.filter(all_, lambda m: ~F.exists(all_, lambda x: (x["start"] < m["start"]) & (end(x) >= end(m))))
        found = let(F.concat(*[matches(text, "(?i)" + p) for p in OPENING]), lambda all_: F.array_sort(outer(all_)))
        return F.trim(F.aggregate(found, text, cut))

    # The words go one after the other, in texts that hold any; the rest is read from the shorter text, which is made once.
    return let(F.when(text.rlike("(?i)" + "|".join(noise)), less).otherwise(text) if noise else text, without_hours)


def ruled_deals(texts: DataFrame, rules: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Deals by each restaurant's own patterns: rules has slug, time_pattern (hour, am or pm, hour, am or pm), day_pattern and exclude.

    What matches exclude is removed first. Each range of hours is a deal with all days that the day
    pattern finds; without hours the days are one deal. A range with one am or pm has it at both
    ends, one without any is pm. The sizes of both tables decide how they are joined. Rules with a
    pattern that doesn't compile give nothing.
    """
    rules = rule_errors(rules, (), ("time_pattern", "day_pattern", "exclude")).filter("size(errors) = 0")
    rows = texts.join(rules.select("slug", "time_pattern", "day_pattern", "exclude"), "slug")
    body = F.when(F.col("exclude").isNotNull(), F.regexp_replace(F.col(text), F.concat(F.lit("(?i)"), "exclude"), F.lit(""))).otherwise(F.col(text))
    all_of = lambda p: F.coalesce(F.regexp_extract_all("_body", F.concat(F.lit("(?i)"), p), F.lit(0)), F.array().cast("array<string>"))
    rows = rows.withColumn("_body", body).withColumns({"_spans": all_of(F.col("time_pattern")), "_days": all_of(F.col("day_pattern"))})
    rows = rows.filter((F.size("_spans") > 0) | (F.size("_days") > 0)).select(*key, "time_pattern", "_days", F.explode_outer("_spans").alias("_span"))
    part = lambda g: F.nullif(F.get(F.regexp_extract_all("_span", F.concat(F.lit("(?i)"), "time_pattern"), F.lit(g)), F.lit(0)), F.lit(""))
    one, two = F.upper(part(2)), F.upper(part(4))
    start = F.concat_ws(" ", part(1), F.coalesce(one, two, F.lit("PM")))
    end = F.concat_ws(" ", part(3), F.coalesce(two, F.lit("PM")))
    timed = F.col("_span").isNotNull()
    return rows.select(*key, F.when(timed, start).alias("start_time"), F.when(timed, end).alias("end_time"), F.array_join("_days", ",").alias("days"))

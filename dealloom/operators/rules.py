"""Rules as tables: whether their patterns compile, what they do to deals one after the other, and deals from their named groups.

Rules of a restaurant meet its rows by an equality join on the restaurant, those for all restaurants
are a constant array. What a rule tests happens within the row, so no pattern meets rows that it
isn't meant for, and no row is compared with a table of patterns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.functions.deals import without_prices
from dealloom.functions.times import WEEK, day_list, shown_time

MOST_PATTERNS = 10_000  # distinct patterns that the driver compiles once
MOST_GENERAL = 1000  # rules for all restaurants


def _distinct(rules: DataFrame, columns: Sequence[str], most: int) -> list[str]:
    each = F.explode(F.array(*[F.col(c) for c in columns]))
    some = [r.p for r in rules.select(each.alias("p")).filter("p IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(some) > most:
        raise ValueError(f"more than {most} patterns: a table of patterns has to be short")
    return some


def compiled(rules: DataFrame, columns: Sequence[str], most: int = MOST_PATTERNS) -> DataFrame:
    """pattern, error (null if it compiles), n_groups and literal of each distinct pattern in the columns.

    The patterns are compiled once, on the driver, by the engine that will run them. literal is a
    text in lower case that every match holds ('' where none can be told).
    """
    spark = rules.sparkSession
    rows = []
    for p in _distinct(rules, columns, most):
        try:
            rows.append((p, None, spark._jvm.java.util.regex.Pattern.compile(p).matcher("").groupCount(), required_literal(p)))
        except Exception as e:  # the error of another language comes as it is
            reason = str(getattr(e, "java_exception", e)).split("\n")[0]
            rows.append((p, re.sub(r"^[\w.$]+: ", "", reason), 0, ""))
    return spark.createDataFrame(rows, "pattern string, error string, n_groups int, literal string")


def required_literal(pattern: str) -> str:
    """The longest run of plain characters that stands in every match, in lower case; '' where the pattern doesn't tell one."""
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return ""
    best, now = "", ""
    for kind, value in parsed:
        if str(kind) == "LITERAL" and 31 < value < 127:
            now += chr(value).lower()
            best = max(best, now, key=len)
        else:
            now = ""
    return best


def rule_errors(rules: DataFrame, required: Sequence[str] = ("name", "slug"), patterns: Sequence[str] = ("time_pattern", "day_pattern"), most: int = MOST_PATTERNS) -> DataFrame:
    """The rules table with an array of errors: missing fields, and patterns that do not compile. A null pattern is none."""
    bad = [r.pattern for r in compiled(rules, patterns, most).filter("error IS NOT NULL").collect()]
    missing = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"Missing required field: {c}")) for c in required]
    invalid = [F.when(F.col(c).isin(bad), F.lit(f"Invalid regex in {c}")) for c in patterns]
    return rules.withColumn("errors", F.filter(F.array(*missing, *invalid), lambda e: e.isNotNull()))


_EFFECTS = "ord int, pattern string, literal string, title_part string, new_title string, days array<string>, start_time string, end_time string, boost double, append string, prefix string, price string"
_DEAL = "struct<title:string,description:string,days:array<string>,start_time:string,end_time:string,confidence:double,prices:array<string>>"
_FIELDS = ("title", "description", "days", "start_time", "end_time", "confidence", "prices")


def _array(record: str) -> str:
    return f"array<struct<{record.replace(' ', ':').replace(',:', ',')}>>"


def _by_restaurant(rules: DataFrame, record: str, most: int) -> tuple[DataFrame, Column]:
    """Rules of each restaurant as one array in their order, and those for all as a constant."""
    fields = [f.split() for f in record.split(", ")]
    one = F.struct(*[(F.col(name) if name in rules.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields])
    own = rules.filter("slug IS NOT NULL").groupBy("slug").agg(F.array_sort(F.collect_list(one)).alias("_own"))
    general = rules.filter("slug IS NULL").select(F.to_json(one).alias("r")).limit(most + 1).collect()
    if len(general) > most:
        raise ValueError(f"more than {most} rules for all restaurants")
    whole = json.dumps([json.loads(r.r) for r in general])
    return own, F.from_json(F.lit(whole), _array(record))


def with_effects(deals: DataFrame, rules: DataFrame, first_only: bool = False, brackets: bool = False, most: int = MOST_PATTERNS) -> DataFrame:
    """Deals after the rules that they meet, in the order of ord; with first_only, after the first of them.

    A rule with a pattern meets the deals in whose title and description it is found, in any case; one
    with a title_part those whose title holds it; one with neither meets all. rules has slug (null: all
    restaurants), ord, and any of pattern, title_part, new_title, days, start_time, end_time, boost,
    append, prefix and price; what is null or not there has no effect. boost is added to the
    confidence, to 1 at most; append goes behind the description, prefix before it (with brackets
    around the rest, or a dash between); price is for deals without one. Prices that are listed apart
    leave the description where a rule was met. rule_order holds the rules that were met. A rule whose
    pattern doesn't compile meets nothing. Deals without a restaurant meet the general rules only.
    """
    if "pattern" in rules.columns:
        known = compiled(rules, ["pattern"], most)
        rules = rules.join(F.broadcast(known), "pattern", "left").filter("error IS NULL").drop("error", "n_groups")
    own, general = _by_restaurant(rules, _EFFECTS, MOST_GENERAL)
    rows = deals.join(own, "slug", "left")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    rows = rows.withColumns({"_said": text, "_low": F.lower(text), "_rules": F.array_sort(F.concat(general, F.coalesce("_own", F.array().cast(_array(_EFFECTS)))))})
    # The literal is looked for first; few rows come to the pattern itself.
    found = lambda r: F.coalesce(r["literal"] == "", F.lit(True)) | F.contains(F.col("_low"), r["literal"])
    met = lambda r: (r["pattern"].isNull() | (found(r) & F.rlike(F.col("_said"), F.concat(F.lit("(?i)"), r["pattern"])))) & (r["title_part"].isNull() | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lower(r["title_part"])))
    hits = F.filter("_rules", met)
    rows = rows.withColumn("_hits", F.slice(hits, 1, 1) if first_only else hits)

    def step(d: Column, r: Column) -> Column:
        some = lambda c: F.coalesce(d[c], F.lit("")) != ""
        days = F.filter(day_list(r["days"]), lambda x: x.isin(*WEEK))
        added = F.when(r["append"].isNull(), d["description"]).when(some("description"), F.concat(d["description"], r["append"])).otherwise(F.regexp_replace(r["append"], "^[ -]+|[ -]+$", ""))
        rest = F.concat(F.lit(" ("), added, F.lit(")")) if brackets else F.concat(F.lit(" - "), added)
        led = F.when(r["prefix"].isNull(), added).when(F.coalesce(added, F.lit("")) != "", F.concat(r["prefix"], rest)).otherwise(r["prefix"])
        prices = F.when((F.coalesce(F.size(d["prices"]), F.lit(0)) <= 0) & r["price"].isNotNull(), F.array(r["price"])).otherwise(d["prices"])
        cleaned = F.when(F.size(prices) > 0, without_prices(led, prices)).otherwise(led)
        return F.struct(
            F.coalesce(r["new_title"], d["title"]).alias("title"), cleaned.alias("description"), F.when(r["days"].isNotNull(), days).otherwise(d["days"]).alias("days"), F.coalesce(r["start_time"], d["start_time"]).alias("start_time"),
            F.coalesce(r["end_time"], d["end_time"]).alias("end_time"), F.when(d["confidence"].isNotNull(), F.least(F.lit(1.0), d["confidence"] + F.coalesce(r["boost"], F.lit(0.0)))).alias("confidence"), prices.alias("prices"),
        ).cast(_DEAL)

    rows = rows.withColumn("_deal", F.aggregate("_hits", F.struct(*_FIELDS).cast(_DEAL), step))
    kept = [f"_deal.{c}" if c in _FIELDS else c for c in deals.columns]
    return rows.select(*kept, F.transform("_hits", lambda r: r["ord"]).alias("rule_order"))


_GROUPS = "ord int, kind string, pattern string, groups array<string>, title string, days array<string>, confidence double"
_PAIRS = (("bar_start_time", "bar_end_time", "Happy Hour at the Bar", 0.9), ("tables_start_time", "tables_end_time", "Happy Hour at Tables", 0.9), ("start_time", "end_time", None, 0.8))
_FOUND = "array<struct<ord:int,at:int,part:int,title:string,days:array<string>,start_time:string,end_time:string,is_all_day:boolean,confidence:double>>"


def _title(days: Column, all_day: Column) -> Column:
    n, name = F.size(days), F.initcap(F.get(days, F.lit(0)))
    weekdays = (n == 5) & F.array_contains(days, "monday") & F.array_contains(days, "friday")
    full = F.when(n == 7, "All Day Happy Hour").when(weekdays, "Weekday Happy Hour").when(n == 1, F.concat(name, F.lit(" Special"))).otherwise("Happy Hour Special")
    return F.when(all_day, full).when(n == 7, "Daily Happy Hour").when(weekdays, "Weekday Happy Hour").when(n == 1, F.concat(name, F.lit(" Happy Hour"))).otherwise("Happy Hour")


def group_errors(rules: DataFrame, most: int = MOST_PATTERNS) -> DataFrame:
    """The rules of named groups with an error: a pattern that is missing or doesn't compile, fewer groups than names, no names; null if all is well."""
    known = F.broadcast(compiled(rules, ["pattern"], most).select("pattern", F.col("error").alias("_error"), "n_groups"))
    few = F.coalesce(F.size("groups"), F.lit(0)) > F.col("n_groups")
    error = F.when(F.col("pattern").isNull(), "Missing pattern").when(F.col("_error").isNotNull(), F.concat(F.lit("Invalid regex: "), "_error")).when(F.coalesce(F.size("groups"), F.lit(0)) <= 0, "No groups").when(few, "More names than groups")
    return rules.join(known, "pattern", "left").withColumn("error", error).drop("_error", "n_groups")


def grouped_deals(texts: DataFrame, rules: DataFrame, key: Sequence[str], text: str = "text", most: int = MOST_PATTERNS) -> DataFrame:
    """Deals by rules whose groups have names: key, pos, title, days, start_time, end_time, is_all_day, confidence.

    A rule of kind deal gives one deal for each match and pair of times: start_time and end_time, and those
    of the bar and of the tables, so one match may give several. Rules of kind time and day give loose
    parts, which make one deal where no rule of kind deal found any: the first two times, all days, every
    day if the text says so. A start without am or pm has that of its end, an end without is pm. Rules
    with an error (group_errors) give nothing; the others of their restaurant still do.
    """
    good = group_errors(rules, most).filter("error IS NULL").drop("error")
    own, general = _by_restaurant(good, _GROUPS, MOST_GENERAL)
    rows = texts.join(own, "slug", "left").select(*key, F.col(text).alias("_text"), F.array_sort(F.concat(general, F.coalesce("_own", F.array().cast(_array(_GROUPS))))).alias("_rules"))
    of_kind = lambda kind: F.filter("_rules", lambda r: r["kind"] == kind)
    all_of = lambda r, n: F.regexp_extract_all(F.col("_text"), F.concat(F.lit("(?i)"), r["pattern"]), n)

    def named(r: Column, name: str) -> Column:
        n = F.array_position(r["groups"], name).cast("int")
        return F.when(n > 0, all_of(r, n)).otherwise(F.array().cast("array<string>"))

    half = r"(?i)[ap]\.?m\.?\s*$"
    late = lambda t: F.when(t.rlike(half) | ~t.rlike(r"^\s*\d"), t).otherwise(F.concat(F.trim(t), F.lit("pm")))
    early = lambda s, e: F.when(s.rlike(half) | ~s.rlike(r"^\s*\d"), s).otherwise(F.concat(F.trim(s), F.coalesce(F.nullif(F.regexp_extract(e, r"(?i)([ap]m)\s*$", 1), F.lit("")), F.lit("pm"))))

    def pairs(r: Column) -> Column:
        out = []
        for part, (first, last, title, sure) in enumerate(_PAIRS):
            both = F.zip_with(named(r, first), named(r, last), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
            name = F.lit(title) if title else F.coalesce(r["title"], F.lit("Happy Hour"))
            deal = lambda p, i, name=name, part=part, sure=sure: F.struct(r["ord"].alias("ord"), i.alias("at"), F.lit(part).alias("part"), name.alias("title"), F.coalesce(day_list(r["days"]), F.array().cast("array<string>")).alias("days"), shown_time(early(p["s"], p["e"])).alias("start_time"), shown_time(late(p["e"])).alias("end_time"), F.lit(False).alias("is_all_day"), F.coalesce(r["confidence"], F.lit(sure)).alias("confidence"))
            full = F.filter(both, lambda p: (F.coalesce(p["s"], F.lit("")) != "") & (F.coalesce(p["e"], F.lit("")) != ""))
            out.append(F.transform(full, _two(deal)).cast(_FOUND))
        return F.concat(*out)

    def loose(kind: str) -> Column:
        """Values of the named groups, match by match."""
        values = lambda r: F.flatten(F.transform(r["groups"], lambda _, g: F.transform(all_of(r, g + 1), lambda v, i: F.struct(i.alias("at"), g.alias("g"), v.alias("v")))))
        return F.filter(F.flatten(F.transform(of_kind(kind), lambda r: F.transform(F.array_sort(values(r)), lambda x: x["v"]))), lambda v: v != "")

    rows = rows.withColumns({"_deals": F.array_sort(F.flatten(F.transform(of_kind("deal"), pairs))), "_times": loose("time"), "_days": F.filter(day_list(F.transform(loose("day"), lambda d: F.substring(F.lower(F.trim(d)), 1, 3))), lambda d: d.isin(*WEEK))})
    times, low = F.col("_times"), F.lower("_text")
    ranged = F.size(times) >= 2
    daily = ranged & (F.size("_days") == 0) & (low.contains("every day") | low.contains("daily"))
    rows = rows.withColumns({"_all_day": low.contains("all day"), "_on": F.when(daily, F.array(*map(F.lit, WEEK))).otherwise(F.col("_days"))})
    start, end = F.get(times, F.lit(0)), F.get(times, F.lit(1))
    part = F.struct(F.lit(0).alias("ord"), F.lit(0).alias("at"), F.lit(0).alias("part"), _title(F.col("_on"), F.col("_all_day")).alias("title"), F.col("_on").alias("days"), F.when(ranged, shown_time(early(start, end))).alias("start_time"), F.when(ranged, shown_time(late(end))).alias("end_time"), F.col("_all_day").alias("is_all_day"), F.lit(0.8).alias("confidence"))
    assembled = F.when((F.size(times) > 0) & (ranged | (F.size("_on") > 0)), F.array(part).cast(_FOUND)).otherwise(F.array().cast(_FOUND))
    chosen = F.when(F.size("_deals") > 0, F.col("_deals")).otherwise(assembled)
    out = rows.select(*key, F.posexplode(chosen).alias("pos", "d"))
    return out.select(*key, "pos", *[f"d.{c}" for c in ("title", "days", "start_time", "end_time", "is_all_day", "confidence")])


def _two(f):
    """A function of exactly two parameters, as transform counts them."""
    return lambda x, i: f(x, i)

"""Validators of deals and restaurants, what they let through, and contacts that replace others only where they are better."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.operators.quality import issue
from dealloom.operators.venue import NETWORKS, valid_handle
from dealloom.sources.tables import checkpointed

# Usual forms of times, prices, addresses of the web and of streets, and the limits.
TIME_FORMS = r"(?i)\d{1,2}:\d{2}\s*(AM|PM)|\d{1,2}\s*(AM|PM)|All Day|Close|Open"
PRICE_FORMS = r"(?i)\$\d+(\.\d{2})?|\$\d+-\d+|\d+¢|free"
URL_FORM = r"(?i)^https?://[^\s/$.?#].[^\s]*$"
STREET_WORDS = r"(?i)\b(st|street|ave|avenue|blvd|rd|road|drive|way|lane)\b"
STALE_DAYS = 7
MOST_FAILURES = 3


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def deal_issues() -> Column:
    """Array of messages on a deal (title, start_time, end_time, prices, days, is_all_day, confidence); empty if all is well.

    A null confidence is no fault; one out of the range from 0 to 1 is. A deal without days, times and the flag is an empty one.
    """
    wrong = lambda c, name: F.when(~_blank(F.col(c)) & ~F.col(c).rlike(TIME_FORMS), F.concat(F.lit(f"Invalid {name} time format: "), c))
    prices = F.transform(F.filter(F.coalesce("prices", F.array().cast("array<string>")), lambda p: ~_blank(p) & ~p.rlike(PRICE_FORMS)), lambda p: F.concat(F.lit("Invalid price format: "), p))
    empty = (F.coalesce(F.size("days"), F.lit(0)) <= 0) & ~F.coalesce("is_all_day", F.lit(False)) & _blank(F.col("start_time")) & _blank(F.col("end_time"))
    out = F.array(F.when(F.length(F.trim(F.coalesce("title", F.lit("")))) < 3, "Title is too short or empty"), wrong("start_time", "start"), wrong("end_time", "end"))
    rest = F.array(F.when(empty, "Completely empty deal - no days, times, or all-day flag"), F.when(~F.col("confidence").between(0, 1), F.concat(F.lit("Confidence score out of range: "), F.col("confidence").cast("string"))))
    return F.array_compact(F.concat(out, prices, rest))


def replaced_live(live: DataFrame, found: DataFrame, by: str = "slug") -> DataFrame:
    """Live deals after a run: those found without an issue take the place of all live deals of their restaurant.

    A restaurant of which nothing found is free of issues keeps its live deals. is_new tells which
    rows are from the run. Both tables have the same columns.
    """
    good = found.withColumn("_issues", deal_issues()).filter("size(_issues) = 0").drop("_issues")
    kept = live.join(good.select(by).distinct(), by, "left_anti").select(live.columns)
    return kept.withColumn("is_new", F.lit(False)).unionByName(good.select(live.columns).withColumn("is_new", F.lit(True)))


def restaurant_issues(as_of: Column) -> list[Column]:
    """Issues of a restaurant (name, website, address, deals_last_updated, failures) at a time."""
    old = F.datediff(as_of, F.col("deals_last_updated"))
    return [
        issue(F.length(F.trim(F.coalesce("name", F.lit("")))) < 2, "error", "Restaurant name is missing or too short"),
        issue(~_blank(F.col("website")) & ~F.col("website").rlike(URL_FORM), "warning", "Website URL appears invalid"),
        issue(~_blank(F.col("address")) & ~(F.col("address").rlike(r"\d") & F.col("address").rlike(STREET_WORDS)), "warning", "Address format seems unusual"),
        F.when(old > STALE_DAYS, F.struct(F.lit("warning").alias("level"), F.concat(F.lit("Deal data is "), old.cast("string"), F.lit(" days old")).alias("message"))),
        F.when(F.col("failures") > MOST_FAILURES, F.struct(F.lit("error").alias("level"), F.concat(F.lit("Scraping has failed "), F.col("failures").cast("string"), F.lit(" times consecutively")).alias("message"))),
    ]


def merged_contacts(base: DataFrame, found: DataFrame, on: str, fields: Sequence[str], networks: Sequence[str] = tuple(NETWORKS)) -> DataFrame:
    """base with contacts that were found: plain fields take what is new and not empty, handles only what is valid or fills a gap; handles that are not valid go in the end."""
    some = lambda c: F.when(~_blank(F.col(c)), F.col(c))
    new = found.select(on, *[F.col(c).alias(f"_new_{c}") for c in (*fields, *networks)])
    rows = base.join(new, on, "left")
    plain = {c: F.coalesce(some(f"_new_{c}"), F.col(c)) for c in fields}
    # A new handle that isn't valid would go at once, so the old one counts if it is valid.
    handles = {c: F.coalesce(F.when(valid_handle(some(f"_new_{c}"), c).isNotNull(), F.col(f"_new_{c}")), F.when(valid_handle(some(c), c).isNotNull(), F.col(c))) for c in networks}
    return rows.withColumns(plain | handles).drop(*[f"_new_{c}" for c in (*fields, *networks)])


def redirected(rows: DataFrame, redirects: DataFrame, urls: str = "urls", website: str = "website", most: int = 1000) -> DataFrame:
    """website and the array of addresses after permanent redirects (old, new); the order of the array stays, repeats that arise go.

    A short table of redirects is broadcast as one map, which is searched from end to end; a longer one
    meets the addresses as rows, which are numbered behind a checkpoint.
    """
    if redirects.count() <= most:
        table = redirects.groupBy("old").agg(F.min("new").alias("new"))
        one = table.agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_to")).withColumn("_all", F.lit(1))
        to = lambda u: F.coalesce(F.try_element_at("_to", u), u)
        found = rows.withColumn("_all", F.lit(1)).join(F.broadcast(one), "_all")
        return found.withColumns({website: to(F.col(website)), urls: F.array_distinct(F.transform(urls, to))}).select(rows.columns)
    table = redirects.groupBy("old").agg(F.min("new").alias("new"))
    marked = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))
    each = marked.select("_row", F.posexplode(urls).alias("_pos", "old")).join(table, "old", "left").select("_row", F.struct("_pos", F.coalesce("new", "old").alias("u")).alias("x"))
    again = each.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["u"]).alias("_urls"))
    out = marked.join(again, "_row", "left").join(table.withColumnRenamed("old", website), website, "left")
    return out.withColumns({website: F.coalesce("new", website), urls: F.when(F.col(urls).isNotNull(), F.array_distinct(F.coalesce("_urls", urls)))}).select(rows.columns)

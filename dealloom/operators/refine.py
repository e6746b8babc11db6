"""Raw extractions to schedules, menus and public deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.functions import deals as D
from dealloom.functions import times as T

MENU = ("item_count", "categories", "menu_type", "price_range")


def with_schedule_id(raw: DataFrame) -> DataFrame:
    """raw (restaurant_slug, raw_title, raw_description, raw_times, raw_days, ...) with its schedule's fields.

    Rows without a slug have no schedule and are left out; missing times are null.
    """
    days = T.day_list(F.coalesce("raw_days", F.array().cast("array<string>")))
    out = raw.filter("restaurant_slug IS NOT NULL AND restaurant_slug <> ''").withColumns(
        {"days": days, "start_time": T.time_24h(F.get("raw_times", F.lit(0))), "end_time": T.time_24h(F.get("raw_times", F.lit(1)))}
    )
    out = out.withColumn("deal_type", D.deal_kind(F.col("raw_title"), F.col("raw_description"), F.col("days")))
    day_key = F.when(F.size("days") > 0, F.array_join(F.array_sort("days"), "-")).otherwise("unknown")
    either = lambda c: F.coalesce(c, F.lit("any"))
    key = F.concat_ws("-", "restaurant_slug", "deal_type", day_key, either("start_time"), either("end_time"))
    present = (F.col("raw_title") != "", F.size("raw_days") > 0, F.size("raw_times") > 0, F.col("source_url") != "")
    return out.withColumns({"schedule_id": key, "data_quality": D.quality_tier(F.col("confidence_score"), *present)})


def schedules(keyed: DataFrame, **more: Column) -> DataFrame:
    """One row per schedule: the first raw row's fields, counts and means of all, the first source, and more aggregates by name.

    Which raw rows a schedule has stays a relation (with_schedule_id), so no list grows with a group:
    all is one aggregation with partial sums on the map side.
    """
    first = F.struct("restaurant_slug", "deal_type", "days", "start_time", "end_time", "raw_title", "raw_description", "data_quality", "source_url")
    out = keyed.groupBy("schedule_id").agg(
        F.min_by(first, "seq").alias("f"), F.count("*").alias("n_raw"), F.avg("confidence_score").alias("average_confidence"),
        F.max(F.substring(F.col("extracted_at").cast("string"), 1, 10)).alias("last_verified"),
        *(c.alias(name) for name, c in more.items()),
    )
    kind = F.initcap(F.replace(F.col("f.deal_type"), F.lit("_"), F.lit(" ")))
    return out.select(
        F.col("schedule_id"), "f.restaurant_slug", "f.deal_type", F.coalesce(D.clean_title(F.col("f.raw_title")), kind).alias("name"), "f.days", "f.start_time", "f.end_time",
        D.all_day(F.col("f.raw_title"), F.col("f.raw_description")).alias("is_all_day"), "f.data_quality", F.col("f.source_url").alias("menu_url"), "n_raw", "average_confidence", "last_verified", *more,
    )


def consistent(rows: DataFrame) -> DataFrame:
    """Schedules with a slug and some day or time."""
    return rows.filter((F.col("restaurant_slug") != "") & ((F.size("days") > 0) | F.col("start_time").isNotNull() | F.col("end_time").isNotNull()))


def with_items(keyed: DataFrame) -> DataFrame:
    """The priced items of each raw row."""
    return keyed.withColumn("items", F.filter(F.transform("raw_prices", D.price_item), lambda x: x.isNotNull()))


def last_items() -> Column:
    """The items of the last raw row that has some; null if none has."""
    return F.max_by("items", F.when(F.size("items") > 0, F.col("seq")))


def menus(keyed: DataFrame) -> DataFrame:
    """The last raw row with prices gives a schedule its menu: items, kind, categories and price range."""
    return with_menu(with_items(keyed).groupBy("schedule_id").agg(last_items().alias("items")).filter("items IS NOT NULL")).select("schedule_id", "items", *MENU)


def with_menu(rows: DataFrame) -> DataFrame:
    """Kind, categories and price range of the items; null where items is null."""
    prices = F.transform("items", lambda x: x["price"])
    whole = lambda c: F.bround(c, 0).cast("int").cast("string")
    return rows.withColumns({
        "item_count": F.when(F.col("items").isNotNull(), F.size("items")), "categories": F.array_sort(F.array_distinct(F.transform("items", lambda x: x["category"]))),
        "menu_type": F.when(F.col("items").isNotNull(), D.menu_kind(F.transform("items", lambda x: x["category"]))),
        "price_range": F.concat(F.lit("$"), whole(F.array_min(prices)), F.lit("-"), whole(F.array_max(prices))),
    })


def public_deals(rows: DataFrame, top: int = 3) -> DataFrame:
    """Schedules with their menus as shown: label, the cheapest items, confidence tier."""
    cheap = F.slice(F.array_sort(F.transform("items", lambda x: F.struct(x["price"].alias("price"), x["name"].alias("name")))), 1, top)
    shown = F.transform(cheap, lambda x: F.concat(F.lit("$"), F.bround(x["price"], 0).cast("int").cast("string"), F.lit(" "), x["name"]))
    return rows.select(
        F.col("schedule_id").alias("id"), "restaurant_slug", F.initcap(F.replace("restaurant_slug", F.lit("-"), F.lit(" "))).alias("restaurant_name"), F.col("name").alias("deal_name"), "deal_type",
        T.schedule_label(F.col("days"), F.col("start_time"), F.col("end_time")).alias("when"), F.coalesce(F.array_join(shown, "; "), F.lit("")).alias("highlights"), F.col("price_range").alias("savings_range"),
        D.tier(F.coalesce("average_confidence", F.lit(0.5))).alias("confidence"), "last_verified", "menu_url",
    )


def public_summary(public: DataFrame) -> DataFrame:
    """Totals by kind of deal, with the tiers of confidence."""
    count = lambda t: F.count_if(F.col("confidence") == t).alias(t)
    return public.groupBy("deal_type").agg(F.count("*").alias("n_deals"), F.countDistinct("restaurant_slug").alias("n_restaurants"), *map(count, ("high", "medium", "low")))


def refined(raw: DataFrame) -> DataFrame:
    """Raw extractions to public deals: one scan and one aggregation give both the schedules and their menus."""
    return public_deals(with_menu(consistent(schedules(with_items(with_schedule_id(raw)), items=last_items()))))

"""Menu lines to priced items, price bands and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper ends of the three lower bands by kind of menu.
BANDS = {"happy_hour": (12, 18, 28), "brunch": (16, 24, 35), "lunch": (14, 22, 32), "wine": (10, 15, 25), "dinner": (18, 28, 40)}


def amount(text: Column) -> Column:
    """Number of a price text without $ and commas; 0 for anything else."""
    return F.coalesce(F.regexp_replace(text, r"[$,]", "").try_cast("double"), F.lit(0.0))


def with_section(lines: DataFrame, doc: str = "page_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """The last header above each line; a header is a line without a price."""
    header = F.when(~F.col(line).rlike(r"\$\d"), F.trim(line))
    frame = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(frame))


def price_items(lines: DataFrame, line: str = "line", low: float = 3, high: float = 200, longest: int = 200) -> DataFrame:
    """Lines with a price within limits, as item and price; catering and group lines and very long lines are left out."""
    price = F.regexp_extract(line, r"\$(\d+(?:\.\d{2})?)", 1).try_cast("double")
    rows = lines.filter((F.length(line) <= longest) & ~F.lower(F.col(line)).rlike("catering|per group|private event"))
    rows = rows.withColumn("price", price).filter(F.col("price").between(low, high))
    return rows.withColumn("item", F.trim(F.regexp_replace(line, r"\s*\$\d+(?:\.\d{2})?.*$", "")))


def _cut(name: str, k: int) -> Column:
    out = F
    for kind, ends in BANDS.items():
        if kind != "dinner":
            out = out.when(F.col(name) == kind, ends[k])
    return out.otherwise(BANDS["dinner"][k])


def band(menu_type: str, average: str, highest: str, items: str) -> Column:
    """$ to $$$$ by the average, one up for a very dear item, and $$$$ at the high end."""
    one, two, three = (_cut(menu_type, k) for k in range(3))
    base = F.when(F.col(average) <= one, 1).when(F.col(average) <= two, 2).when(F.col(average) <= three, 3).otherwise(4)
    dear = (base < 3) & (F.col(highest) > three)
    n = F.when((F.col(average) == 0) | (F.col(items) == 0), 1).when(dear, base + 1).when((F.col(highest) > 60) & (F.col(average) > 35), 4).otherwise(base)
    return F.repeat(F.lit("$"), n.cast("int"))


def page_statistics(items: DataFrame, *by: str) -> DataFrame:
    """Items and average, least and highest price below 1000 of each page, with the plain band."""
    out = items.filter("price > 0 AND price < 1000").groupBy(*by).agg(F.count("*").alias("n_items"), F.avg("price").alias("average"), F.min("price").alias("lowest"), F.max("price").alias("highest"))
    plain = F.when(F.col("average") < 15, "$").when(F.col("average") < 25, "$$").when(F.col("average") < 40, "$$$").otherwise("$$$$")
    return out.withColumn("page_band", plain)


def restaurant_summary(pages: DataFrame) -> DataFrame:
    """Per restaurant: the band of its dinner menus, else its highest band, and means over its pages."""
    banded = pages.withColumn("band", band("menu_type", "average", "highest", "n_items"))
    dinner = F.max(F.when(F.col("menu_type") == "dinner", F.col("band")))
    return banded.groupBy("slug").agg(
        F.coalesce(dinner, F.max("band")).alias("overall_band"), F.avg(F.when(F.col("average") > 0, F.col("average"))).alias("average"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.sum("n_items").alias("n_items"), F.array_join(F.array_sort(F.collect_set("menu_type")), ",").alias("menu_types"),
    )


def band_maps(pages: DataFrame) -> DataFrame:
    """Per restaurant: a map of each kind of menu to the band of its last page, the overall band from that map, and the range of page averages."""
    banded = pages.withColumn("band", band("menu_type", "average", "highest", "n_items"))
    some = F.when(F.col("average") > 0, F.col("average"))
    kinds = banded.groupBy("slug", "menu_type").agg(F.max_by("band", "page_id").alias("band"), F.min(some).alias("least"), F.max(some).alias("most"), F.sum("n_items").alias("n_items"))
    out = kinds.groupBy("slug").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("menu_type", "band")))).alias("bands"), F.min("least").alias("least_average"), F.max("most").alias("most_average"), F.sum("n_items").alias("n_items"))
    return out.withColumn("overall_band", F.coalesce(F.try_element_at("bands", F.lit("dinner")), F.array_max(F.map_values("bands"))))


def deals_in_range(deals: DataFrame, low: float = 3, high: float = 50, column: str = "prices") -> DataFrame:
    """Prices of an array with a dollar sign in front, within limits; blank and unreadable ones stay."""
    signed = F.transform(column, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("$"), p)).otherwise(p))
    value = lambda p: F.regexp_replace(p, r"[$,]", "").try_cast("double")
    return deals.withColumn(column, F.filter(signed, lambda p: value(p).isNull() | value(p).between(low, high)))


# Estimates by price range ("" stands for any other) and what a cuisine adds, where the first hit counts.
ESTIMATES = {
    "drink": ({"$$$$": 14.0, "$$$": 11.0, "$$": 8.0, "": 6.0}, ((("steakhouse", "brazilian", "japanese"), 2.0), (("cocktail", "bar"), 1.0), (("mexican", "asian"), -0.5))),
    "food": ({"$$$$": 18.0, "$$$": 14.0, "$$": 11.0, "": 8.0}, ((("steakhouse", "brazilian"), 3.0), (("japanese", "sushi"), 2.0), (("italian", "mediterranean"), 1.0), (("mexican", "asian"), -1.0))),
}
LIGHT_FOOD = (("cocktail", "bar"), -2.0)
# Words that tell a drink or food, words of a deal's type, and the highest price of a drink that nothing tells.
DRINK_WORDS = ("drink", "cocktail", "beer", "wine", "beverage", "martini", "margarita", "spirits", "liquor", "bourbon", "whiskey", "vodka", "rum", "gin")
FOOD_WORDS = ("food", "appetizer", "plate", "dish", "entree", "meal", "burger", "sandwich", "salad", "pizza", "wings", "tacos", "nachos", "fries")
DRINK_TYPES, FOOD_TYPES = ("drink", "beverage"), ("food", "appetizer")
DRINK_PRICE = 10


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def estimated_price(kind: str, price_range: Column, cuisine: Column, name: Column | None = None, names: tuple[tuple[tuple[str, ...], float], ...] = ()) -> Column:
    """A price of a drink or of food (kind) by price range and cuisine; names holds (words of a restaurant's name, change). A null range is '$$'."""
    base, changes = ESTIMATES[kind]
    shown = F.coalesce(price_range, F.lit("$$"))
    price = F.coalesce(*[F.when(shown == k, v) for k, v in base.items() if k], F.lit(base[""]))
    change = lambda text, table: F.coalesce(*[F.when(_holds(text, words), v) for words, v in table], F.lit(0.0))
    low = F.lower(F.coalesce(cuisine, F.lit("")))
    price = price + change(low, changes)
    if kind == "food":
        price = price + change(low, (LIGHT_FOOD,))
    return price + change(F.lower(F.coalesce(name, F.lit(""))), names) if names else price


def deal_kinds(deals: DataFrame) -> DataFrame:
    """deals (price, title, description, deal_type) with amount, is_drink and is_food.

    The amount is the first dollar price of the first of price, title and description that is not
    empty. Words of the title and description tell the kind (both, if both occur), else the deal's type, else the amount.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("price", "title", "description")])
    amount_ = F.regexp_extract(said, r"\$([0-9]+(?:\.[0-9]{2})?)", 1).try_cast("double")
    words, kind = F.lower(F.concat_ws(" ", text("description"), text("title"))), F.lower(text("deal_type"))
    drink, food = _holds(words, DRINK_WORDS), _holds(words, FOOD_WORDS)
    by_type = F.when(_holds(kind, DRINK_TYPES), True).when(_holds(kind, FOOD_TYPES), False).otherwise(amount_ <= DRINK_PRICE)
    none = ~drink & ~food
    return deals.withColumn("amount", amount_).withColumns({"is_drink": drink | (none & by_type), "is_food": food | (none & ~by_type)})


def average_prices(restaurants: DataFrame, deals: DataFrame, key: str = "slug") -> DataFrame:
    """Each restaurant's mean drink and food price over its deals; one with deals but without such a price has an estimate, one without deals null.

    restaurants has the key, price_range, cuisine and name. Deals are summed before they join.
    """
    priced = deal_kinds(deals)
    n = priced.groupBy(key).agg(F.count("*").alias("n_deals"), *[F.round(F.avg(F.when(F.col(f"is_{k}"), F.col("amount"))), 2).alias(f"_{k}") for k in ESTIMATES])
    out = restaurants.join(n, key, "left").withColumn("n_deals", F.coalesce("n_deals", F.lit(0)))
    price = lambda k: F.when(F.col("n_deals") > 0, F.coalesce(f"_{k}", estimated_price(k, F.col("price_range"), F.col("cuisine"))))
    return out.select(key, "n_deals", *[price(k).alias(f"{k}_price") for k in ESTIMATES])

"""Titles, kinds, categories, prices, keys and scores of deals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell a kind of deal, in order of precedence.
KIND_WORDS = {
    "bottomless": ("bottomless", "unlimited"),
    "brunch": ("brunch", "breakfast", "mimosa"),
    "prix_fixe": ("prix fixe", "tasting menu", "chef"),
    "game_day": ("game day", "football", "sports"),
    "trivia": ("trivia", "quiz"),
    "industry_night": ("industry", "service"),
    "late_night": ("late night", "midnight"),
    "early_bird": ("early bird", "sunset"),
}
# Words that tell the category of a menu item, in order of precedence.
CATEGORY_WORDS = {
    "cocktails": ("cocktail", "martini", "margarita", "mojito", "negroni", "old fashioned"),
    "wine": ("wine", "chardonnay", "pinot", "cabernet", "merlot", "rosé", "glass"),
    "beer": ("beer", "ipa", "lager", "ale", "stout", "pint", "draft"),
    "appetizers": ("appetizer", "starter", "small plate", "shareables", "apps"),
    "entrees": ("entree", "main", "dinner", "lunch", "burger", "steak", "chicken"),
    "oysters": ("oyster", "shellfish", "raw bar"),
    "tacos": ("taco", "quesadilla", "burrito"),
    "pizza": ("pizza", "flatbread"),
    "sushi": ("sushi", "sashimi", "roll", "nigiri"),
}
DRINKS = ("cocktails", "wine", "beer", "spirits")
FOOD = ("appetizers", "entrees", "oysters", "tacos", "pizza", "sushi")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def first_match(text: Column, table: dict[str, tuple[str, ...]], otherwise: Column | str) -> Column:
    """The first name of the table with a word in the text."""
    out = F
    for name, words in table.items():
        out = out.when(has_any(text, words), name)
    return out.otherwise(otherwise)


def clean_title(title: Column) -> Column:
    """White space collapsed, labels of times and days cut off; null where nothing is left."""
    t = F.regexp_replace(F.trim(F.regexp_replace(title, r"\s+", " ")), r"(?i)^Time:\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\s*\|\s*Days:.*$", ""), r"(?i)\s*\|\s*Time:.*$", "")
    return F.nullif(F.trim(t), F.lit(""))


def all_day(title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, description))
    return text.rlike("all day|all-day|24 hours|always")


def deal_kind(title: Column, description: Column, days: Column, empty_is_weekend: bool = False) -> Column:
    """Kind of a deal by its words, then by its days.

    Without days a deal is no weekend deal, unless empty_is_weekend asks for it.
    """
    text = F.lower(F.concat_ws(" ", title, description))
    one = lambda day, word: (F.size(days) == 1) & F.array_contains(days, day) & text.contains(word)
    weekend = F.forall(days, lambda d: d.isin("saturday", "sunday"))
    weekend = weekend if empty_is_weekend else weekend & (F.size(days) > 0)
    by_day = F.when(one("tuesday", "taco") | one("wednesday", "wine"), "daily_special").when(weekend, "weekend").otherwise("happy_hour")
    return first_match(text, KIND_WORDS, by_day)


def category(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.isNull() | (t == ""), "unknown").otherwise(first_match(t, CATEGORY_WORDS, "unknown"))


def price_item(text: Column) -> Column:
    """Name, category and price of '$5 draft beer'; null where no price is found."""
    found = F.regexp_extract(text, r"\$?(\d+(?:\.\d{2})?)", 0)
    return F.when(
        found != "",
        F.struct(F.trim(F.replace(text, found, F.lit(""))).alias("name"), category(text).alias("category"), F.regexp_extract(text, r"\$?(\d+(?:\.\d{2})?)", 1).cast("double").alias("price")),
    )


def menu_kind(categories: Column) -> Column:
    drinks, food = F.exists(categories, lambda c: c.isin(*DRINKS)), F.exists(categories, lambda c: c.isin(*FOOD))
    return F.when(drinks & food, "combo").when(drinks, "drinks").when(food, "food").otherwise("unknown")


def quality_tier(confidence: Column, *present: Column) -> Column:
    """Tier from the confidence and the share of fields that are there."""
    full = sum((F.when(F.coalesce(p, F.lit(False)), 1).otherwise(0) for p in present), F.lit(0)) / len(present)
    score = (F.coalesce(confidence, F.lit(0.0)) + full) / 2
    return tier(score)


def tier(score: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def content_key(text: Column) -> Column:
    """First three distinct words of a description in alphabetical order, without times, days and stock words."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"\b\d{1,2}\s*(?:am|pm)\b", "")
    t = F.regexp_replace(t, r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", "")
    t = F.regexp_replace(t, r"\btime:\s*|\bdays:\s*", "")
    words = F.array_except(F.regexp_extract_all(t, F.lit(r"\b[a-z]{3,}\b"), F.lit(0)), F.array(*map(F.lit, ("happy", "hour", "found", "pattern"))))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, 3), "_")


def representative_score(confidence: Column, has_time: Column, has_days: Column, text_length: Column, preferred: Column) -> Column:
    """How well a deal stands for its cluster: 0.4 confidence, 0.3 completeness, 0.2 length of text, 0.1 method."""
    half = lambda c: F.when(F.coalesce(c, F.lit(False)), 0.5).otherwise(0.0)
    return (
        F.coalesce(confidence, F.lit(0.5)) * 0.4
        + (half(has_time) + half(has_days)) * 0.3
        + F.least(F.coalesce(text_length, F.lit(0)) / 200, F.lit(1.0)) * 0.2
        + F.when(F.coalesce(preferred, F.lit(False)), 0.8).otherwise(0.5) * 0.1
    )


def price_list(text: Column) -> Column:
    """'$5 Beers, $8 Wines and $10 Cocktails' as a list."""
    parts = F.split(F.regexp_replace(text, r"(?i)\s*(?:,|&|\band\b)\s*(?=\$)", "\u0001"), "\u0001")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[,&]+$", ""), r"\s+", " ")))
    return F.filter(clean, lambda p: p.rlike(r"^\$\d+"))


def without_prices(description: Column, prices: Column) -> Column:
    """The description less the prices that are listed apart."""
    return F.trim(F.regexp_replace(F.aggregate(prices, description, lambda a, p: F.replace(a, p, F.lit(""))), r"\s+", " "))


def page_deal_confidence(n: Column, has_context: Column, n_priced: Column, n_kinds: Column) -> Column:
    """Deals of a page: up to 0.5 for their number, 0.3 for the context, 0.2 and 0.1 each for prices, 0.05 for each category."""
    score = F.least(n * 0.1, F.lit(0.5)) + F.when(has_context, 0.3).otherwise(0.0) + F.when(n_priced > 0, 0.2).otherwise(0.0) + n_priced * 0.1 + n_kinds * 0.05
    return F.when(n == 0, 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 6))


def type_prior(name: Column, cuisine: Column, good: tuple[str, ...] = ("bar", "pub", "tavern", "grill", "brew", "cantina"), dear: tuple[str, ...] = ("steakhouse", "fine", "french")) -> Column:
    """How likely a restaurant has deals, by its name and cuisine, between 0 and 1."""
    n, c = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(cuisine, F.lit("")))
    add = lambda cond, w: F.when(cond, w).otherwise(0.0)
    score = F.lit(0.5) + add(has_any(n, good), 0.2) + add(has_any(c, good), 0.15) - add(has_any(n, dear) | has_any(c, dear), 0.1)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def source_quality(text: Column) -> Column:
    """0.5, and more for length, a phone number, a street and opening hours; 0 without text."""
    add = lambda cond, w: F.when(cond, w).otherwise(0.0)
    score = F.lit(0.5) + add(F.length(text) > 1000, 0.2) + add(text.rlike(r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}"), 0.1) + add(text.rlike(r"(?i)\d+\s+[a-z\s]+(?:street|st|avenue|ave)"), 0.1)
    score = score + add(F.lower(text).rlike("hours|open|monday|tuesday"), 0.1)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 6))


def insights(total: Column, food: Column, drink: Column, drink_price: Column, cuisine: Column) -> Column:
    """Remarks on a restaurant's deals, in a fixed order."""
    found = F.array(
        F.when(total > 100, "deal leader").when(total > 50, "strong offering").when(total < 10, "limited data"),
        F.when(drink_price > 0, F.when(drink_price < 10, "excellent value").when(drink_price > 15, "premium").otherwise("balanced pricing")),
        F.when(cuisine == "Italian", "wine and aperitivo").when(cuisine == "Steakhouse", "premium dining"),
        F.when(drink > food * 2, "drink-focused").when(food > drink, "food-forward"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def display_line(days: Column, start: Column, end: Column, price: Column) -> Column:
    """'Mon-Fri • 3 pm - 6 pm • $5 beer'; what is missing is left out."""
    return F.concat_ws(" • ", F.nullif(days, F.lit("")), F.when(start.isNotNull() & end.isNotNull(), F.concat_ws(" - ", start, end)), F.nullif(price, F.lit("")))


def street_parts(text: Column) -> list[Column]:
    """Number, street and unit of an address line."""
    part = lambda k: F.nullif(F.trim(F.regexp_extract(text, r"(?i)^\s*(\d+)\s+([^,#]+?)(?:(?:\s*#\s*|\s+(?:unit|suite|apt)\.?\s+)(\w+))?\s*(?:,|$)", k)), F.lit(""))
    return [part(1).alias("number"), part(2).alias("street"), part(3).alias("unit")]


def formatted_address(number: Column, street: Column, unit: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """'12 Main Street 4B, Denver, CO 80202' of the parts that are there; the street needs its number; null without parts."""
    had = lambda c: F.nullif(F.trim(c), F.lit(""))
    line = F.when(had(number).isNotNull() & had(street).isNotNull(), F.concat_ws(" ", had(number), had(street), had(unit)))
    places = F.array_compact(F.array(had(city), had(state), had(zip_code)))
    # The first of the parts that are there stands before a comma, the others follow with spaces.
    place = F.concat_ws(", ", F.get(places, F.lit(0)), F.nullif(F.array_join(F.slice(places, 2, 2), " "), F.lit("")))
    return F.nullif(F.concat_ws(", ", line, F.nullif(place, F.lit(""))), F.lit(""))

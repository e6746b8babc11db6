"""Profiles of restaurants by what their pages say about prices, events, reservations, mood and deals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PRICE_WORDS = {
    "budget": ("$5", "$6", "$7", "$8", "$9", "under $10", "affordable"),
    "moderate": ("$10", "$12", "$15", "$18", "$20", "$25"),
    "upscale": ("$30", "$35", "$40", "$45", "$50", "market price", "mp"),
    "luxury": ("$60", "$75", "$100", "seasonal pricing", "chef selection"),
}
EVENT_WORDS = {
    "seasonal": ("summer", "winter", "spring", "fall", "holiday", "christmas", "thanksgiving"),
    "weekly_specials": ("monday", "tuesday", "wednesday", "thursday", "taco tuesday", "wine wednesday"),
    "special_events": ("live music", "trivia", "karaoke", "game day", "brunch", "bottomless"),
    "celebrations": ("birthday", "anniversary", "private party", "corporate event"),
}
MOOD_WORDS = {
    "romantic": ("romantic", "intimate", "date night", "couples"),
    "family_friendly": ("family", "kids", "children", "family-friendly"),
    "lively": ("lively", "energetic", "vibrant", "bustling"),
    "casual": ("casual", "relaxed", "laid-back", "informal"),
    "upscale": ("upscale", "elegant", "sophisticated", "refined"),
    "outdoor": ("patio", "rooftop", "terrace", "outdoor", "garden"),
}
DEAL_WORDS = ("special", "discount", "promotion", "deal", "offer")
SERVICES = ("opentable", "resy", "tock")
SERVICE_PAGE = r"""{0}\.com/([^/\s"']+)"""
PRICED_ITEM = r"\$(\d+(?:\.\d{2})?)\s*[–-]?\s*([^$\n]{1,50})"
HAPPY_PRICE = r"happy hour[^$]*\$(\d+(?:\.\d{2})?)"


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words_in(text: Column, words: Sequence[str]) -> Column:
    """Those of the words that the text holds, in the order of the words."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def groups_in(text: Column, groups: dict[str, Sequence[str]]) -> Column:
    """Names of the groups with a word in the text, in the order of the groups."""
    held = [F.when(F.size(words_in(text, words)) > 0, F.lit(name)) for name, words in groups.items()]
    return F.array_compact(F.array(*held))


def deal_focus(pages: DataFrame, text: str = "text", links: str | None = None, top_prices: int = 10, top_sentences: int = 3) -> DataFrame:
    """Pages with a profile of their deals; links is a column of link targets, if there is one.

    menu_pricing holds the first prices with what follows them, price_range the first level with one of its
    words, special_events the words of each kind, reservation_services the last link to each service and whether the text names it,
    happy_hour_* the prices and sentences at "happy hour". fields_extracted counts what was found: one for prices, level, events,
    mood, "happy hour" and any sign of a deal, and one for each link and each form in which a service is named.
    A null text is empty; nothing found gives empty lists, null level and 0.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(whole)
    price, item = (F.regexp_extract_all(whole, F.lit(PRICED_ITEM), F.lit(g)) for g in (1, 2))
    priced = F.zip_with(F.slice(price, 1, top_prices), F.slice(item, 1, top_prices), lambda p, i: F.struct(F.concat(F.lit("$"), p).alias("price"), stripped(i).alias("item")))
    targets = F.coalesce(F.col(links), F.array().cast("array<string>")) if links else F.array().cast("array<string>")
    to = lambda service: F.filter(targets, lambda x: F.contains(x, F.lit(service)))
    linked = {s: to(s) for s in SERVICES}
    forms = [form for s in SERVICES for form in (low.rlike(SERVICE_PAGE.format(s)), F.contains(low, F.lit(s)))]
    services = F.array(*(F.struct(F.lit(s).alias("service"), F.try_element_at(linked[s], F.lit(-1)).alias("url"), F.contains(low, F.lit(s)).alias("mentioned")) for s in SERVICES))
    happy = F.contains(low, F.lit("happy hour"))
    said = F.filter(F.split(whole, "[.!?]+"), lambda s: F.contains(F.lower(s), F.lit("happy hour")))
    out = pages.withColumns({
        "menu_pricing": priced,
        "price_range": F.try_element_at(groups_in(low, PRICE_WORDS), F.lit(1)),
        "special_events": F.struct(*(words_in(low, words).alias(kind) for kind, words in EVENT_WORDS.items())),
        "reservation_services": F.filter(services, lambda x: x["url"].isNotNull() | x["mentioned"]),
        "atmosphere": groups_in(low, MOOD_WORDS),
        "has_happy_hour": happy,
        "happy_hour_prices": F.transform(F.regexp_extract_all(low, F.lit(HAPPY_PRICE), F.lit(1)), lambda p: F.concat(F.lit("$"), p)),
        "happy_hour_context": F.transform(F.slice(said, 1, top_sentences), lambda s: stripped(s)),
        "deal_types": words_in(low, DEAL_WORDS),
    })
    events = F.greatest(*(F.size(f"special_events.{kind}") for kind in EVENT_WORDS)) > 0
    signs = (F.size("menu_pricing") > 0, F.col("price_range").isNotNull(), events, F.size("atmosphere") > 0, happy, happy | (F.size("deal_types") > 0), *forms)
    count = sum((s.cast("int") for s in signs), sum((F.size(x) for x in linked.values()), F.lit(0)))
    return out.withColumn("fields_extracted", count)

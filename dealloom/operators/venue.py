"""Profiles of venues from their pages: contacts by role, hours by day, status, prices, mood, services, networks, address, seats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.functions.arrays import let
from dealloom.functions.times import WEEK, day_name, time_24h
from dealloom.operators.extract import matches
from dealloom.operators.overlay import us_phone

# Forms of contacts and hours, and the words that tell roles, states, levels, moods, services and styles.
PHONE = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
NETWORKS = {"instagram": r"instagram\.com/([^/\s\"'?#]+)", "facebook": r"(?:facebook|fb)\.com/([^/\s\"'?#]+)", "twitter": r"(?:twitter|\bx)\.com/([^/\s\"'?#]+)", "tiktok": r"tiktok\.com/@([^/\s\"'?#]+)"}
MENTION = r"(?:^|[\s(])@([A-Za-z0-9_.]*[A-Za-z0-9_])"
GENERIC_HANDLES = r"\.com$|\.net$|\.org$|www\.|^\d+$|home$|contact$|about$|menu$|location$|hours$|info$|main$|index$|default$|null$|undefined$|n$|nup$"
FACEBOOK_PAGES = ("page", "pages", "profile", "user", "account")
ROLES = {"general": ("info", "hello", "contact", "general"), "reservations": ("reservation", "booking", "table"), "events": ("event", "party", "private")}
STATES = {"temporarily_closed": ("temporarily closed", "closed temporarily", "reopening soon"), "permanently_closed": ("permanently closed", "closed permanently", "no longer open")}
LEVELS = {
    "$": ("budget", "cheap", "under $15", "$5-", "$10-", "affordable"),
    "$$": ("moderate", "$15-", "$20-", "mid-range", "reasonable"),
    "$$$": ("upscale", "$30-", "$40-", "fine dining", "expensive"),
    "$$$$": ("luxury", "$60+", "$70+", "premium", "high-end"),
}
MOODS = {
    "romantic": ("romantic", "intimate", "date night", "couples"),
    "family_friendly": ("family", "kids", "children", "family-friendly"),
    "lively": ("lively", "energetic", "vibrant", "bustling"),
    "casual": ("casual", "relaxed", "laid-back", "informal"),
    "upscale": ("upscale", "elegant", "sophisticated", "refined"),
}
BOOKING = {"opentable_url": ("opentable",), "resy_url": ("resy",), "direct_reservation_url": ("reservation", "booking", "tock")}
DELIVERY = {"doordash_url": ("doordash",), "ubereats_url": ("ubereats", "uber.com"), "grubhub_url": ("grubhub",)}
OFFERS = {"offers_delivery": ("delivery", "deliver"), "offers_takeout": ("takeout", "take out", "pickup", "take away", "to-go"), "offers_curbside": ("curbside", "curb side")}
STYLES = {"fast_casual": ("fast casual", "counter service", "quick service"), "food_truck": ("food truck", "truck", "mobile"), "bar": ("bar", "tavern", "pub", "brewery")}
RESERVATION_WORDS = ("reservation", "booking", "table")
_NAMED = r"\s+[A-Za-z ]+?\b(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Way|Place|Pl)\b"
STREET = rf"(?i)\d+{_NAMED}"
CITY = r"(?i)\d+\s+[A-Za-z ]+,\s*Denver"
ZIP = rf"(?i)\b80\d{{3}}\b(?!{_NAMED})"  # a number that begins a street is no code
SEATS = (r"(\d+)\s*seats?", r"capacity:?\s*(\d+)", r"accommodates?\s*(\d+)")
_DAY = "monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tues|tue|wed|thurs|thur|thu|fri|sat|sun"
_TIME = r"\d{1,2}(?::?\d{2})?\s*(?:am|pm)"
HOURS = rf"\b({_DAY})(?:\s*[-–]\s*({_DAY}))?[\s:]*({_TIME})\s*[-–]\s*({_TIME})"
CLOSED = rf"\b({_DAY}):\s*closed|closed\s+({_DAY})\b"
FIELDS = 25  # of which completeness is a share
AROUND = 60  # characters around a phone number in which a word gives its role


def _any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _first_group(text: Column, groups: dict[str, Sequence[str]]) -> Column:
    """Name of the first group with a word in the text, or null."""
    return F.coalesce(*[F.when(_any(text, words), F.lit(name)) for name, words in groups.items()])


def emails_by_role(text: Column) -> Column:
    """general, reservations and events: the first address of each role by its own words, in alphabetical order; others are general if that is free."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower)))
    tagged = F.transform(found, lambda e: F.struct(F.coalesce(_first_group(e, ROLES), F.lit("other")).alias("role"), e.alias("email")))

    def roles(tagged: Column) -> Column:
        one = lambda name: F.get(F.filter(tagged, lambda e: e["role"] == name), F.lit(0))["email"]
        return F.struct(F.coalesce(one("general"), one("other")).alias("general"), one("reservations").alias("reservations"), one("events").alias("events"))

    return let(tagged, roles)


def phones_by_role(text: Column, around: int = AROUND) -> Column:
    """primary and reservation: the first number, and the number that stands nearest to a word of reservations, at most so many characters away."""
    found = F.filter(F.transform(matches(text, PHONE), lambda m: F.struct(m["start"].alias("start"), us_phone(m["text"]).alias("phone"))), lambda m: m["phone"].isNotNull())
    words = F.transform(matches(F.lower(text), "|".join(RESERVATION_WORDS)), lambda m: m["start"])

    def roles(x: Column) -> Column:
        far = lambda m: F.array_min(F.transform(x["words"], lambda w: F.abs(w - m["start"])))
        near = F.array_min(F.filter(F.transform(x["found"], lambda m: F.struct(far(m).alias("far"), m["start"].alias("start"), m["phone"].alias("phone"))), lambda m: m["far"] <= around))
        return F.struct(F.get(x["found"], F.lit(0))["phone"].alias("primary"), near["phone"].alias("reservation"))

    return let(F.struct(found.alias("found"), words.alias("words")), roles)


def hours_by_day(text: Column) -> Column:
    """Map of day to (open, close, closed) as HH:MM; ranges of days wrap round the week, the last line of a day counts, closed days win."""
    low = F.lower(text)
    week = F.array(*map(F.lit, WEEK))
    part = lambda m, k: F.regexp_extract(m, HOURS, k)
    number = lambda name: F.array_position(week, day_name(F.substring(name, 1, 3))).cast("int") - 1
    clock = lambda t: time_24h(F.regexp_replace(t, r"^(\d{1,2}?)(\d{2})\s*(am|pm)$", "$1:$2$3"))
    lines = F.transform(F.regexp_extract_all(low, F.lit(HOURS), F.lit(0)), lambda m: F.struct(number(part(m, 1)).alias("first"), number(F.when(part(m, 2) == "", part(m, 1)).otherwise(part(m, 2))).alias("last"), clock(part(m, 3)).alias("open"), clock(part(m, 4)).alias("close")))
    lines = F.filter(lines, lambda h: h["open"].isNotNull() & h["close"].isNotNull())
    shut = F.transform(F.regexp_extract_all(low, F.lit(CLOSED), F.lit(0)), lambda m: number(F.coalesce(F.nullif(F.regexp_extract(m, CLOSED, 1), F.lit("")), F.regexp_extract(m, CLOSED, 2))))
    covers = lambda h, d: F.pmod(d - h["first"], F.lit(7)) <= F.pmod(h["last"] - h["first"], F.lit(7))
    kind = "struct<open:string,close:string,closed:boolean>"

    def days(x: Column) -> Column:
        last = lambda d: F.try_element_at(F.filter(x["lines"], lambda h: covers(h, d)), F.lit(-1))
        closed = F.struct(F.lit(None).alias("open"), F.lit(None).alias("close"), F.lit(True).alias("closed")).cast(kind)
        opened = lambda h: F.struct(h["open"].alias("open"), h["close"].alias("close"), F.lit(False).alias("closed")).cast(kind)
        each = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.when(F.array_contains(x["shut"], d), closed).otherwise(let(last(d), lambda h: F.when(h.isNotNull(), opened(h)))))
        return F.map_filter(F.map_from_arrays(week, each), lambda _, h: h.isNotNull())

    return let(F.struct(lines.alias("lines"), shut.alias("shut")), days)


def valid_handle(handle: Column, network: str) -> Column:
    """The handle, or null if it is short, long, or no name of a venue."""
    h = F.regexp_replace(handle, r"^[@/]+|[@/]+$", "")
    good = F.length(h).between(3, 30) & ~F.lower(h).rlike(GENERIC_HANDLES)
    if network == "instagram":
        good = good & ~h.rlike(r"^\d|\.\.")
    if network == "facebook":
        good = good & ~F.lower(h).isin(*FACEBOOK_PAGES)
    return F.when(good, h)


def profiled(pages: DataFrame, text: str = "text", links: str | None = None) -> DataFrame:
    """Pages with a profile: all fields in one projection of built-in expressions, and shares of what was found.

    links is a column of link targets, if there is one. completeness is the number of fields found over
    FIELDS (a link to a service counts for two: the link, and the service), confidence 1.2 times that
    and 0.9 at most. A null text is an empty one; nothing found gives nulls, no days and a status of operational.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    targets = F.coalesce(F.col(links), F.array().cast("array<string>")) if links else F.array().cast("array<string>")
    rows = pages.withColumns({"_text": whole, "_low": F.lower(whole), "_links": targets})
    t, low = F.col("_text"), F.col("_low")
    to = lambda words: F.get(F.filter("_links", lambda x: _any(F.lower(x), words)), F.lit(0))
    urls = {name: to(words) for name, words in (BOOKING | DELIVERY).items()}
    linked = lambda pattern: F.filter(F.transform("_links", lambda x: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))), lambda h: h.isNotNull())
    in_text = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))

    def handle(network: str, pattern: str) -> Column:
        all_of = [linked(pattern), in_text(pattern), *([in_text(MENTION)] if network == "instagram" else [])]
        return F.get(F.filter(F.transform(F.concat(*all_of), lambda h: valid_handle(h, network)), lambda h: h.isNotNull()), F.lit(0))

    street = F.coalesce(F.nullif(F.regexp_extract(t, STREET, 0), F.lit("")), F.nullif(F.regexp_extract(t, CITY, 0), F.lit("")))
    price = _first_group(low, LEVELS)
    rows = rows.withColumns({"_phones": phones_by_role(t), "_emails": emails_by_role(t)} | urls)
    rows = rows.withColumns({
        "primary_phone": F.col("_phones.primary"), "reservation_phone": F.col("_phones.reservation"),
        "general_email": F.col("_emails.general"), "reservations_email": F.col("_emails.reservations"), "events_email": F.col("_emails.events"),
        "hours": hours_by_day(t), "closed_status": _first_group(low, STATES), "price_range": price,
        "atmosphere": F.array_compact(F.array(*[F.when(_any(low, words), F.lit(name)) for name, words in MOODS.items()])),
        "accepts_reservations": F.coalesce(*[F.col(c) for c in BOOKING]).isNotNull() | _any(low, ("reservation", "book a table")),
        **{name: _any(low, words) | (F.coalesce(*[F.col(c) for c in DELIVERY]).isNotNull() if name == "offers_delivery" else F.lit(False)) for name, words in OFFERS.items()},
        **{network: handle(network, pattern) for network, pattern in NETWORKS.items()},
        "street_address": F.trim(street), "city": F.when(_any(low, ("denver",)), F.lit("Denver")), "state": F.when(low.rlike(r"\bco\b|\bcolorado\b"), F.lit("CO")), "zip_code": F.nullif(F.regexp_extract(t, ZIP, 0), F.lit("")),
        "total_seats": F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in SEATS]).try_cast("int"),
        "dining_style": F.coalesce(_first_group(low, STYLES), F.lit("full_service")),
    })
    single = ("primary_phone", "reservation_phone", "general_email", "reservations_email", "events_email", "closed_status", "price_range", *NETWORKS, "street_address", "city", "state", "zip_code")
    count = sum((F.col(c).isNotNull().cast("int") for c in single), F.lit(0)) + sum((F.col(c).isNotNull().cast("int") * 2 for c in BOOKING | DELIVERY), F.lit(0))
    count = count + (F.size("hours") > 0).cast("int") + (F.size("atmosphere") > 0).cast("int") + F.col("offers_takeout").cast("int") + F.col("offers_curbside").cast("int")
    # Delivery counts by itself only where no link tells it.
    count = count + (F.col("offers_delivery") & F.coalesce(*[F.col(c) for c in DELIVERY]).isNull()).cast("int")
    quality = F.lit(0.5) + F.when(F.length(t) > 1000, 0.2).otherwise(0.0) + F.when(t.rlike(r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}"), 0.1).otherwise(0.0)
    quality = quality + F.when(t.rlike(r"(?i)\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave)"), 0.1).otherwise(0.0) + F.when(_any(low, ("hours", "open", "monday", "tuesday")), 0.1).otherwise(0.0)
    rows = rows.withColumns({"fields_found": count, "business_status": F.coalesce("closed_status", F.lit("operational"))})
    share = F.col("fields_found") / FIELDS
    rows = rows.withColumns({"completeness": F.round(share, 6), "confidence": F.round(F.least(F.lit(0.9), share * 1.2), 6), "source_quality": F.round(F.when(t == "", 0.0).otherwise(F.least(quality, F.lit(1.0))), 6)})
    return rows.drop("_text", "_low", "_links", "_phones", "_emails", "closed_status")

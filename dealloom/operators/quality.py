"""Issues of deals and restaurants, profile checks, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.functions.times import WEEK, minute_of_day

# How much each field counts for completeness.
WEIGHTS = {
    "primary_phone": 0.15, "general_email": 0.15, "operating_hours": 0.15, "business_status": 0.05, "price_range": 0.05, "accepts_reservations": 0.05, "offers_delivery": 0.05,
    "offers_takeout": 0.05, "opentable_url": 0.05, "instagram": 0.05, "facebook": 0.05, "twitter": 0.05, "street_address": 0.05, "zip_code": 0.05,
}


def issue(when: Column, level: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(message).alias("message")))


def issues_of(rows: DataFrame, key: Sequence[str], found: Sequence[Column]) -> DataFrame:
    """One row per issue."""
    return rows.select(*key, F.explode(F.filter(F.array(*found), lambda i: i.isNotNull())).alias("i")).select(*key, "i.*")


def content_issues(title: str = "title", description: str = "description") -> list[Column]:
    n = F.length(title)
    markup = lambda c: F.col(c).rlike(r"(?i)<[a-z]+|function\s*\(|undefined|\{\{")
    return [
        issue(markup(title) | markup(description), "warning", "suspicious text"), issue((n > 0) & (n < 5), "warning", "short title"), issue(n > 100, "warning", "long title"), issue(F.length(description) > 500, "info", "long description"),
    ]


def time_issues(start: str = "start_time", end: str = "end_time", days: str = "days", all_day: str = "is_all_day") -> list[Column]:
    """Ends before starts, unless late into the night, more than eight hours, all day on all days."""
    a, b = minute_of_day(F.col(start)), minute_of_day(F.col(end))
    hours = F.floor(b / 60) + F.when(b < a, 24).otherwise(0) - F.floor(a / 60)
    return [
        issue((b <= a) & ~((a >= 1200) & (b < 420)), "warning", "end before start"), issue(hours > 8, "info", "long duration"), issue(F.coalesce(F.col(all_day), F.lit(False)) & (F.size(days) == 7), "info", "all day on all days"),
    ]


def anomaly_issues(confidence: str = "confidence_score", title: str = "title", description: str = "description", prices: str = "prices") -> list[Column]:
    value = lambda p: F.regexp_extract(p, r"\$(\d+(?:\.\d+)?)", 1).try_cast("double")
    return [
        issue(F.col(confidence) < 0.5, "warning", "low confidence"), issue(F.lower(title) == F.lower(description), "info", "title repeats description"), issue(F.exists(prices, lambda p: (value(p) < 1) | (value(p) > 50)), "warning", "odd price"),
    ]


def report(issues: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """One row: subjects, those with issues, issues by level, and a score of 100 less ten per issue and subject."""
    n = subjects.agg(F.countDistinct(key).alias("subjects"))
    level = lambda x: F.count_if(F.col("level") == x).alias(f"n_{x}")
    i = issues.agg(F.countDistinct(key).alias("with_issues"), level("warning"), level("info"), F.count("*").alias("n_issues"))
    return n.join(F.broadcast(i), F.lit(True)).withColumn("score", F.round(F.greatest(F.lit(0.0), 100 - 10 * F.coalesce(F.try_divide("n_issues", "subjects"), F.lit(0.0))), 4))


def completeness(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weights of the fields that are there and not empty, at most 1."""
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "false", "[]", "{}")
    return F.round(F.least(F.lit(1.0), sum((F.when(~has(c), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))), 6)


def boosted(confidence: Column, n_enhanced: Column) -> Column:
    """0.05 for each enhanced field, 0.2 at most; never above 0.95."""
    return F.when(n_enhanced > 0, F.least(F.lit(0.95), F.coalesce(confidence, F.lit(0.7)) + F.least(F.lit(0.2), n_enhanced * 0.05))).otherwise(confidence)


def valid_hours(hours: Column) -> Column:
    """Map of day to (open, close, closed): known days only; closed days need no times; null if nothing is left."""
    ok = lambda v: F.coalesce(v["closed"], F.lit(False)) | (v["open"].rlike(r"^\d{1,2}:\d{2}$") & v["close"].rlike(r"^\d{1,2}:\d{2}$"))
    named = F.transform_keys(hours, lambda k, v: F.lower(k))
    kept = F.map_filter(named, lambda k, v: k.isin(*WEEK) & F.coalesce(ok(v), F.lit(False)))
    return F.when(F.size(kept) > 0, kept)


def with_invalid_nulled(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows whose invalid fields are null, and how many each field had."""
    bad = {c: F.col(c).isNotNull() & ~F.coalesce(ok, F.lit(False)) for c, ok in checks.items()}
    counts = rows.agg(*[F.count_if(b).alias(c) for c, b in bad.items()])
    return rows.withColumns({c: F.when(~b, F.col(c)) for c, b in bad.items()}), counts


def address(parts: str = "address_struct", fallback: str = "neighborhood") -> Column:
    """The formatted address, else one from its parts, else the neighborhood."""
    p = lambda f: F.nullif(F.trim(F.col(f"{parts}.{f}")), F.lit(""))
    street = F.concat_ws(" ", p("street_number"), p("street_name"))
    built = F.concat_ws(", ", F.nullif(street, F.lit("")), p("city"), F.nullif(F.concat_ws(" ", p("state"), p("zip_code")), F.lit("")))
    return F.coalesce(p("formatted_address"), F.nullif(built, F.lit("")), F.col(fallback))


def map_link(shown: Column, base: str) -> Column:
    """A link to a map of an address; null without one."""
    return F.concat(F.lit(base), F.url_encode(shown))


def address_checks(street: str = "street", city: str = "city", state: str = "state", zip_code: str = "zip_code") -> dict[str, Column]:
    """Which parts of an address have a usual form."""
    return {
        street: F.col(street).rlike(r"^\d+\s+[A-Za-z0-9 .'-]+$"), city: F.col(city).rlike(r"^[A-Z][A-Za-z .'-]+$"), state: F.upper(F.col(state)).rlike("^[A-Z]{2}$"), zip_code: F.col(zip_code).rlike(r"^\d{5}(-\d{4})?$"),
    }


def enhanced_profiles(profiles: DataFrame, weights: dict[str, float], confidence: str = "confidence_score") -> DataFrame:
    """Phones and websites in their usual form or null, and the completeness and confidence that follow, in one pass."""
    from dealloom.operators.overlay import us_phone
    from dealloom.operators.pages import normal_url

    better = lambda new, old: F.when(new.isNotNull() & ~new.eqNullSafe(F.col(old)), 1).otherwise(0)
    phone, site = us_phone(F.col("phone")), normal_url(F.col("website"))
    out = profiles.withColumns({"n_enhanced": better(phone, "phone") + better(site, "website"), "new_phone": phone, "new_site": site})
    out = out.withColumns({"phone": F.col("new_phone"), "website": F.col("new_site")}).drop("new_phone", "new_site")
    return out.withColumns({"completeness_score": completeness(weights), confidence: F.round(boosted(F.col(confidence), F.col("n_enhanced")), 6)})

"""Days and times of day as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealloom.functions.arrays import let

WEEK = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def day_name(day: Column) -> Column:
    """Full lower-case name of a day given by name or three letters; other text in lower case; null stays."""
    key = F.lower(F.trim(day))
    names = F.create_map(*[F.lit(x) for d in WEEK for x in (d[:3], d)] + [F.lit(x) for d in WEEK for x in (d, d)])
    return F.coalesce(F.try_element_at(names, key), key)


def day_list(days: Column) -> Column:
    """Names in order of first mention, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(days, day_name), lambda d: d.isNotNull() & (d != "")))


def minute_of_day(time: Column) -> Column:
    """Minutes since midnight of '3pm', '3:30 PM', '12 am' or '15:00'; null for anything else."""
    one, two = r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm)$", r"^(\d{2}):(\d{2})$"

    def twelve(x: Column) -> Column:
        return F.when(x["hour"].between(1, 12) & (x["minute"] < 60), (x["hour"] % 12 + F.when(x["noon"] == "pm", 12).otherwise(0)) * 60 + x["minute"])

    def minutes(t: Column) -> Column:
        part = lambda p, k: F.regexp_extract(t, p, k)
        halves = F.struct(part(one, 1).try_cast("int").alias("hour"), F.coalesce(F.nullif(part(one, 2), F.lit("")), F.lit("0")).try_cast("int").alias("minute"), part(one, 3).alias("noon"))
        whole = F.struct(part(two, 1).try_cast("int").alias("hour"), part(two, 2).try_cast("int").alias("minute"))
        return F.when(t.rlike(one), let(halves, twelve)).when(t.rlike(two), let(whole, lambda x: F.when((x["hour"] < 24) & (x["minute"] < 60), x["hour"] * 60 + x["minute"])))

    return let(F.lower(F.trim(time)), minutes)


def time_24h(time: Column) -> Column:
    """A time as HH:MM, or null."""
    return let(minute_of_day(time), lambda m: F.when(m.isNotNull(), F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))))


def time_12h(time: Column) -> Column:
    """HH:MM as '3:05 PM'; other text as it is."""

    def label(m: Column) -> Column:
        hour = F.floor(m / 60)
        return F.when(m.isNotNull(), F.concat(F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.when(hour < 12, " AM").otherwise(" PM")))

    return F.coalesce(let(minute_of_day(time), label), time)


def _all_of(days: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_intersect(days, F.array(*map(F.lit, wanted)))) == len(wanted)


def short_days(days: Column, weekday: str, weekend: str, otherwise: Column, one: Column) -> Column:
    """Labels of the usual day sets: five weekdays or more, the weekend, one day, and others."""
    n = F.size(days)
    return F.when((n >= 5) & _all_of(days, WEEK[:5]), weekday).when((n == 2) & _all_of(days, WEEK[5:]), weekend).when(n == 1, one).otherwise(otherwise)


def schedule_label(days: Column, start: Column, end: Column) -> Column:
    """'Mon-Fri 3:00 PM-6:00 PM' and the like."""
    short = F.transform(F.slice(days, 1, 3), lambda d: F.substring(F.initcap(d), 1, 3))
    when = F.when(F.size(days) == 0, "Daily").otherwise(short_days(days, "Mon-Fri", "Weekends", F.array_join(short, ", "), F.substring(F.initcap(F.get(days, F.lit(0))), 1, 3)))
    span = F.when(start.isNotNull() & end.isNotNull(), F.concat(time_12h(start), F.lit("-"), time_12h(end))).when(start.isNotNull(), F.concat(F.lit("Starting "), time_12h(start))).otherwise("")
    return F.trim(F.concat(when, F.lit(" "), span))


def time_key(time: Column) -> Column:
    """Hour and half of the day of a time, for clustering: minutes do not count."""
    t = F.lower(F.trim(time))
    found = F.regexp_extract(t, r"(\d{1,2})\s*(?::\d{2})?\s*(am|pm)", 0)
    hour, half = F.regexp_extract(t, r"(\d{1,2})\s*(?::\d{2})?\s*(am|pm)", 1), F.regexp_extract(t, r"(\d{1,2})\s*(?::\d{2})?\s*(am|pm)", 2)
    return F.when(t.isNull() | (t == ""), "unknown").when(t.contains("close"), "close").when(t.contains("all") & t.contains("day"), "all_day").when(found != "", F.concat(hour, half)).otherwise(F.replace(t, F.lit(" "), F.lit("_")))


def time_signature(start: Column, end: Column, all_day: Column) -> Column:
    missing = start.isNull() | end.isNull() | (start == "") | (end == "")
    return F.when(F.coalesce(all_day, F.lit(False)), "all_day").when(missing, "no_time").otherwise(F.concat_ws("_", time_key(start), time_key(end)))


def day_signature(days: Column) -> Column:
    d = F.array_sort(F.array_distinct(days))
    is_set = lambda names: d == F.array_sort(F.array(*map(F.lit, names)))
    return (
        F.when(days.isNull() | (F.size(days) == 0), "no_days")
        .when(is_set(WEEK[:5]), "weekdays").when(is_set(WEEK[5:]), "weekend").when(is_set(WEEK), "daily")
        .when(F.size(d) == 1, F.concat(F.lit("single_"), F.get(d, F.lit(0))))
        .otherwise(F.array_join(d, "_"))
    )


def day_mask(days: Column) -> Column:
    """Bit 0 for Monday to bit 6 for Sunday."""
    return sum((F.when(F.array_contains(days, d), 1 << i).otherwise(0) for i, d in enumerate(WEEK)), F.lit(0))


def compact_days(days: Column) -> Column:
    """'Mon-Fri', 'Sun-Thu' (ranges wrap round the week), 'Mon, Wed': runs of three days or more become ranges."""
    mask = day_mask(days)
    on = F.array(*[F.coalesce(F.array_contains(days, d), F.lit(False)) for d in WEEK])
    bit = lambda i: F.element_at(on, (F.pmod(i, F.lit(7)) + 1).cast("int"))
    # A run begins where a day is set and the one before is not; Monday leads if all days are.
    first = lambda i: bit(i) & ~bit(i + 6)
    length = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(6)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, k: F.struct((a["n"] + F.when(a["on"] & bit(i + k), 1).otherwise(0)).alias("n"), (a["on"] & bit(i + k)).alias("on")), lambda a: a["n"])
    short = F.array(*[F.lit(d[:3].title()) for d in WEEK])
    name = lambda i: F.element_at(short, (F.pmod(i, F.lit(7)) + 1).cast("int"))
    text = lambda i: F.when(length(i) >= 3, F.concat(name(i), F.lit("-"), name(i + length(i) - 1))).when(length(i) == 2, F.concat(name(i), F.lit(", "), name(i + 1))).otherwise(name(i))
    runs = F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), first), text)
    return F.when(mask == 127, "Daily").when(mask == 0, "").otherwise(F.array_join(runs, ", "))


def loose_time_24h(time: Column) -> Column:
    """HH:MM of a time written in any usual way; a bare hour from 3 to 11 is in the afternoon, 12 is noon, 1 and 2 are at night."""
    t = F.upper(F.trim(time))
    pick = lambda p, k: F.regexp_extract(t, p, k)
    pad = lambda h, m: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))
    half = r"(\d{1,2})(?::(\d{2}))?\s*(AM|PM)"
    hour = pick(half, 1).try_cast("int") % 12 + F.when(pick(half, 3) == "PM", 12).otherwise(0)
    with_half = F.when(pick(half, 0) != "", pad(hour, F.coalesce(pick(half, 2).try_cast("int"), F.lit(0))))
    full = r"(\d{1,2})[:.](\d{2})"
    plain = F.when((pick(full, 0) != "") & (pick(full, 1).try_cast("int") < 24) & (pick(full, 2).try_cast("int") < 60), pad(pick(full, 1).try_cast("int"), pick(full, 2).try_cast("int")))
    bare = F.when(t.rlike(r"^\d{1,2}$"), t.try_cast("int"))
    guess = F.when(bare.between(3, 11), bare + 12).when(bare == 12, 12).when(bare.between(1, 2), bare)
    return F.coalesce(with_half, plain, F.when(guess.isNotNull(), pad(guess, F.lit(0))))


def shown_time(time: Column) -> Column:
    """'3pm' as '3:00 PM'; a bare hour from 2 to 11 is in the afternoon; other text stays."""

    def shown(t: Column) -> Column:
        bare = F.when(t.rlike(r"^\d{1,2}$"), t.try_cast("int"))
        return F.coalesce(F.when(bare.between(2, 11), F.concat(bare.cast("string"), F.lit(":00 PM"))), time_12h(t))

    return let(F.trim(time), shown)


def timeframe(text: Column) -> Column:
    """'3:00 PM - 6:00 PM' of a range of times; afternoon where neither end says; null for impossible ones."""
    t = F.trim(text)
    p = r"(?i)(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*-\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)?"
    g = lambda k: F.regexp_extract(t, p, k)
    hour = lambda k: g(k).try_cast("int")
    minute = lambda k: F.when(g(k) == "", "00").otherwise(g(k))
    late = F.when(g(6) == "", "PM").otherwise(F.upper(g(6)))
    early = F.when(g(3) == "", late).otherwise(F.upper(g(3)))
    ok = (g(0) != "") & hour(1).between(1, 12) & hour(4).between(1, 12) & (minute(2) < "60") & (minute(5) < "60")
    shown = F.concat(hour(1).cast("string"), F.lit(":"), minute(2), F.lit(" "), early, F.lit(" - "), hour(4).cast("string"), F.lit(":"), minute(5), F.lit(" "), late)
    return F.when(F.lower(t).rlike(r"all\s*day"), "All Day").when(ok, shown)


def day_titles(days: Column) -> Column:
    """Days as 'Monday', in order of first mention, without what is no day."""
    return F.transform(F.filter(day_list(days), lambda d: d.isin(*WEEK)), F.initcap)


def hours_map(periods: Column) -> Column:
    """Map of day to (open, close) of periods (day 0 is Sunday, open and close as HHMM); the last period of a day counts."""
    name = lambda p: F.element_at(F.array(*[F.lit(d) for d in (WEEK[6], *WEEK[:6])]), (p["day"] + 1).cast("int"))
    clock = lambda c: F.concat(F.substring(c, 1, 2), F.lit(":"), F.substring(c, 3, 2))
    # The earlier of two entries gives way: entries of later periods of the same day are looked for.
    last = F.filter(periods, lambda p, i: ~F.exists(F.slice(periods, i + 2, F.greatest(F.size(periods) - i - 1, F.lit(0))), lambda q: q["day"] == p["day"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(name(p).alias("day"), F.struct(clock(p["open"]).alias("open"), clock(p["close"]).alias("close")).alias("hours"))))


def period_hours(periods: Column) -> Column:
    """Map of day to (open, close) of periods (open and close with day, time as HHMM, hour and minute; day 0 is Sunday).

    Both ends of a period are told by time, or else both by hour and minute (a missing minute is 0).
    Other periods, and those of no day of the week, are left out; of a day's periods the last counts. Null has no hours.
    """
    four = lambda e: F.concat(F.lpad(e["hour"].cast("string"), 2, "0"), F.lpad(F.coalesce(e["minute"], F.lit(0)).cast("string"), 2, "0"))

    def ends(p: Column) -> Column:
        a, b = p["open"], p["close"]
        timed, told = a["time"].isNotNull() & b["time"].isNotNull(), a["hour"].isNotNull() & b["hour"].isNotNull()
        of = lambda e: F.when(timed, e["time"]).when(told, four(e))
        return F.struct(a["day"].alias("day"), of(a).alias("open"), of(b).alias("close"))

    whole = F.filter(F.transform(periods, ends), lambda p: p["day"].between(0, 6) & p["open"].isNotNull() & p["close"].isNotNull())
    return hours_map(F.coalesce(whole, F.filter(F.array(F.struct(F.lit(0).alias("day"), F.lit("").alias("open"), F.lit("").alias("close"))), lambda p: F.lit(False))))


def ago(then: Column, now: Column) -> Column:
    """'3 hours ago' and the like."""
    m = F.floor((now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")) / 60)
    unit = lambda n, u: F.concat(n.cast("string"), F.lit(f" {u}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(then.isNull(), "never").when(m < 60, unit(m, "minute")).when(m < 1440, unit(F.floor(m / 60), "hour")).otherwise(unit(F.floor(m / 1440), "day"))


# Day lists and what they are shortened to, longest first.
SHORTER = (
    (r"\bMon(?:day)?,\s*Tue(?:sday)?,\s*Wed(?:nesday)?,\s*Thu(?:rsday)?,\s*Fri(?:day)?,\s*Sat(?:urday)?,\s*Sun(?:day)?\b", "Daily"),
    (r"\bMon(?:day)?,\s*Tue(?:sday)?,\s*Wed(?:nesday)?,\s*Thu(?:rsday)?,\s*Fri(?:day)?\b", "Mon - Fri"),
    (r"\bSat(?:urday)?,\s*Sun(?:day)?\b", "Sat - Sun"),
    (r"\bMon,\s*Tue,\s*Wed\b", "Mon - Wed"),
    (r"\bThu,\s*Fri,\s*Sat\b", "Thu - Sat"),
    (r"\bFri,\s*Sat\b", "Fri - Sat"),
    (r"\bTue,\s*Wed,\s*Thu\b", "Tue - Thu"),
)


def shortened_days(text: Column) -> Column:
    """Day lists in a text as ranges, day names as three letters, dashes and bars with one space around."""
    for pattern, short in SHORTER:
        text = F.regexp_replace(text, f"(?i){pattern}", short)
    for d in WEEK:
        text = F.regexp_replace(text, rf"(?i)\b{d}\b", d[:3].title())
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s*-\s*", " - ")
    return F.trim(F.regexp_replace(text, r"\s*\|\s*", " | "))


def weekly_schedule(curated: Column) -> Column:
    """Curated map of days to times ('monday_tuesday' -> '3-6 pm, 9 pm-close') as a list of (days, times); joined keys give several days."""
    days = lambda k: F.transform(F.split(k, "_"), lambda d: F.initcap(day_name(d)))
    return F.transform(F.map_entries(curated), lambda e: F.struct(days(e["key"]).alias("days"), F.transform(F.split(e["value"], r"\s*,\s*"), F.trim).alias("times")))

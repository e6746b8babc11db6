"""A guide in marked text as rows: areas, places within them, and what each line of a place says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.functions.arrays import let
from dealloom.operators.extract import unmarked

# Headings of lists that are no areas, words that tell times, addresses and other lines.
SKIPPED = ("Swanky Happy Hour", "Speakeasy", "Taco Tuesday", "Classic bar", "Service Industry", "Other Awesome")
TIME_WORDS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun", "am", "pm", "close", "all day", "night", "open")
NAME_TIME_WORDS = (*TIME_WORDS, "hour")
ADDRESS_WORDS = ("st", "street", "ave", "avenue", "blvd", "rd", "drive", "co", "denver")
NO_CUISINE = ("hours", "not", "website")
NO_LOCATION = ("plant", "hours", "website", "menu")
# Fixed values: (street, parts of addresses in its lower downtown).
LOWER_DOWNTOWN = (("larimer", ("1400", "1431", "1433", "1453")), ("market", ("1550",)), ("blake", ("1514", "1520")), ("wazee", ("1400", "1659")), ("17th st", ("1539",)))
LEAST_BLOCK = 10  # characters of a place
LONGEST_LOCATION = 60


def _count(text: Column, words: Sequence[str]) -> Column:
    return sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def _any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def is_name(text: Column) -> Column:
    """Whether bold text is a name rather than a schedule."""

    def named(low: Column) -> Column:
        n = _count(low, NAME_TIME_WORDS)
        return (n < 2) & ~((F.length(text) > 60) & (n > 0)) & ~text.rlike(r"\d+\s*[-|]\s*\d+") & ~low.rlike(r"(mon|tue|wed|thu|fri|sat|sun)\s*[|&]")

    return let(F.lower(text), named)


def is_schedule(text: Column) -> Column:
    return let(F.lower(text), lambda low: _any(low, TIME_WORDS)) & text.rlike("[-|:]")


def _bare(line: Column) -> Column:
    """A line without the marks around it."""
    return F.trim(F.regexp_replace(line, r"^\*+|\*+$", ""))


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([-|#])", "$1")


def slug(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s-]", ""), r"\s+", "-")
    return F.regexp_replace(out, "^-+|-+$", "")


def neighbourhood(area: Column, location: Column, address: Column) -> Column:
    """Places of the central area by their street where the address tells it."""
    low = F.lower(address)
    downtown = F.lit(False)
    for street, numbers in LOWER_DOWNTOWN:
        downtown = downtown | (low.contains(street) & address.rlike("|".join(numbers)))
    central = F.when(downtown, "LoDo").when(low.contains("wynkoop"), "Union Station").otherwise(F.coalesce(location, F.lit("Central")))
    return F.when((area == "Central") & address.isNotNull(), central).otherwise(location)


def guide_blocks(guides: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """key, part, block, area, name and lines (text, class) of every place; the classes are those of guide_lines."""
    marked = F.regexp_replace(unmarked(F.col(text)), r"\*{3}([^*]+)\*{3}", "\u0001$1\u0002")
    parts = F.transform(F.split(marked, "\u0001"), lambda part: F.struct(F.trim(F.split_part(part, F.lit("\u0002"), F.lit(1))).alias("area"), F.split_part(part, F.lit("\u0002"), F.lit(2)).alias("body")))
    # What stands before the first area is no place's.
    rows = guides.select(*key, F.posexplode(parts).alias("part", "_a")).filter("part > 0").select(*key, "part", "_a.*")
    rows = rows.filter(~_any(F.col("area"), SKIPPED))
    blocks = F.split(F.col("body"), r"\n\n(?=\*\*[^*\n]*\*\*)")
    rows = rows.select(*key, "part", "area", F.posexplode(blocks).alias("block", "_text")).filter(F.length(F.trim(F.regexp_replace("_text", r"^\s+|\s+$", ""))) >= LEAST_BLOCK)
    lines = F.filter(F.transform(F.split("_text", "\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", "")), lambda line: line != "")
    bold = lambda line: line.startswith("**") & line.endswith("**") & (F.length(line) > 4)
    name = lambda lines: F.get(F.filter(lines, lambda line: bold(line) & let(_bare(line), is_name)), F.lit(0))
    # Blocks without a name go as rows are made, so no line is read twice.
    named = F.filter(F.array(let(lines, lambda x: F.struct(x.alias("_lines"), name(x).alias("_name")))), lambda b: b["_name"].isNotNull())
    rows = rows.select(*key, "part", "block", "area", F.explode(named).alias("_b")).select(*key, "part", "block", "area", "_b.*")

    def class_of(line: Column) -> Column:
        """The line's class, and the one it falls to if the place has an address, or a location, already. An address has a digit, a location has none."""

        def of(x: Column) -> Column:
            low, plain = x["low"], x["plain"]
            later = F.when(_any(low, ("🥕", "plant", "vegan")), "note").otherwise("other")
            digit = line.rlike(r"\d")
            address = digit & _any(low, ADDRESS_WORDS)
            location = ~digit & ~line.startswith("[") & ~low.contains("http") & (F.length(line) > 2) & (F.length(line) < LONGEST_LOCATION) & ~_any(low, NO_LOCATION)
            first = (
                F.when(line == F.col("_name"), "name").when(bold(line) & is_schedule(plain), "schedule")
                .when(line.startswith("*") & line.endswith("*") & ~line.startswith("**") & (F.length(line) > 2) & ~_any(F.lower(plain), NO_CUISINE), "cuisine")
                .when(line.contains("[") & line.rlike(r"\]\([^)]*http[^)]*\)"), "link")
                .when(address, "address").when(location, "location").otherwise(later)
            )
            return F.struct(line.alias("text"), first.alias("class"), later.alias("later"))

        return let(F.struct(F.lower(line).alias("low"), _bare(line).alias("plain")), of)

    def settled(found: Column) -> Column:
        classes = F.transform(found, lambda x: x["class"])
        firsts = F.struct(F.array_position(classes, "address").alias("address"), F.array_position(classes, "location").alias("location"))
        again = lambda x, i, at: ((x["class"] == "address") & (i + 1 > at["address"])) | ((x["class"] == "location") & (i + 1 > at["location"]))
        return let(firsts, lambda at: F.transform(found, lambda x, i: F.struct(x["text"].alias("text"), F.when(again(x, i, at), x["later"]).otherwise(x["class"]).alias("class"))))

    return rows.select(*key, "part", "block", "area", _unescaped(_bare(F.col("_name"))).alias("name"), let(F.transform("_lines", class_of), settled).alias("lines"))


def guide_lines(guides: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """key, area, block, line, text and class of every line of every place.

    Areas stand between three stars; a place begins at a bold line after an empty one. The classes, of
    which the first that fits counts: name, schedule, cuisine, link, address, location, note, other.
    A place's first bold line that is a name is its name; of addresses and locations only the first
    counts, later ones fall to the next class. Everything is decided within the row of a place.
    """
    return guide_blocks(guides, key, text).select(*key, "part", "block", "area", "name", F.posexplode("lines").alias("line", "l")).select(*key, "part", "block", "area", "name", "line", "l.*")


def guide_places(guides: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """One row per area and slug: name, neighbourhood, address, cuisine, schedules in order, website, whether plant-based.

    Of places with the same slug in an area the last counts. Guides of any number are read at once; a place is
    read within its row, and only whole places are grouped.
    """
    of = lambda name: F.transform(F.filter("lines", lambda x: x["class"] == name), lambda x: x["text"])
    first, last = (lambda name: F.get(of(name), F.lit(0))), (lambda name: F.try_element_at(of(name), F.lit(-1)))
    places = guide_blocks(guides, key, text).select(
        *key, "part", "block", "area", "name", slug(F.col("name")).alias("slug"), first("location").alias("location"), first("address").alias("address"), _bare(last("cuisine")).alias("cuisine"),
        F.transform(of("schedule"), lambda x: _unescaped(_bare(x))).alias("schedules"), F.regexp_extract(last("link"), r"\(([^)]*http[^)]*)\)", 1).alias("website"), F.exists("lines", lambda x: x["class"] == "note").alias("plant_based"),
    )
    values = F.struct("name", neighbourhood(F.col("area"), F.col("location"), F.col("address")).alias("neighbourhood"), "address", "cuisine", "schedules", "website", "plant_based")
    last_of = places.groupBy(*key, "area", "slug").agg(F.max_by(values, F.struct("part", "block")).alias("p"))
    return last_of.select(*key, "area", "slug", "p.*")


def guide_districts(places: DataFrame, key: Sequence[str]) -> DataFrame:
    """Areas with their number of places and sorted neighbourhoods."""
    return places.groupBy(*key, "area").agg(F.count("*").alias("n_places"), F.array_join(F.sort_array(F.collect_set("neighbourhood")), "|").alias("neighbourhoods"))

"""Prose forms, guides, venues and rules on small texts, with answers written by hand."""

from itertools import accumulate

import pytest

from dealloom.functions.arrays import running_sums
from dealloom.operators import export, extractors, forms, rules, validate, venue
from dealloom.operators import pages as P
from dealloom.operators.ranks import ranked
from dealloom.sources import guide
from pyspark.sql import functions as F

COMMON = [
    ("Every Day 3-6PM & 9-10pm", [("every_day_two_ranges", "Daily Happy Hour", "3:00 PM", "6:00 PM")]),
    ("3:30-6pm every day", [("hours_every_day", "Daily Happy Hour", "3:30 PM", "6:00 PM")]),
    ("Happy Hours Monday-Saturday: 11am-6:30pm Sunday: all day", [("hours_then_day", "Sunday Happy Hour", "11:00 AM", "6:30 PM")]),
    ("happy hour 3pm-6pm Monday-Friday", [("hours_then_day", "Monday Happy Hour", "3:00 PM", "6:00 PM")]),
    ("9pm - close thu-sat", [("late", "Late Night Happy Hour", "9:00 PM", "Close")]),
    ("every friday. every monday. every tue. every sun", [("day", "Friday Special", None, None), ("day", "Monday Special", None, None), ("day", "Tue Special", None, None)]),
    ("half-off wings every tuesday, all day", [("share_on_day", "Half-Off Special", None, None)]),
    ("$3 $6 happy hour", [("prices", "Happy Hour", None, None)]),
    ("happy hour begins at 4 pm", [("bare", "Happy Hour", None, None)]),
    ("nothing", []), ("", []), (None, []), ("x\u0001 every friday", [("day", "Friday Special", None, None)]),
]


def test_common_forms(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(COMMON)], "id long, text string, title string")
    got = {}
    for r in forms.common_deals(docs, ("id",)).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.form, r.title, r.start_time, r.end_time))
    for i, (text, want) in enumerate(COMMON):
        assert got.get(i, []) == want, text
    # Without the exclusion both readings of overlapping words stay.
    both = [(r.form, list(r.days)) for r in forms.common_deals(docs.filter("id = 2"), ("id",), overlaps=True).orderBy("pos").collect()]
    six = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
    assert both == [("hours_then_day", ["sunday"]), ("day_range", six), ("named_hours_then_day", six)]
    assert forms.common_deals(docs.limit(0), ("id",)).count() == 0
    loose = [r.d and (r.d.start_time, r.d.end_time) for r in spark.createDataFrame([("Daily from 4pm - 7:30 pm",), ("3 pm-5 pm is happy hour",), ("3-5",), (None,)], "t string").select(forms.generic_deal(F.col("t")).alias("d")).collect()]
    assert loose == [("4:00 PM", "7:30 PM"), ("3:00 PM", "5:00 PM"), None, None]


GUIDE = """intro **Not a place**

***Speakeasy***

**Hidden**
5 Dark St

***Central***

**Bar \\- One**
**Mon \\- Fri | 3 \\- 6 pm**
**Sat: all day**
*Italian*
*hours vary*
1431 Larimer St, Denver
2 Second Ave
Near the park
Behind the bridge
[web](https://one.example.com/a)
\U0001f955 options
**3 - 6 | Tue | late**

**Open | 3 - 6 pm**
12 Nowhere St

**Two**
short

**Two**
16 Wynkoop St
***North***

**Two**
plant based kitchen
"""


def test_guide(spark):
    guides = spark.createDataFrame([(1, GUIDE), (2, None), (3, ""), (4, "no areas"), (5, "***Empty***")], "id long, text string")
    lines = [(r.name, r["class"], r.text) for r in guide.guide_lines(guides, ("id",)).orderBy("part", "block", "line").collect() if r.name == "Bar - One"]
    assert [c for _, c, _ in lines] == ["name", "schedule", "schedule", "cuisine", "other", "address", "other", "location", "other", "link", "note", "schedule"]
    got = {(r.area, r.slug): r for r in guide.guide_places(guides, ("id",)).collect()}
    assert set(got) == {("Central", "bar---one"), ("Central", "two"), ("North", "two")}
    one = got["Central", "bar---one"]
    assert (one.name, one.neighbourhood, one.address, one.cuisine, one.website, one.plant_based) == ("Bar - One", "LoDo", "1431 Larimer St, Denver", "Italian", "https://one.example.com/a", True)
    assert list(one.schedules) == ["Mon - Fri | 3 - 6 pm", "Sat: all day", "3 - 6 | Tue | late"]
    assert (got["Central", "two"].neighbourhood, got["Central", "two"].address) == ("Union Station", "16 Wynkoop St")
    assert got["North", "two"].plant_based and got["North", "two"].neighbourhood is None
    assert {(r.area, r.n_places, r.neighbourhoods) for r in guide.guide_districts(guide.guide_places(guides, ("id",)), ("id",)).collect()} == {("Central", 2, "LoDo|Union Station"), ("North", 1, "")}


def test_venue(spark):
    text = (
        "Call (303) 555-0100 for takeout. " + "We cook all day and all night for you. " * 3 + "Book a table: 720-555-0199. Write to events@a.com, info@a.com, RESERVATIONS@a.com or zed@a.com. "
        "Hours: Mon - Wed 11am - 9:30pm, Friday: 1130 am - 10 pm, Sunday: closed. 12 Elm Way, Denver, Colorado 80211. 85 seats, a lively pub with fine dining. Follow @the_venue_x."
    )
    links = ["https://resy.com/v", None, "https://facebook.com/page", "https://fb.com/venue.x?ref=1", "https://DoorDash.com/v"]
    rows = spark.createDataFrame([(1, text, links, 0), (2, None, None, 0), (3, "", [], 0)], "id long, text string, links array<string>, state int")
    got = {r.id: r for r in venue.profiled(rows.drop("state"), links="links").collect()}
    r = got[1]
    assert (r.primary_phone, r.reservation_phone) == ("(303) 555-0100", "(720) 555-0199")
    assert (r.general_email, r.reservations_email, r.events_email) == ("info@a.com", "reservations@a.com", "events@a.com")
    assert {d: (h.open, h.close, h.closed) for d, h in r.hours.items()} == {**{d: ("11:00", "21:30", False) for d in ("monday", "tuesday", "wednesday")}, "friday": ("11:30", "22:00", False), "sunday": (None, None, True)}
    assert (r.resy_url, r.doordash_url, r.facebook, r.instagram, r.total_seats, r.dining_style, r.price_range) == ("https://resy.com/v", "https://DoorDash.com/v", "venue.x", "the_venue_x", 85, "bar", "$$$")
    assert (r.street_address, r.city, r.state, r.zip_code, r.offers_takeout, r.accepts_reservations, r.business_status) == ("12 Elm Way", "Denver", "CO", "80211", True, True, "operational")
    # Phones 2, emails 3, hours, price, mood, two links twice, takeout, two handles, four of the address.
    assert r.fields_found == 2 + 3 + 1 + 1 + 1 + 4 + 1 + 2 + 4 and r.completeness == r.fields_found / 25 and r.confidence == 0.9
    for i in (2, 3):
        assert (got[i].fields_found, got[i].primary_phone, got[i].hours, got[i].source_quality) == (0, None, {}, 0.0)


def test_required_literals():
    want = {"taco\\s+night": "night", "(?:am|pm)": "", "a|b": "", "Hap+y hour": "y hour", "x?yz*w": "y", "[ab]cd{2}": "c", "(unclosed": "", "": "", "two for one": "two for one"}
    assert {p: rules.required_literal(p) for p in want} == want


DEAL = "slug string, title string, description string, days array<string>, start_time string, end_time string, confidence double, prices array<string>, other int"


def test_rules_in_order(spark):
    deals = spark.createDataFrame([("a", "Taco", "big $5 plate", ["monday"], "3 pm", None, 0.9, None, 1), ("b", None, None, None, None, None, 0.1, ["$5"], 2), (None, "Taco", "", [], None, None, None, [], 3)], DEAL)
    table = [(None, 2, "TACO", None, "Renamed", ["tue"], 0.3, None, None), ("a", 1, None, "taco", None, None, None, " - extra", "$5"), ("a", 3, "nothing", None, "Never", None, None, None, None), ("a", 4, "(", None, "Never", None, None, None, None), ("b", 5, None, None, None, None, None, " - alone ", None)]
    table = spark.createDataFrame(table, "slug string, ord int, pattern string, title_part string, new_title string, days array<string>, boost double, append string, price string")
    out = {r.other: r for r in rules.with_effects(deals, table).collect()}
    assert (out[1].title, out[1].description, list(out[1].days), out[1].confidence, list(out[1].prices), list(out[1].rule_order)) == ("Renamed", "big plate - extra", ["tuesday"], 1.0, ["$5"], [1, 2])
    assert (out[2].title, out[2].description, list(out[2].rule_order)) == (None, "alone", [5])
    assert (out[3].title, out[3].confidence, list(out[3].rule_order)) == ("Renamed", None, [2])
    first = {r.other: list(r.rule_order) for r in rules.with_effects(deals, table, first_only=True).collect()}
    assert first == {1: [1], 2: [5], 3: [2]}
    assert rules.with_effects(deals.limit(0), table).count() == 0 and rules.with_effects(deals, table.limit(0)).filter("size(rule_order) = 0").count() == 3
    plan = rules.with_effects(deals, table)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_extractors(spark):
    @extractors.register_extractor("a")
    def fine(text):
        return [{"title": text.upper(), "days": ["monday"], "confidence": 0.5}] * 2

    extractors.register_extractor("b", lambda text: [{"title": 5}])
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (4, "a", None), (5, None, "w")], "id long, slug string, text string")
    got = sorted((r.id, r.pos, r.title, r.error is not None) for r in extractors.extracted(rows, ("id",)).collect())
    assert got == [(1, 0, "X", False), (1, 1, "X", False), (2, 0, None, True)]
    every = sorted((r.id, r.title) for r in extractors.extracted(rows, ("id",), {"a": fine}, default=lambda t: [{"title": "other"}]).collect())
    assert every == [(1, "X"), (1, "X"), (2, "other"), (3, "other"), (5, "other")]
    assert extractors.extracted(rows.limit(0), ("id",)).count() == 0


def test_running_sums(spark):
    arrays = [[], [3], list(range(64)), list(range(65)), [1, -1] * 500, None]
    got = [r.s for r in spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>").orderBy("i").select(running_sums(F.col("a")).alias("s")).collect()]
    assert got == [list(accumulate(a)) if a is not None else [] for a in arrays]


HTML = """<div id=a><p>one</p><div class="b c"><div>two two</div>three</div>four</div><!-- <div class=b> --><script>"<div class=b>"</script></div><span class='c'>five<SPAN>six</SPAN></span><div class="bc">no</div><section class=b>open"""


def test_containers(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "no tags < here")], "id long, html string")
    want = {"#a": ["one two two three four"], ".b": ["two two three", "open"], "div.b": ["two two three"], ".c": ["two two three", "five six"], "span": ["five six", "six"], "div": ["one two two three four", "two two three", "two two", "no"], "section#a": []}
    got = {s: [] for s in want}
    for r in P.containers(pages, ("id",), tuple(want), longer_than=0).orderBy("selector", "pos").collect():
        assert r.id == 1
        got[r.selector].append(r.text)
    assert got == want
    assert [r.text for r in P.containers(pages, ("id",), ("div",), longer_than=8, first=2).orderBy("pos").collect()] == ["one two two three four", "two two three"]


@pytest.mark.parametrize("parts", [1, 5])
def test_ranks_of_ties_and_hot_values(spark, parts):
    rows = spark.range(0, 3000, 1, parts).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("v"), "id")
    got = [(r["rank"], r.v, r.id) for r in ranked(rows, [F.desc("v"), F.col("id").asc()]).collect()]
    want = sorted(((r.v, r.id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert sorted(got) == [(i + 1, *x) for i, x in enumerate(want)]
    same = ranked(spark.range(1000).select(F.lit(1).alias("v")), [F.desc("v")])
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 1001)) and ranked(rows.limit(0), [F.desc("v")]).count() == 0


def test_validators_on_odd_rows(spark):
    schema = "title string, start_time string, end_time string, prices array<string>, days array<string>, is_all_day boolean, confidence double"
    rows = [("Fine", "3 PM", "open late", ["$5", "", None, "$5-8"], [], False, None), (None, None, None, None, None, None, 2.0), ("ok deal", "15h", None, ["?"], ["monday"], None, 0.0)]
    got = [r.i for r in spark.createDataFrame(rows, schema).select(validate.deal_issues().alias("i")).collect()]
    assert got == [[], ["Title is too short or empty", "Completely empty deal - no days, times, or all-day flag", "Confidence score out of range: 2.0"], ["Invalid start time format: 15h", "Invalid price format: ?"]]


@pytest.mark.parametrize("most", [1000, 0])
def test_redirects(spark, most):
    rows = spark.createDataFrame([(1, "a", ["a", "c", "b", None]), (2, "x", []), (3, None, None), (4, "b", ["b", "b"])], "id long, website string, urls array<string>")
    moved = spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "z")], "old string, new string")
    got = {r.id: (r.website, r.urls) for r in validate.redirected(rows, moved, most=most).collect()}
    assert got == {1: ("b", ["b", "d", None]), 2: ("x", []), 3: (None, None), 4: ("b", ["b"])}


def test_open_past_midnight_and_odd_hours(spark):
    hours = "h map<string, struct<open: string, close: string, closed: boolean>>, at string"
    late = {"tuesday": ("20:00", "02:00", False), "wednesday": (None, None, True)}
    rows = [(late, "2024-01-17 01:30:00"), (late, "2024-01-17 02:01:00"), (late, "2024-01-16 20:00:00"), ({"wednesday": ("09:00", None, None)}, "2024-01-17 03:00:00"), ({}, "2024-01-17 03:00:00"), (None, "2024-01-17 03:00:00"), ({"wednesday": (None, None, True)}, "2024-01-17 03:00:00")]
    at = F.col("at").cast("timestamp")
    got = [(r.o, r.n) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {hours}").orderBy("i").select(export.open_now(F.col("h"), at).alias("o"), export.opens(F.col("h"), at).alias("n")).collect()]
    assert got == [(True, None), (False, "Opens Tuesday at 20:00"), (True, None), (True, None), (None, None), (None, None), (False, None)]

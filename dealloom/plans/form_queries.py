"""Prose forms and guides: the expected rows come from the parts of which the views put their texts together, not from patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealloom.operators import forms as X
from dealloom.plans.registry import query
from dealloom.plans.views import VIEWS, oracle, view
from dealloom.sources import guide as G

# Segment number, its text, and its deals: form number, form, place, words, title, days, start, end, all day, confidence ({h} and {g} are hours).
SEGMENTS = (
    (0, "Open 11am-10pm Friday", ((1, "hours_then_day", 5, "11am-10pm friday", "Friday Happy Hour", "friday", "11:00 AM", "10:00 PM", False, 0.8),)),
    (1, "Happy Hours Monday-Saturday: 11am-6:30pm", ((2, "day_range", 0, "happy hours monday-saturday: 11am-6:30pm", "Weekly Happy Hour", "monday,tuesday,wednesday,thursday,friday,saturday", "11:00 AM", "6:30 PM", False, 0.8),)),
    (2, "EVERY DAY {h}-{g}PM & 9-10pm", ((3, "every_day_two_ranges", 0, "every day {h}-{g}pm & 9-10pm", "Daily Happy Hour", "*", "{h}:00 PM", "{g}:00 PM", False, 0.8),)),
    (3, "available {h}-{g}pm every day", ((5, "hours_every_day", 0, "available {h}-{g}pm every day", "Daily Happy Hour", "*", "{h}:00 PM", "{g}:00 PM", False, 0.8),)),
    (4, "$3 $6 $9 Happy Hour", ((7, "prices", 0, "Happy hour with items at $3 $6 $9 pricing", "Happy Hour", None, None, None, False, 0.6),)),
    (5, "now 9pm-close thurs-sat", ((8, "late", 4, "9pm-close thurs-sat", "Late Night Happy Hour", "thursday,friday,saturday", "9:00 PM", "Close", False, 0.8),)),
    (6, "25% off rolls every Tuesday, all day", ((9, "share_on_day", 0, "25% off rolls every tuesday, all day", "25% Off Special", "tuesday", None, None, True, 0.8),)),
    (7, "half-off sake every wed all day", ((9, "share_on_day", 0, "half-off sake every wed all day", "Sake Special", "wednesday", None, None, True, 0.8),)),
    (8, "trivia every Monday", ((10, "day", 7, "every monday", "Monday Special", "monday", None, None, True, 0.8),)),
    (9, "drink special {h}-{g}pm weekdays", ((12, "part_of_week", 0, "drink special {h}-{g}pm weekdays", "Weekday Happy Hour", "monday,tuesday,wednesday,thursday,friday", "{h}:00 PM", "{g}:00 PM", False, 0.8),)),
    (10, "discounted wings {h} - {g} pm on weekends", ((12, "part_of_week", 0, "discounted wings {h} - {g} pm on weekends", "Weekend Happy Hour", "saturday,sunday", "{h}:00 PM", "{g}:00 PM", False, 0.8),)),
    (11, "SUN - SAT - All Day", ((13, "all_week", 0, "sun - sat - all day", "All Day Happy Hour", "*", None, None, True, 0.8),)),
    (12, "happy hour {h}pm-{g}pm mon", ()),
    (13, "quiet night", ()),
    (14, "happy hour: SUN - SAT All Day", ((13, "all_week", 12, "sun - sat all day", "All Day Happy Hour", "*", None, None, True, 0.8),)),
    (15, "{h}-{g}pm every day and every friday", ((5, "hours_every_day", 0, "{h}-{g}pm every day", "Daily Happy Hour", "*", "{h}:00 PM", "{g}:00 PM", False, 0.8), (10, "day", None, "every friday", "Friday Special", "friday", None, None, True, 0.8))),
    (16, "half-off vegan maki every thu, all day", ((9, "share_on_day", 0, "half-off vegan maki every thu, all day", "Vegan Maki Special", "thursday", None, None, True, 0.8),)),
    (17, "from 5 pm - 8 pm on Saturday", ((1, "hours_then_day", 5, "5 pm - 8 pm on saturday", "Saturday Happy Hour", "saturday", "5:00 PM", "8:00 PM", False, 0.8),)),
)
_HOURS = {"h": "CAST(1 + hour(ts) % 5 AS STRING)", "g": "CAST(4 + hour(ts) % 5 AS STRING)"}


def _with_hours(text: str) -> str:
    out = "'" + text.replace("'", "''") + "'"
    for k, sql in _HOURS.items():
        out = out.replace("{" + k + "}", f"' || {sql} || '")
    return out.replace("'{", "").replace("}'", "")


def _segment(number: str) -> str:
    return f"CASE CAST({number} AS INT) " + " ".join(f"WHEN {k} THEN {_with_hours(text)}" for k, text, _ in SEGMENTS) + " END"


FIRST, SECOND = "CASE WHEN event_id % 13 = 12 THEN 13 ELSE event_id % 13 END", "floor(event_id / 13) % 18"
VIEWS["said_x"] = f"""SELECT event_id AS seq, CAST({FIRST} AS INT) AS first, CAST({SECOND} AS INT) AS second, CAST(CASE WHEN event_id % 7 = 0 THEN 8 ELSE 13 END AS INT) AS third, ts,
 {_segment(FIRST)} || chr(10) || {_segment(SECOND)} || chr(10) || {_segment("CASE WHEN event_id % 7 = 0 THEN 8 ELSE 13 END")} AS text FROM {{events}}"""


def _expected() -> str:
    rows = []
    for k, text, deals in SEGMENTS:
        for number, form, place, words, title, days, start, end, all_day, sure in deals:
            at = str(place) if place is not None else f"length({_with_hours(text)}) - {len(words)}"
            week = "'" + "monday,tuesday,wednesday,thursday,friday,saturday,sunday" + "'"
            one = lambda v: "NULL" if v is None else week if v == "*" else _with_hours(v)
            rows.append(f"SELECT seq, base, {number} AS number, '{form}' AS form, base + {at} AS place, {one(title)} AS title, {one(words)} AS description, {one(days)} AS days, {one(start)} AS start_time, {one(end)} AS end_time, {all_day} AS is_all_day, {sure} AS confidence FROM s WHERE k = {k}")
    return " UNION ALL ".join(rows)


SAID = f"""s AS (SELECT seq, ts, first AS k, 0 AS base FROM said_x UNION ALL SELECT seq, ts, second, length({_segment('first')}) + 1 FROM said_x UNION ALL SELECT seq, ts, third, length({_segment('first')}) + length({_segment('second')}) + 2 FROM said_x),
e AS ({_expected()}),
n AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY number, place) - 1 AS pos FROM e),
b AS (SELECT seq, length({_segment('first')}) + 1 AS place, {_with_hours('happy hour {h}pm')} AS description FROM said_x WHERE second = 12 AND seq NOT IN (SELECT seq FROM e))
SELECT seq, CAST(pos AS INT) AS pos, form, CAST(place AS INT) AS place, title, description, days, start_time, end_time, is_all_day, CAST(confidence AS DOUBLE) AS confidence FROM n WHERE pos < 3
UNION ALL SELECT seq, 0, 'bare', CAST(place AS INT), 'Happy Hour', description, NULL, NULL, NULL, true, 0.4 FROM b"""


@query(oracle(SAID, "said_x"))
def x5_common_deals(spark, sf_dir):
    """Deals in the usual forms of prose, three a text at most, none from words that another has."""
    return X.common_deals(view(spark, sf_dir, "said_x"), ("seq",)).withColumn("days", F.array_join("days", ","))


@query(oracle(f"""SELECT seq, 'Happy Hour' AS title, {_with_hours('happy hour {h}pm-{g}pm')} AS description, {_with_hours('{h}:00 PM')} AS start_time, {_with_hours('{g}:00 PM')} AS end_time, CAST(0.6 AS DOUBLE) AS confidence
FROM said_x WHERE second = 12 AND first <> 1 UNION ALL
SELECT seq, 'Happy Hour', 'happy hours monday-saturday: 11am-6:30pm', '11:00 AM', '6:30 PM', 0.6 FROM said_x WHERE first = 1 OR (second = 1 AND first <> 1)""", "said_x"))
def x5_generic_deals(spark, sf_dir):
    """One deal of each text from the words happy hour or daily near a range of hours."""
    rows = view(spark, sf_dir, "said_x").select("seq", F.explode(F.array_compact(F.array(X.generic_deal(F.col("text"))))).alias("d"))
    return rows.select("seq", "d.*")


# Guides of two areas with three places; what is in a place's block follows from the number of the row.
U = "CAST(user_id AS STRING)"
AREA = "CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'Central' WHEN 1 THEN 'LoHi' WHEN 2 THEN 'Speakeasy Spots' WHEN 3 THEN 'Central' WHEN 4 THEN 'RiNo' ELSE 'Taco Tuesday' END"
NAME = f"CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'Cafe ' || {U} WHEN 1 THEN 'Bar \\\\- ' || {U} ELSE 'The \"Pot\" & Co ' || {U} END"
SCHEDULES = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '**Mon \\\\- Fri | 3 \\\\- 6 pm**' || chr(10) WHEN 1 THEN '**Daily 3 - 5 pm**' || chr(10) || '**Sat: all day**' || chr(10) WHEN 2 THEN '' ELSE '**Tue | 9 pm - close**' || chr(10) END"
ADDRESS = f"CASE CAST(event_id % 5 AS INT) WHEN 0 THEN {U} || ' Larimer St' || chr(10) WHEN 1 THEN '1431 Larimer Street' || chr(10) WHEN 2 THEN '16 Wynkoop St, Denver' || chr(10) || '7 Other Street' || chr(10) WHEN 3 THEN '' ELSE '88 Main Ave' || chr(10) END"
LOCATION = "CASE CAST(event_id % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'Old Town' || chr(10) || 'By the river' || chr(10) ELSE 'Old Town' || chr(10) END"
LINK = f"CASE WHEN event_id % 2 = 0 THEN '[site](https://p' || {U} || '.example.com/menu)' || chr(10) ELSE '' END"
NOTE = "CASE WHEN event_id % 11 = 0 THEN '🥕 plant based' || chr(10) ELSE '' END"
CUISINE = "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '*Italian*' || chr(10) WHEN 1 THEN '*Thai*' || chr(10) ELSE '' END"
VIEWS["guide_x"] = f"""SELECT event_id AS seq, user_id, 'A guide' || chr(10) || '***' || {AREA} || '***' || chr(10) || chr(10) || '**' || {NAME} || '**' || chr(10) || {SCHEDULES} || {CUISINE} || {ADDRESS} || {LOCATION} || {LINK} || {NOTE}
 || chr(10) || chr(10) || '**Twin ' || {U} || '**' || chr(10) || '12 First St' || chr(10) || chr(10) || '**Twin ' || {U} || '**' || chr(10) || '1520 Blake St' || chr(10) || '***Uptown***' || chr(10) || chr(10) || '**Last ' || {U} || '**' || chr(10) || 'vegan' || chr(10) || 'vegan menu' AS text FROM {{events}}"""


VIEWS["guide_parts"] = f"SELECT event_id, user_id, event_id % 6 NOT IN (2, 5) AS shown FROM {{events}}"
SHORT = f"CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'Cafe ' || {U} WHEN 1 THEN 'Bar - ' || {U} ELSE 'The \"Pot\" & Co ' || {U} END"
CENTRAL = "event_id % 6 IN (0, 3)"
OWN = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'Old Town' END"
PLACES = f"""SELECT event_id AS seq, {AREA} AS area, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'cafe-' || {U} WHEN 1 THEN 'bar---' || {U} ELSE 'the-pot-co-' || {U} END AS slug, {SHORT} AS name,
 CASE WHEN {CENTRAL} AND event_id % 5 = 1 THEN 'LoDo' WHEN {CENTRAL} AND event_id % 5 = 0 AND regexp_matches(CAST(user_id AS STRING), '1400|1431|1433|1453') THEN 'LoDo' WHEN {CENTRAL} AND event_id % 5 = 2 THEN 'Union Station' WHEN {CENTRAL} AND event_id % 5 <> 3 THEN coalesce({OWN}, 'Central') ELSE {OWN} END AS neighbourhood,
 CASE CAST(event_id % 5 AS INT) WHEN 0 THEN {U} || ' Larimer St' WHEN 1 THEN '1431 Larimer Street' WHEN 2 THEN '16 Wynkoop St, Denver' WHEN 4 THEN '88 Main Ave' END AS address,
 CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'Italian' WHEN 1 THEN 'Thai' END AS cuisine,
 CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'Mon - Fri | 3 - 6 pm' WHEN 1 THEN 'Daily 3 - 5 pm;Sat: all day' WHEN 2 THEN '' ELSE 'Tue | 9 pm - close' END AS schedules,
 CASE WHEN event_id % 2 = 0 THEN 'https://p' || {U} || '.example.com/menu' END AS website, event_id % 11 = 0 AS plant_based FROM guide_parts WHERE shown
UNION ALL SELECT event_id, {AREA}, 'twin-' || {U}, 'Twin ' || {U}, CASE WHEN {CENTRAL} THEN 'LoDo' END, '1520 Blake St', NULL, '', NULL, false FROM guide_parts WHERE shown
UNION ALL SELECT event_id, 'Uptown', 'last-' || {U}, 'Last ' || {U}, 'vegan', NULL, NULL, '', NULL, true FROM guide_parts"""


@query(oracle(PLACES, "guide_parts"))
def s6_guide_places(spark, sf_dir):
    """Places of many guides, with the last of those of one name in an area."""
    return G.guide_places(view(spark, sf_dir, "guide_x"), ("seq",)).withColumn("schedules", F.array_join("schedules", ";"))


LINES = f"""c AS (SELECT unnest(['name', 'schedule', 'cuisine', 'link', 'address', 'location', 'note', 'other']) AS class, unnest([
 sum(CASE WHEN shown THEN 3 ELSE 0 END + 1), sum(CASE WHEN NOT shown THEN 0 WHEN event_id % 4 = 1 THEN 2 WHEN event_id % 4 = 2 THEN 0 ELSE 1 END), sum(CASE WHEN shown AND event_id % 3 < 2 THEN 1 ELSE 0 END), sum(CASE WHEN shown AND event_id % 2 = 0 THEN 1 ELSE 0 END),
 sum(CASE WHEN NOT shown THEN 0 WHEN event_id % 5 = 3 THEN 2 ELSE 3 END), sum(CASE WHEN shown AND event_id % 7 <> 0 THEN 1 ELSE 0 END + 1), sum(CASE WHEN shown AND event_id % 11 = 0 THEN 1 ELSE 0 END + 1),
 sum(CASE WHEN shown AND event_id % 5 = 2 THEN 1 ELSE 0 END + CASE WHEN shown AND event_id % 7 = 1 THEN 1 ELSE 0 END)]) AS n FROM guide_parts)
SELECT class, CAST(n AS BIGINT) AS n FROM c WHERE n > 0"""


@query(oracle(LINES, "guide_parts"))
def s6_guide_lines(spark, sf_dir):
    """How many lines of the guides are of each class."""
    return G.guide_lines(view(spark, sf_dir, "guide_x"), ("seq",)).groupBy("class").agg(F.count("*").alias("n"))

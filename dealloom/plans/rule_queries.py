"""Rules on deals and texts: what they do, one after the other, and deals from named groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealloom.operators import rules as R
from dealloom.operators.extractors import extracted
from dealloom.plans.registry import query
from dealloom.plans.views import VIEWS, oracle, view

# Four rules of each restaurant (one of them broken for some), and two for all.
OWN = "'user-' || CAST(s_suppkey AS STRING)"
NONE = "CAST(NULL AS STRING)"
VIEWS["effect_x"] = f"""SELECT {OWN} AS slug, 2 AS ord, CASE WHEN s_suppkey % 2 = 0 THEN 'taco\\\\s+night' ELSE 'brunch' END AS pattern, {NONE} AS title_part, 'Changed ' || s_name AS new_title, 'Tue;sat;noday' AS days, '4 pm' AS start_time, {NONE} AS end_time, CAST(0.25 AS DOUBLE) AS boost, {NONE} AS append, {NONE} AS prefix, {NONE} AS price FROM {{supplier}}
UNION ALL SELECT {OWN}, 3, {NONE}, 'NIGHT', {NONE}, {NONE}, {NONE}, '11 pm', CAST(NULL AS DOUBLE), {NONE}, 'Two for one', '$5' FROM {{supplier}}
UNION ALL SELECT {OWN}, 0, '(broken', {NONE}, 'Never', {NONE}, {NONE}, {NONE}, CAST(NULL AS DOUBLE), {NONE}, {NONE}, {NONE} FROM {{supplier}} WHERE s_suppkey % 5 = 0
UNION ALL SELECT {NONE}, 1, 'special|brunch', {NONE}, {NONE}, {NONE}, {NONE}, {NONE}, CAST(NULL AS DOUBLE), ' - ask inside', {NONE}, {NONE} FROM {{supplier}} WHERE s_suppkey = 1
UNION ALL SELECT {NONE}, 4, {NONE}, {NONE}, {NONE}, {NONE}, {NONE}, {NONE}, CAST(0.1 AS DOUBLE), {NONE}, {NONE}, {NONE} FROM {{supplier}} WHERE s_suppkey = 1"""


def _deals(spark, sf_dir):
    x = view(spark, sf_dir, "raw_x")
    prices = F.when(F.col("seq") % 3 == 0, F.array("raw_price")).otherwise(F.array().cast("array<string>"))
    return x.select("seq", "slug", F.col("raw_title").alias("title"), F.col("raw_description").alias("description"), F.array(F.lower("raw_day")).alias("days"), F.col("raw_start").alias("start_time"), F.col("raw_end").alias("end_time"), F.col("confidence_score").alias("confidence"), prices.alias("prices"))


def _rules(spark, sf_dir):
    return view(spark, sf_dir, "effect_x").withColumn("days", F.split("days", ";"))


def _shown(out):
    return out.select("seq", "title", "description", F.array_join("days", ",").alias("days"), "start_time", "end_time", F.round("confidence", 6).alias("confidence"), F.array_join("prices", ",").alias("prices"), F.array_join(F.transform("rule_order", lambda o: o.cast("string")), ",").alias("rules"))


PLAIN = """d AS (SELECT r.seq, r.slug, raw_title AS title, raw_description AS d0, lower(raw_day) AS day, raw_start, raw_end, confidence_score AS c, CASE WHEN seq % 3 = 0 THEN raw_price ELSE '' END AS p0, x.s_suppkey AS k, x.name FROM raw_x r LEFT JOIN restaurant_x x ON x.slug = r.slug),
m AS (SELECT *, d0 LIKE '%special' OR title LIKE '%Brunch' AS m1, k IS NOT NULL AND title = CASE WHEN k % 2 = 0 THEN 'Taco Night' ELSE 'Weekend Brunch' END AS m2, k IS NOT NULL AND title LIKE '%Night' AS m3 FROM d),
e AS (SELECT *, d0 || CASE WHEN m1 THEN ' - ask inside' ELSE '' END AS d1, CASE WHEN m3 AND p0 = '' THEN '$5' ELSE p0 END AS p1 FROM m)"""


@query(oracle(f"""{PLAIN}
SELECT seq, CASE WHEN m2 THEN 'Changed ' || name ELSE title END AS title, CASE WHEN m3 THEN 'Two for one - ' ELSE '' END || CASE WHEN p1 = '$5' THEN replace(d1, '$5 ', '') ELSE d1 END AS description,
 CASE WHEN m2 THEN 'tuesday,saturday' ELSE day END AS days, CASE WHEN m2 THEN '4 pm' ELSE raw_start END AS start_time, CASE WHEN m3 THEN '11 pm' ELSE raw_end END AS end_time,
 round(least(1.0, least(1.0, c + CASE WHEN m2 THEN 0.25 ELSE 0 END) + 0.1), 6)::DOUBLE AS confidence, p1 AS prices, concat_ws(',', CASE WHEN m1 THEN '1' END, CASE WHEN m2 THEN '2' END, CASE WHEN m3 THEN '3' END, '4') AS rules FROM e""", "raw_x", "restaurant_x"))
def j10_rule_effects(spark, sf_dir):
    """All rules that a deal meets, in their order: title, days, times, boost, append, prefix, price."""
    return _shown(R.with_effects(_deals(spark, sf_dir), _rules(spark, sf_dir)))


@query(oracle(f"""{PLAIN},
f AS (SELECT *, CASE WHEN m1 THEN 1 WHEN m2 THEN 2 WHEN m3 THEN 3 ELSE 4 END AS r FROM e)
SELECT seq, CASE WHEN r = 2 THEN 'Changed ' || name ELSE title END AS title, CASE WHEN r = 1 THEN d1 WHEN r = 3 THEN 'Two for one (' || CASE WHEN p1 = '$5' THEN replace(d0, '$5 ', '') ELSE d0 END || ')' ELSE d0 END AS description,
 CASE WHEN r = 2 THEN 'tuesday,saturday' ELSE day END AS days, CASE WHEN r = 2 THEN '4 pm' ELSE raw_start END AS start_time, CASE WHEN r = 3 THEN '11 pm' ELSE raw_end END AS end_time,
 round(least(1.0, c + CASE r WHEN 2 THEN 0.25 WHEN 4 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS confidence, CASE WHEN r = 3 THEN p1 ELSE p0 END AS prices, CAST(r AS VARCHAR) AS rules FROM f""", "raw_x", "restaurant_x"))
def j9_first_effect(spark, sf_dir):
    """The first rule that a deal meets."""
    return _shown(R.with_effects(_deals(spark, sf_dir), _rules(spark, sf_dir), first_only=True, brackets=True))


VIEWS["group_x"] = f"""SELECT {OWN} AS slug, 1 AS ord, CASE WHEN s_suppkey % 3 = 2 THEN 'time' ELSE 'deal' END AS kind,
 CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'bar (\\\\d+) ?- ?(\\\\d+ ?pm), tables (\\\\d+) ?- ?(\\\\d+ ?pm)' WHEN 1 THEN 'from (\\\\d+(?:am|pm)?) to (\\\\d+(?:am|pm)?)' ELSE '(\\\\d+(?::\\\\d\\\\d)?) ?- ?(\\\\d+ ?[ap]m)' END AS pattern,
 CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'bar_start_time;bar_end_time;tables_start_time;tables_end_time' WHEN 1 THEN 'start_time;end_time' ELSE 'start;end' END AS groups,
 CASE WHEN s_suppkey % 3 = 1 THEN 'House Hour' END AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'Mon;fri' END AS days FROM {{supplier}}
UNION ALL SELECT {OWN}, 2, 'day', '(mon|tues|fri)[a-z]*', 'day', {NONE}, {NONE} FROM {{supplier}} WHERE s_suppkey % 3 = 2
UNION ALL SELECT {OWN}, 0, 'deal', CASE WHEN s_suppkey % 4 = 0 THEN '(x' ELSE 'x' END, 'start_time', {NONE}, {NONE} FROM {{supplier}} WHERE s_suppkey % 4 < 2"""
VIEWS["talk_x"] = """SELECT event_id AS seq, 'user-' || CAST(user_id % 40 AS STRING) AS slug, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'Bar 3-6pm, tables 4 - 7 pm' WHEN 1 THEN 'from 3 to 6pm and from 9pm to 11' WHEN 2 THEN 'Mondays and Fridays 3:30-6 PM'
 WHEN 3 THEN 'daily 4 - 7pm all day' WHEN 4 THEN 'nothing here' ELSE 'tuesdays only' END AS text FROM {events}"""


@query(oracle("SELECT slug, 1 AS ord, NULL AS error FROM restaurant_x UNION ALL SELECT slug, 2, NULL FROM restaurant_x WHERE s_suppkey % 3 = 2 UNION ALL SELECT slug, 0, CASE WHEN s_suppkey % 4 = 0 THEN 'Invalid regex: Unclosed group near index 2' ELSE 'More names than groups' END FROM restaurant_x WHERE s_suppkey % 4 < 2", "restaurant_x"))
def s5_group_errors(spark, sf_dir):
    return R.group_errors(view(spark, sf_dir, "group_x").withColumn("groups", F.split("groups", ";"))).select("slug", "ord", "error")


@query(oracle("""t AS (SELECT e.seq, e.seq % 6 AS e, x.s_suppkey % 3 AS k FROM talk_x e JOIN restaurant_x x ON x.slug = e.slug)
SELECT seq, 0 AS pos, 'Happy Hour at the Bar' AS title, 'monday,friday' AS days, '3:00 PM' AS start_time, '6:00 PM' AS end_time, false AS is_all_day, 0.9::DOUBLE AS confidence FROM t WHERE k = 0 AND e = 0
UNION ALL SELECT seq, 1, 'Happy Hour at Tables', 'monday,friday', '4:00 PM', '7:00 PM', false, 0.9 FROM t WHERE k = 0 AND e = 0
UNION ALL SELECT seq, 0, 'House Hour', '', '3:00 PM', '6:00 PM', false, 0.8 FROM t WHERE k = 1 AND e = 1 UNION ALL SELECT seq, 1, 'House Hour', '', '9:00 PM', '11:00 PM', false, 0.8 FROM t WHERE k = 1 AND e = 1
UNION ALL SELECT seq, 0, 'Happy Hour', '', '3:00 PM', '6:00 PM', false, 0.8 FROM t WHERE k = 2 AND e = 0 UNION ALL SELECT seq, 0, 'Happy Hour', 'monday,friday', '3:30 PM', '6:00 PM', false, 0.8 FROM t WHERE k = 2 AND e = 2
UNION ALL SELECT seq, 0, 'All Day Happy Hour', 'monday,tuesday,wednesday,thursday,friday,saturday,sunday', '4:00 PM', '7:00 PM', true, 0.8 FROM t WHERE k = 2 AND e = 3""", "talk_x", "restaurant_x"))
def x4_grouped_deals(spark, sf_dir):
    """Deals by the named groups of each restaurant's rules: pairs of bar and tables, several deals of a match, deals from loose parts."""
    rules = view(spark, sf_dir, "group_x").withColumns({"groups": F.split("groups", ";"), "days": F.split("days", ";")})
    return R.grouped_deals(view(spark, sf_dir, "talk_x"), rules, ("seq",)).withColumn("days", F.array_join("days", ","))


def _pairs(text):
    """Times around a dash."""
    import re

    return [{"title": "Pair", "start_time": a, "end_time": b, "confidence": 0.7} for a, b in re.findall(r"(\d+)\s*-\s*(\d+)", text)]


def _named_days(text):
    """Weekdays by name; texts of Tuesday alone are refused."""
    if text.startswith("tuesdays"):
        raise ValueError("no Tuesdays")
    days = [d for d in ("Monday", "Friday") if d in text]
    return [{"title": "Days", "days": days, "extra": 1}] if days else []


@query(oracle("""t AS (SELECT seq, slug, seq % 6 AS e FROM talk_x)
SELECT seq, slug, 0 AS pos, 'Pair' AS title, NULL AS days, '3' AS start_time, '6' AS end_time, 0.7::DOUBLE AS confidence, NULL AS error FROM t WHERE slug = 'user-1' AND e = 0 UNION ALL SELECT seq, slug, 1, 'Pair', NULL, '4', '7', 0.7, NULL FROM t WHERE slug = 'user-1' AND e = 0
UNION ALL SELECT seq, slug, 0, 'Pair', NULL, '30', '6', 0.7, NULL FROM t WHERE slug = 'user-1' AND e = 2 UNION ALL SELECT seq, slug, 0, 'Pair', NULL, '4', '7', 0.7, NULL FROM t WHERE slug = 'user-1' AND e = 3
UNION ALL SELECT seq, slug, 0, 'Days', 'Monday,Friday', NULL, NULL, NULL, NULL FROM t WHERE slug = 'user-2' AND e = 2 UNION ALL SELECT seq, slug, 0, NULL, NULL, NULL, NULL, NULL, 'ValueError: no Tuesdays' FROM t WHERE slug = 'user-2' AND e = 5""", "talk_x"))
def u10_extractors(spark, sf_dir):
    """Two restaurants with extractors of their own, on one table in one pass."""
    out = extracted(view(spark, sf_dir, "talk_x"), ("seq", "slug"), {"user-1": _pairs, "user-2": _named_days})
    return out.withColumn("days", F.array_join("days", ",")).drop("description")

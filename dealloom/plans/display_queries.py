"""Displays of deals: titles, descriptions, schedules and offers vary by the number of their row, and the SQL tells the lines from the same numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealloom.functions import times as T
from dealloom.operators import display as X
from dealloom.plans.registry import query
from dealloom.plans.views import VIEWS, oracle, view

NUMBERS = "CAST(event_id % 5 AS INT) AS k, CAST(event_id % 7 AS INT) AS d, CAST(event_id % 6 AS INT) AS w, CAST(event_id % 4 AS INT) AS h, event_id % 9 = 0 AS priced, CAST(event_id % 11 AS DOUBLE) / 10 AS confidence"
VIEWS["shown_n"] = f"SELECT event_id AS seq, CASE WHEN event_id % 31 = 0 THEN 'solo-' || CAST(event_id AS STRING) ELSE 'user-' || CAST(user_id % 40 AS STRING) END AS slug, {NUMBERS} FROM {{events}}"
VIEWS["shown_x"] = f"""SELECT seq, slug, confidence, CASE k WHEN 0 THEN 'Happy Hour' WHEN 1 THEN 'Happy Hour at the Bar' WHEN 2 THEN 'Taco Night' WHEN 3 THEN 'Happy hour tables' ELSE 'Wine Dinner' END AS title,
 CASE d WHEN 0 THEN '$5 beer' WHEN 1 THEN 'every Tuesday, all day' WHEN 2 THEN 'half off   oysters friday' WHEN 3 THEN 'Special' WHEN 4 THEN ' 3pm - 6:30 pm' WHEN 5 THEN 'taco night: 3pm-6pm Monday 20% less' ELSE 'brunch 3pm-6pm monday' END AS description,
 CASE w WHEN 0 THEN 'friday,monday,tuesday,wednesday,thursday' WHEN 1 THEN 'saturday,sunday' WHEN 2 THEN 'tue' WHEN 4 THEN 'monday,tuesday,wednesday,thursday,friday,saturday,sunday' WHEN 5 THEN 'monday,wednesday,friday,saturday' END AS days,
 CASE h WHEN 0 THEN '3:00 PM' WHEN 2 THEN '4:00 PM' END AS start, CASE h WHEN 0 THEN '6:00 PM' END AS finish, h = 1 AS all_day, CASE WHEN priced THEN '$7 pints' END AS price FROM ({VIEWS["shown_n"]})"""

TITLE = "CASE k WHEN 0 THEN 'Happy Hour' WHEN 1 THEN 'Happy Hour at the Bar' WHEN 2 THEN 'Taco Night' WHEN 3 THEN 'Happy hour tables' ELSE 'Wine Dinner' END"
TEXT = "CASE d WHEN 0 THEN '$5 beer' WHEN 2 THEN 'half off oysters' WHEN 3 THEN 'Special' WHEN 5 THEN 'taco night: 20% less' WHEN 6 THEN 'brunch 3pm-6pm' ELSE '' END"


def shown(spark, sf_dir):
    split = lambda c: F.coalesce(F.split(c, ","), F.array().cast("array<string>"))
    x = view(spark, sf_dir, "shown_x").withColumnRenamed("finish", "end")
    return x.withColumns({"days": split("days"), "prices": F.when(F.col("price").isNotNull(), F.array("price"))})


@query(oracle(f"SELECT seq, {TEXT} AS description FROM shown_n", "shown_n"))
def h39_cleaned_descriptions(spark, sf_dir):
    return shown(spark, sf_dir).select("seq", X.without_schedule(F.col("description")).alias("description"))


@query(oracle(f"""SELECT seq, CASE WHEN k <> 0 THEN {TITLE} WHEN d = 0 THEN 'Drink Specials' WHEN d = 2 THEN 'Discount Specials'
 WHEN h = 1 THEN CASE WHEN w = 2 THEN 'Tuesday All-Day Special' ELSE 'All-Day Happy Hour' END
 WHEN h = 0 THEN CASE w WHEN 0 THEN 'Weekday Happy Hour' WHEN 1 THEN 'Weekend Happy Hour' WHEN 2 THEN 'Tuesday Happy Hour' WHEN 4 THEN 'Daily Happy Hour' ELSE 'Happy Hour' END ELSE 'Special Offers' END AS title,
 CASE w WHEN 0 THEN 'Weekday ' WHEN 1 THEN 'Weekend ' WHEN 2 THEN 'Tuesday ' WHEN 4 THEN 'Daily ' WHEN 5 THEN 'Monday, Wednesday, Friday + 1 more ' ELSE '' END
 || CASE WHEN h = 1 THEN CASE WHEN w = 3 THEN 'All Day Special' ELSE 'All Day' END WHEN h = 0 THEN '3:00 PM - 6:00 PM' ELSE CASE WHEN w = 3 THEN 'Special Offer' ELSE 'Special' END END AS of_group FROM shown_n""", "shown_n"))
def h12_display_titles(spark, sf_dir):
    """Titles of deals and of groups."""
    parts = [F.col(c) for c in ("days", "start", "end", "all_day")]
    return shown(spark, sf_dir).select("seq", X.display_title(F.col("title"), F.col("description"), *parts).alias("title"), X.group_title(*parts).alias("of_group"))


@query(oracle(f"""n AS (SELECT *, count(*) OVER (PARTITION BY slug) > 1 AS several FROM shown_n),
h AS (SELECT slug, confidence, CASE w WHEN 0 THEN 'Mon-Fri: ' WHEN 1 THEN 'Sat, Sun: ' WHEN 2 THEN 'Tue: ' WHEN 4 THEN 'Daily: ' WHEN 5 THEN 'Mon, Wed, Fri, Sat: ' END
 || CASE h WHEN 0 THEN '3:00 PM - 6:00 PM' WHEN 1 THEN 'All Day' ELSE 'Happy Hour' END || CASE WHEN k = 1 THEN ' (Bar)' WHEN k = 3 AND several THEN ' (Tables)' ELSE '' END || CASE WHEN priced THEN ' - $7 pints' ELSE '' END AS line FROM n WHERE w <> 3 OR h < 3),
hg AS (SELECT slug, max(confidence) AS group_confidence, count(DISTINCT line) AS n_deals FROM h GROUP BY slug),
o AS (SELECT slug, w, h, confidence, CASE WHEN d IN (0, 2, 6) THEN CASE WHEN k = 0 THEN '' ELSE {TITLE} || ': ' END || {TEXT} WHEN d = 5 THEN CASE WHEN k IN (0, 2) THEN '' ELSE {TITLE} || ': ' END || {TEXT} END AS line
 FROM n WHERE (d IN (0, 2, 5) OR k = 4) AND NOT (priced AND (w <> 3 OR h < 3) AND NOT several)),
og AS (SELECT slug, w, h, max(confidence) AS group_confidence, count(*) AS n_deals, count(line) AS n_lines FROM o GROUP BY ALL),
ol AS (SELECT slug, w, h, line, max(confidence) AS confidence FROM o GROUP BY ALL)
SELECT slug, true AS is_schedule, '' AS days, NULL AS start, false AS all_day, 'Happy Hours' AS "group", line, max(confidence) AS confidence, any_value(group_confidence) AS group_confidence, any_value(n_deals) AS n_deals FROM h JOIN hg USING (slug) WHERE line IS NOT NULL GROUP BY slug, line
UNION ALL SELECT slug, false, CASE w WHEN 0 THEN 'Mon-Fri' WHEN 1 THEN 'Sat, Sun' WHEN 2 THEN 'Tue' WHEN 4 THEN 'Daily' WHEN 5 THEN 'Mon, Wed, Fri, Sat' ELSE '' END, CASE h WHEN 0 THEN '3:00 PM' WHEN 2 THEN '4:00 PM' END, h = 1,
 CASE WHEN w = 2 THEN 'Tuesday Specials' ELSE 'Special Offers' END, coalesce(line, 'Happy hour specials available'), confidence, group_confidence, n_deals FROM ol JOIN og USING (slug, w, h) WHERE line IS NOT NULL OR n_lines = 0""", "shown_n"))
def w14_w15_display_groups(spark, sf_dir):
    out = X.display_groups(shown(spark, sf_dir))
    return out.withColumn("days", T.compact_days(F.col("days"))).drop("end")


VIEWS["curated_x"] = """SELECT s_suppkey, CASE CAST(s_suppkey % 7 AS INT) WHEN 0 THEN 'daily=3-6 pm' WHEN 1 THEN 'monday_tue=3-6 pm, 9 pm-close' WHEN 2 THEN 'fri=' || CAST(1 + s_suppkey % 5 AS STRING) || '-7 pm;daily=2-4 pm' WHEN 3 THEN '' END AS curated,
 CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'mon,Tuesday,holiday' WHEN 1 THEN 'friday' ELSE 'sunday,mon,tue,wed' END AS days,
 CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN '13:00 - 84:00;3-6pm;all day' WHEN 1 THEN 'x;x;x;x;x;3-6' WHEN 2 THEN '11:30 AM - 2:00 PM' END AS times FROM {supplier}"""
VIEWS["curated_n"] = "SELECT s_suppkey, CAST(s_suppkey % 7 AS INT) AS c, CAST(s_suppkey % 3 AS INT) AS d, CAST(s_suppkey % 4 AS INT) AS t FROM {supplier}"


@query(oracle("""x AS (SELECT *, CASE WHEN c > 2 AND t IN (0, 2) THEN CASE t WHEN 0 THEN '3:00 PM - 6:00 PM' ELSE '11:30 AM - 2:00 PM' END END AS first FROM curated_n)
SELECT s_suppkey, CASE WHEN c = 0 THEN 'Daily=3-6 pm' WHEN c = 1 THEN 'Monday,Tuesday=3-6 pm|9 pm-close' WHEN c = 2 THEN 'Friday=' || (1 + s_suppkey % 5) || '-7 pm;Daily=2-4 pm'
 WHEN first IS NULL THEN '' ELSE CASE d WHEN 0 THEN 'Monday,Tuesday' WHEN 1 THEN 'Friday' ELSE 'Sunday,Monday,Tuesday,Wednesday' END || '=' || first || CASE WHEN t = 0 THEN '|All Day' ELSE '' END END AS schedule,
 CASE WHEN c = 0 THEN 'Daily • 3-6 pm' WHEN c = 1 THEN 'Monday, Tuesday • 3-6 pm, 9 pm-close' WHEN c = 2 THEN 'Daily • 2-4 pm' WHEN first IS NULL THEN 'Check restaurant for details'
 ELSE CASE d WHEN 0 THEN 'Monday, Tuesday' WHEN 1 THEN 'Friday' ELSE 'Sunday, Monday, Tuesday' END || ' • ' || first END AS summary FROM x""", "curated_n"))
def h15_user_schedules(spark, sf_dir):
    """Curated schedules, else extracted ones, with their summary."""
    x = view(spark, sf_dir, "curated_x").withColumn("curated", F.when(F.col("curated") != "", F.str_to_map("curated", F.lit(";"), F.lit("="))))
    weekly, summary = X.user_schedule(F.col("curated"), F.split("days", ","), F.split("times", ";"))
    text = F.transform(weekly, lambda s: F.concat(F.array_join(s["days"], ","), F.lit("="), F.array_join(s["times"], "|")))
    return x.select("s_suppkey", F.array_join(text, ";").alias("schedule"), summary.alias("summary"))


VIEWS["frame_x"] = """SELECT event_id AS seq, CASE CAST(event_id % 10 AS INT) WHEN 0 THEN '3:00 PM - 6:00 PM' WHEN 1 THEN 'all DAY' WHEN 2 THEN '30:00 PM' WHEN 3 THEN '11 AM - PM' WHEN 4 THEN ' 3:00 - 6:00 ' WHEN 5 THEN '3 - 6 pm' WHEN 6 THEN 'from 3:00 PM to 6:00 PM' WHEN 7 THEN 'late' WHEN 8 THEN 'every day from 3:00 PM on till late' END AS frame FROM {events}"""
VIEWS["frame_n"] = "SELECT event_id AS seq, CAST(event_id % 10 AS INT) AS f FROM {events}"


@query(oracle("""SELECT seq, CASE f WHEN 0 THEN '3:00 PM - 6:00 PM' WHEN 1 THEN 'All Day' WHEN 4 THEN '3:00 - 6:00' END AS strict, CASE f WHEN 0 THEN '3:00 PM - 6:00 PM' WHEN 1 THEN 'All Day' WHEN 4 THEN '3:00 - 6:00' WHEN 5 THEN '3 - 6 pm' WHEN 6 THEN 'from 3:00 PM to 6:00 PM' END AS loose FROM frame_n""", "frame_n"))
def h13_kept_timeframes(spark, sf_dir):
    """Both forms that keep a range as it is: of district reports and of profiles."""
    return view(spark, sf_dir, "frame_x").select("seq", X.kept_timeframe(F.col("frame")).alias("strict"), X.kept_timeframe(F.col("frame"), 25, any_case=True).alias("loose"))


VIEWS["paged_x"] = """SELECT event_id AS seq, 'user-' || CAST(user_id % 40 AS STRING) AS slug, CAST(floor(event_id / 100) AS INT) AS page, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'food' WHEN 1 THEN 'drink' WHEN 2 THEN 'drink' ELSE 'unknown' END AS kind,
 CASE CAST(event_id % 5 AS INT) WHEN 0 THEN '$7 pints' WHEN 1 THEN '5' WHEN 2 THEN NULL ELSE '$' || CAST(3 + event_id % 17 AS STRING) || '.50' END AS price,
 CASE WHEN event_id % 3 = 0 THEN CAST(1 + event_id % 9 AS STRING) || ' pm' END AS timeframe, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'monday' WHEN 1 THEN 'friday' END AS day, CASE WHEN event_id % 23 = 0 THEN 'bar only' END AS restriction, CAST(floor(event_id / 100) % 7 AS DOUBLE) / 7 AS confidence FROM {events}"""


@query(oracle("""p AS (SELECT slug, page, avg(CASE WHEN seq % 4 = 0 AND seq % 5 > 2 THEN 3.5 + seq % 17 END) AS food, avg(CASE WHEN seq % 4 IN (1, 2) AND seq % 5 > 2 THEN 3.5 + seq % 17 END) AS drink FROM paged_x GROUP BY ALL),
l AS (SELECT slug, arg_max(food, page) FILTER (food IS NOT NULL) AS food, arg_max(drink, page) FILTER (drink IS NOT NULL) AS drink FROM p GROUP BY slug)
SELECT x.slug, count(*) AS total_deals, count(*) FILTER (seq % 4 = 0) AS food_deals, count(*) FILTER (seq % 4 IN (1, 2)) AS drink_deals, coalesce(string_agg(DISTINCT timeframe, ',' ORDER BY timeframe), '') AS timeframes, coalesce(string_agg(DISTINCT day, ',' ORDER BY day), '') AS days, coalesce(string_agg(DISTINCT restriction, ',' ORDER BY restriction), '') AS restrictions,
 coalesce(round(any_value(l.food), 2), 0)::DOUBLE AS average_food_price, coalesce(round(any_value(l.drink), 2), 0)::DOUBLE AS average_drink_price, round(max(page) % 7 / 7.0::DOUBLE, 6) AS confidence FROM paged_x x JOIN l ON l.slug = x.slug GROUP BY x.slug""", "paged_x"))
def a9_deals_summary(spark, sf_dir):
    out = X.deals_summary(view(spark, sf_dir, "paged_x"))
    return out.withColumns({**{c: F.array_join(c, ",") for c in ("timeframes", "days", "restrictions")}, "confidence": F.round("confidence", 6)})

"""Validators, live deals, contacts, redirects and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealloom.functions import times as T
from dealloom.operators import export as X
from dealloom.operators import pricing as M
from dealloom.operators import quality as Q
from dealloom.operators import validate as V
from dealloom.plans.registry import query
from dealloom.plans.report_queries import PAGES, items
from dealloom.plans.views import VIEWS, oracle, view

CLOCK = "2024-01-30"
VIEWS["check_x"] = """SELECT event_id AS seq, 'user-' || CAST(user_id % 40 AS STRING) AS slug, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN ' x ' WHEN 1 THEN NULL ELSE 'Happy Hour' END AS title,
 CASE CAST(event_id % 7 AS INT) WHEN 0 THEN '3:00 PM' WHEN 1 THEN '3 pm' WHEN 2 THEN 'noon' WHEN 3 THEN 'All day' WHEN 4 THEN '' END AS start_time, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'Close' WHEN 1 THEN 'late' END AS end_time,
 CASE CAST(event_id % 11 AS INT) WHEN 0 THEN '$5.00;cheap' WHEN 1 THEN '50¢;FREE beer' WHEN 2 THEN 'market' WHEN 3 THEN '' ELSE '$5-8' END AS prices, CASE WHEN event_id % 4 = 0 THEN 'monday' ELSE '' END AS days, event_id % 6 = 0 AS is_all_day,
 CASE CAST(event_id % 13 AS INT) WHEN 0 THEN 1.5 WHEN 1 THEN -0.25 WHEN 2 THEN NULL ELSE 0.75 END AS confidence FROM {events}"""


def _checked(spark, sf_dir):
    some = lambda c: F.filter(F.split(c, ";"), lambda x: x != "")
    return view(spark, sf_dir, "check_x").withColumns({"prices": some("prices"), "days": some("days"), "confidence": F.col("confidence").cast("double")})


ISSUES = """i AS (SELECT seq, slug, list_filter([CASE WHEN seq % 5 < 2 THEN 'Title is too short or empty' END, CASE WHEN seq % 7 = 2 THEN 'Invalid start time format: noon' END, CASE WHEN seq % 3 = 1 THEN 'Invalid end time format: late' END,
 CASE seq % 11 WHEN 0 THEN 'Invalid price format: cheap' WHEN 2 THEN 'Invalid price format: market' END, CASE WHEN seq % 4 <> 0 AND seq % 6 <> 0 AND seq % 7 > 3 AND seq % 3 = 2 THEN 'Completely empty deal - no days, times, or all-day flag' END,
 CASE seq % 13 WHEN 0 THEN 'Confidence score out of range: 1.5' WHEN 1 THEN 'Confidence score out of range: -0.25' END], lambda x: x IS NOT NULL) AS issues FROM check_x)"""


@query(oracle(f"{ISSUES} SELECT seq, array_to_string(issues, '; ') AS issues FROM i", "check_x"))
def p12_deal_issues(spark, sf_dir):
    return _checked(spark, sf_dir).select("seq", F.array_join(V.deal_issues(), "; ").alias("issues"))


@query(oracle(f"""{ISSUES}, g AS (SELECT * FROM i WHERE len(issues) = 0 AND seq % 2 = 1)
SELECT seq, slug, true AS is_new FROM g UNION ALL SELECT seq, slug, false FROM check_x WHERE seq % 2 = 0 AND slug NOT IN (SELECT slug FROM g)""", "check_x"))
def p13_replaced_live(spark, sf_dir):
    """Odd rows are a run, even ones are live."""
    rows = _checked(spark, sf_dir)
    return V.replaced_live(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")).select("seq", "slug", "is_new")


VIEWS["place_x"] = """SELECT s_suppkey, CASE CAST(s_suppkey % 6 AS INT) WHEN 0 THEN ' ' WHEN 1 THEN 'A' ELSE s_name END AS name, CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'ftp://x.example.com' WHEN 1 THEN 'https://ok.example.com/a' WHEN 2 THEN 'http:// space' WHEN 3 THEN '' END AS website,
 CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN '12 Main Street' WHEN 1 THEN 'Main Street' WHEN 2 THEN '12 Elmstreet' END AS address, CASE WHEN s_suppkey % 3 = 0 THEN CAST('2024-01-10' AS DATE) WHEN s_suppkey % 3 = 1 THEN CAST('2024-01-23' AS DATE) END AS deals_last_updated, CAST(s_suppkey % 7 AS INT) AS failures FROM {supplier}"""


@query(oracle("""SELECT s_suppkey, 'error' AS level, 'Restaurant name is missing or too short' AS message FROM place_x WHERE s_suppkey % 6 < 2 UNION ALL SELECT s_suppkey, 'warning', 'Website URL appears invalid' FROM place_x WHERE s_suppkey % 5 IN (0, 2)
UNION ALL SELECT s_suppkey, 'warning', 'Address format seems unusual' FROM place_x WHERE s_suppkey % 4 IN (1, 2) UNION ALL SELECT s_suppkey, 'warning', 'Deal data is 20 days old' FROM place_x WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'error', 'Scraping has failed ' || (s_suppkey % 7) || ' times consecutively' FROM place_x WHERE s_suppkey % 7 > 3""", "place_x"))
def p14_restaurant_checks(spark, sf_dir):
    return Q.issues_of(view(spark, sf_dir, "place_x"), ("s_suppkey",), V.restaurant_issues(F.lit(CLOCK).cast("date")))


VIEWS["contact_x"] = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'old phone' END AS phone, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'home' WHEN 1 THEN 'the_old_bar' END AS instagram, CASE WHEN s_suppkey % 5 = 0 THEN 'page' ELSE 'oldbar' END AS facebook FROM {supplier}"""
VIEWS["found_x"] = """SELECT s_suppkey AS id, CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'new phone' WHEN 1 THEN '' END AS phone, CASE CAST(s_suppkey % 7 AS INT) WHEN 0 THEN 'the_new_bar' WHEN 1 THEN '1bar' END AS instagram, CASE WHEN s_suppkey % 2 = 0 THEN 'newbar.x' ELSE 'ab' END AS facebook FROM {supplier} WHERE s_suppkey % 10 <> 9"""


@query(oracle("""SELECT b.id, CASE WHEN b.id % 10 <> 9 AND b.id % 4 = 0 THEN 'new phone' ELSE b.phone END AS phone, CASE WHEN b.id % 10 <> 9 AND b.id % 7 = 0 THEN 'the_new_bar' WHEN b.id % 3 = 1 THEN 'the_old_bar' END AS instagram,
 CASE WHEN b.id % 2 = 0 THEN 'newbar.x' WHEN b.id % 5 <> 0 THEN 'oldbar' END AS facebook FROM contact_x b""", "contact_x"))
def j6_merged_contacts(spark, sf_dir):
    """Plain contacts take what is new, handles what is valid."""
    return V.merged_contacts(view(spark, sf_dir, "contact_x"), view(spark, sf_dir, "found_x"), "id", ("phone",), ("instagram", "facebook"))


VIEWS["url_x"] = "SELECT s_suppkey AS id, 'https://a' || CAST(s_suppkey % 9 AS STRING) || '.example.com' AS website, 'https://a' || CAST(s_suppkey % 4 AS STRING) || '.example.com;https://b.example.com;https://a1.example.com' AS urls FROM {supplier}"
VIEWS["moved_x"] = "SELECT 'https://a' || CAST(n_nationkey AS STRING) || '.example.com' AS old, 'https://new' || CAST(n_nationkey AS STRING) || '.example.com' AS new FROM {nation} WHERE n_nationkey % 2 = 1"


@query(oracle("""SELECT id, CASE WHEN id % 9 % 2 = 1 THEN 'https://new' ELSE 'https://a' END || (id % 9) || '.example.com' AS website,
 CASE WHEN id % 4 = 1 THEN 'https://new1.example.com;https://b.example.com' ELSE CASE WHEN id % 4 = 3 THEN 'https://new' ELSE 'https://a' END || (id % 4) || '.example.com;https://b.example.com;https://new1.example.com' END AS urls FROM url_x""", "url_x"))
def j7_redirected_lists(spark, sf_dir):
    """Websites and lists of addresses after redirects."""
    rows = view(spark, sf_dir, "url_x").withColumn("urls", F.split("urls", ";"))
    return V.redirected(rows, view(spark, sf_dir, "moved_x")).withColumn("urls", F.array_join("urls", ";"))


@query("""SELECT s_suppkey, CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN '9 Whole St, Town' WHEN 1 THEN s_suppkey || ' Oak Ave, Denver, CO 80202' WHEN 2 THEN 'Denver, CO' ELSE 'Old Town' END AS address,
 'https://maps.example.com/?q=' || CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN '9+Whole+St%2C+Town' WHEN 1 THEN s_suppkey || '+Oak+Ave%2C+Denver%2C+CO+80202' WHEN 2 THEN 'Denver%2C+CO' ELSE 'Old+Town' END AS map_link FROM supplier""")
def p30_addresses(spark, sf_dir):
    """The formatted address, else one from its parts, else the neighborhood; and a link to a map."""
    part = lambda value, *when: F.when((F.col("s_suppkey") % 4).isin(*when), value)
    parts = F.struct(part("9 Whole St, Town ", 0).alias("formatted_address"), part(F.col("s_suppkey").cast("string"), 1).alias("street_number"), part("Oak Ave", 1).alias("street_name"), part("Denver", 1, 2).alias("city"), part("CO", 1, 2).alias("state"), part("80202", 1).alias("zip_code"))
    rows = view(spark, sf_dir, "supplier").select("s_suppkey", parts.alias("address_struct"), F.lit("Old Town").alias("neighborhood"))
    return rows.select("s_suppkey", Q.address().alias("address"), Q.map_link(Q.address(), "https://maps.example.com/?q=").alias("map_link"))


VIEWS["hours_x"] = """SELECT 'user-' || CAST(s_suppkey AS STRING) AS slug, s_name AS name, CASE CAST(s_suppkey % 4 AS INT) WHEN 1 THEN 'monday 09:00 17:00;tuesday 09:00 17:00;wednesday 09:00 17:00' WHEN 2 THEN 'wednesday closed;thursday 18:00 23:00' WHEN 3 THEN 'tuesday 20:00 02:00' ELSE 'wednesday 18:30 02:00' END AS hours FROM {supplier} WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'user-' || CAST(s_suppkey AS STRING), s_name, NULL FROM {supplier} WHERE s_suppkey % 5 = 0"""
LINE = """CASE WHEN lower(substr(raw_day, 1, 3)) = 'thu' THEN 'Thu' ELSE upper(substr(raw_day, 1, 1)) || lower(substr(raw_day, 2, 2)) END || CASE WHEN seq % 7 = 0 THEN ' All Day' WHEN raw_start IS NOT NULL THEN ' ' || raw_start || ' - ' || raw_end ELSE '' END || CASE WHEN seq % 2 = 0 THEN ' (' || raw_price || ')' ELSE '' END"""


@query(oracle(f"""n AS (SELECT slug, count(*) AS n FROM raw_x GROUP BY slug), r AS (SELECT slug, seq, {LINE} AS line, row_number() OVER (PARTITION BY slug ORDER BY seq) AS k FROM raw_x WHERE confidence_score >= 0.7),
l AS (SELECT slug, string_agg(line, '; ' ORDER BY k) AS lines FROM r WHERE k <= 3 GROUP BY slug)
SELECT h.slug, name, coalesce(n, 0) AS n_deals, coalesce(lines, '') AS lines, n IS NOT NULL AS live_data_available, CASE WHEN hours IS NOT NULL THEN hours LIKE 'monday%' END AS is_open_now,
 CASE WHEN hours LIKE 'wednesday closed%' THEN 'Opens tomorrow at 18:00' WHEN hours LIKE 'tuesday%' THEN 'Opens Tuesday at 20:00' WHEN hours LIKE 'wednesday 18%' THEN 'Opens in 2h 10m' END AS opens
FROM hours_x h LEFT JOIN n ON n.slug = h.slug LEFT JOIN l ON l.slug = h.slug""", "raw_x", "hours_x"))
def s14_website_rows(spark, sf_dir):
    """Restaurants with their state on a Wednesday afternoon and their first three sure deals."""
    one = lambda x: F.struct(F.split_part(x, F.lit(" "), F.lit(1)).alias("day"), F.struct(F.nullif(F.regexp_extract(x, r" (\d\S+)", 1), F.lit("")).alias("open"), F.nullif(F.regexp_extract(x, r" \S+ (\S+)", 1), F.lit("")).alias("close"), x.endswith("closed").alias("closed")).alias("h"))
    places = view(spark, sf_dir, "hours_x").withColumn("hours", F.map_from_entries(F.transform(F.split("hours", ";"), one)))
    prices = F.when(F.col("seq") % 2 == 0, F.array("raw_price"))
    deals = view(spark, sf_dir, "raw_x").select("seq", "slug", T.day_list(F.array("raw_day")).alias("days"), F.col("raw_start").alias("start_time"), F.col("raw_end").alias("end_time"), (F.col("seq") % 7 == 0).alias("is_all_day"), F.col("confidence_score").alias("confidence"), prices.alias("prices"))
    out = X.website_rows(places, deals, F.lit("2024-01-17 16:20:00").cast("timestamp"))
    return out.select("slug", "name", "n_deals", F.array_join("happy_hour_times", "; ").alias("lines"), "live_data_available", "is_open_now", "opens")


@query(oracle(f"""{PAGES}, k AS (SELECT slug, menu_type, arg_max(band, page_id) AS band, min(average) FILTER (average > 0) AS least, max(average) FILTER (average > 0) AS most, sum(n_items) AS n FROM banded GROUP BY ALL)
SELECT slug, string_agg(menu_type || '=' || band, ';' ORDER BY menu_type) AS bands, round(min(least), 4) AS least_average, round(max(most), 4) AS most_average, CAST(sum(n) AS BIGINT) AS n_items, coalesce(max(band) FILTER (menu_type = 'dinner'), max(band)) AS overall_band FROM k GROUP BY slug""", "menu_x"))
def a8_band_maps(spark, sf_dir):
    out = M.band_maps(M.page_statistics(items(spark, sf_dir), "page_id", "slug", "menu_type"))
    shown = F.array_join(F.transform(F.map_entries("bands"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.withColumns({"bands": shown, "least_average": F.round("least_average", 4), "most_average": F.round("most_average", 4)})

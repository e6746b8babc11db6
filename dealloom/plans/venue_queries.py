"""Profiles of venues: each part of a text is there or not by the number of its row, and the SQL tells the fields from the same numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealloom.operators import venue as V
from dealloom.plans.registry import query
from dealloom.plans.views import VIEWS, oracle, view

U, FOUR = "CAST(user_id AS STRING)", "substr(CAST(10000 + user_id % 10000 AS STRING), 2, 4)"
PAD = "'Our kitchen cooks what the season brings and the garden behind the house gives us every day. '"


def _if(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} ELSE '' END"


# Condition on the number of the row, and the text that it brings.
PARTS = (
    ("event_id % 2 = 0", f"'Call 303-555-' || {FOUR} || '. '"), ("true", PAD), ("event_id % 3 = 0", f"'For a reservation: 720.555.' || {FOUR} || '. '"), ("true", PAD),
    ("event_id % 5 = 0", f"'hello@p' || {U} || '.example.com. '"), ("event_id % 7 = 0", f"'booking@p' || {U} || '.example.com. '"), ("event_id % 11 = 0", f"'Party@p' || {U} || '.example.com. '"), ("event_id % 13 = 0", f"'chef@p' || {U} || '.example.com. '"),
    ("event_id % 4 = 0", "'Monday - Friday: 11:00 AM - 10:00 PM, Sat 12pm-11:30pm, Sunday: closed. '"), ("event_id % 4 = 1", "'Fri - Mon 5 pm - 9 pm. '"), ("event_id % 4 = 2", "'Tuesday 1130am - 2pm, Tue 12:00 pm - 3:00 pm. '"),
    ("event_id % 17 = 0", "'Closed temporarily. '"), ("event_id % 17 = 1", "'No longer open. '"), ("event_id % 6 = 0", "'A budget place. '"), ("event_id % 6 = 1", "'Moderate. '"), ("event_id % 6 = 2", "'Fine dining. '"), ("event_id % 6 = 3", "'Luxury. '"),
    ("event_id % 9 = 0", "'Romantic and lively. '"), ("event_id % 9 = 1", "'Kids are welcome. '"), ("event_id % 12 = 5", f"'Follow @venue' || {U} || 'x now. '"), ("event_id % 14 = 0", "'Takeout. '"), ("event_id % 15 = 0", "'Curbside. '"), ("event_id % 16 = 0", "'We deliver. '"),
    ("event_id % 18 = 0", f"{U} || ' Market Street, Denver, CO 80202. '"), ("event_id % 18 = 1", "'12 Elm Way. '"), ("event_id % 19 = 0", "CAST(40 + event_id % 50 AS STRING) || ' seats. '"), ("event_id % 19 = 1", "'Capacity: 90. '"),
    ("event_id % 20 = 0", "'Counter service. '"), ("event_id % 20 = 1", "'A food truck. '"), ("event_id % 20 = 2", "'A brewery. '"),
)
LINKS = (
    ("event_id % 8 = 0", "'https://www.OpenTable.com/r/p' "), ("event_id % 8 = 1", "'https://resy.com/x' "), ("event_id % 8 = 2", "'https://p.example.com/booking' "), ("event_id % 10 = 0", "'https://doordash.com/s' "), ("event_id % 10 = 1", "'https://www.ubereats.com/s' "), ("event_id % 10 = 2", "'https://grubhub.com/s' "),
    ("event_id % 12 = 0", f"'https://instagram.com/venue' || {U} || 'x?hl=en'"), ("event_id % 12 = 1", "'https://facebook.com/page'"), ("event_id % 12 = 2", f"'https://fb.com/venue' || {U} || 'x/'"), ("event_id % 12 = 3", f"'https://x.com/venue' || {U} || 'x'"), ("event_id % 12 = 4", f"'https://www.tiktok.com/@venue' || {U} || 'x'"),
)
VIEWS["venue_x"] = f"SELECT event_id AS seq, {' || '.join(_if(c, t) for c, t in PARTS)} AS text, {' || '.join(_if(c, t + chr(32) + '|| chr(10)') for c, t in LINKS)} AS links FROM {{events}}"
VIEWS["venue_parts"] = "SELECT event_id, user_id FROM {events}"

WEEKDAYS = ";".join(f"{d} 11:00-22:00" for d in ("monday", "tuesday", "wednesday", "thursday", "friday"))
FACTS = f"""SELECT event_id AS seq,
 CASE WHEN event_id % 2 = 0 THEN '(303) 555-' || {FOUR} WHEN event_id % 3 = 0 THEN '(720) 555-' || {FOUR} END AS primary_phone, CASE WHEN event_id % 3 = 0 THEN '(720) 555-' || {FOUR} END AS reservation_phone,
 CASE WHEN event_id % 5 = 0 THEN 'hello@p' || {U} || '.example.com' WHEN event_id % 13 = 0 THEN 'chef@p' || {U} || '.example.com' END AS general_email,
 CASE WHEN event_id % 7 = 0 THEN 'booking@p' || {U} || '.example.com' END AS reservations_email, CASE WHEN event_id % 11 = 0 THEN 'party@p' || {U} || '.example.com' END AS events_email,
 CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '{WEEKDAYS};saturday 12:00-23:30;sunday closed' WHEN 1 THEN 'monday 17:00-21:00;friday 17:00-21:00;saturday 17:00-21:00;sunday 17:00-21:00' WHEN 2 THEN 'tuesday 12:00-15:00' ELSE '' END AS hours,
 CASE CAST(event_id % 17 AS INT) WHEN 0 THEN 'temporarily_closed' WHEN 1 THEN 'permanently_closed' ELSE 'operational' END AS business_status,
 CASE CAST(event_id % 6 AS INT) WHEN 0 THEN '$' WHEN 1 THEN '$$' WHEN 2 THEN '$$$' WHEN 3 THEN '$$$$' END AS price_range, CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'romantic,lively' WHEN 1 THEN 'family_friendly' ELSE '' END AS atmosphere,
 CASE WHEN event_id % 8 = 0 THEN 'https://www.OpenTable.com/r/p' END AS opentable_url, CASE WHEN event_id % 8 = 1 THEN 'https://resy.com/x' END AS resy_url, CASE WHEN event_id % 8 = 2 THEN 'https://p.example.com/booking' END AS direct_reservation_url,
 CASE WHEN event_id % 10 = 0 THEN 'https://doordash.com/s' END AS doordash_url, CASE WHEN event_id % 10 = 1 THEN 'https://www.ubereats.com/s' END AS ubereats_url, CASE WHEN event_id % 10 = 2 THEN 'https://grubhub.com/s' END AS grubhub_url,
 event_id % 8 < 3 OR event_id % 3 = 0 AS accepts_reservations, event_id % 10 < 3 OR event_id % 16 = 0 AS offers_delivery, event_id % 14 = 0 AS offers_takeout, event_id % 15 = 0 AS offers_curbside,
 CASE WHEN event_id % 12 IN (0, 5) THEN 'venue' || {U} || 'x' END AS instagram, CASE WHEN event_id % 12 = 2 THEN 'venue' || {U} || 'x' END AS facebook, CASE WHEN event_id % 12 = 3 THEN 'venue' || {U} || 'x' END AS twitter, CASE WHEN event_id % 12 = 4 THEN 'venue' || {U} || 'x' END AS tiktok,
 CASE CAST(event_id % 18 AS INT) WHEN 0 THEN {U} || ' Market Street' WHEN 1 THEN '12 Elm Way' END AS street_address, CASE WHEN event_id % 18 = 0 THEN 'Denver' END AS city, CASE WHEN event_id % 18 = 0 THEN 'CO' END AS state, CASE WHEN event_id % 18 = 0 THEN '80202' END AS zip_code,
 CAST(CASE CAST(event_id % 19 AS INT) WHEN 0 THEN 40 + event_id % 50 WHEN 1 THEN 90 END AS INT) AS total_seats, CASE CAST(event_id % 20 AS INT) WHEN 0 THEN 'fast_casual' WHEN 1 THEN 'food_truck' WHEN 2 THEN 'bar' ELSE 'full_service' END AS dining_style
FROM venue_parts"""
ONE = ("primary_phone", "reservation_phone", "general_email", "reservations_email", "events_email", "price_range", "instagram", "facebook", "twitter", "tiktok", "street_address", "city", "state", "zip_code")
TWO = ("opentable_url", "resy_url", "direct_reservation_url", "doordash_url", "ubereats_url", "grubhub_url")
FOUND = " + ".join([f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in ONE] + [f"CASE WHEN {c} IS NULL THEN 0 ELSE 2 END" for c in TWO] + [f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in ("hours <> ''", "atmosphere <> ''", "offers_takeout", "offers_curbside", "business_status <> 'operational'", "seq % 16 = 0 AND seq % 10 > 2")])


@query(oracle(f"f AS ({FACTS}), n AS (SELECT *, CAST({FOUND} AS INT) AS fields_found FROM f) SELECT *, round(fields_found / 25.0::DOUBLE, 6) AS completeness, round(least(0.9, fields_found / 25.0::DOUBLE * 1.2), 6) AS confidence FROM n", "venue_parts"))
def x11_profiles(spark, sf_dir):
    """All fields of each venue's profile in one scan of its text and links."""
    rows = view(spark, sf_dir, "venue_x").withColumn("links", F.filter(F.split("links", "\n"), lambda x: x != ""))
    out = V.profiled(rows, "text", "links")
    day = lambda e: F.concat_ws(" ", e["key"], F.when(e["value"]["closed"], "closed").otherwise(F.concat_ws("-", e["value"]["open"], e["value"]["close"])))
    return out.withColumns({"hours": F.array_join(F.transform(F.map_entries("hours"), day), ";"), "atmosphere": F.array_join("atmosphere", ",")}).drop("text", "links", "source_quality")

"""Places: estimated prices, hours of periods, addresses, due updates and status by district, with parts by the number of the row."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealloom.functions import deals as D
from dealloom.functions import times as T
from dealloom.operators import export as E
from dealloom.operators import pricing as P
from dealloom.operators import quality as Q
from dealloom.operators import status as S
from dealloom.plans.registry import query
from dealloom.plans.report_queries import CLOCK, slots
from dealloom.plans.report_queries import SLOTS as SLOTS_SQL
from dealloom.plans.views import VIEWS, oracle, view

VIEWS["rated_x"] = """SELECT s_suppkey, 'user-' || CAST(s_suppkey AS STRING) AS slug, s_name AS name, CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN '$$$$' WHEN 1 THEN '$$$' WHEN 2 THEN '$$' WHEN 3 THEN '$' END AS price_range,
 CASE CAST(s_suppkey % 7 AS INT) WHEN 0 THEN 'Brazilian Steakhouse' WHEN 1 THEN 'Cocktail Lounge' WHEN 2 THEN 'Japanese' WHEN 3 THEN 'Mexican' WHEN 4 THEN 'Sushi Bar' WHEN 5 THEN 'Italian' END AS cuisine FROM {supplier}"""
VIEWS["offers_x"] = """SELECT event_id AS seq, 'user-' || CAST(2 * (user_id % 150) AS STRING) AS slug, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '$' || CAST(3 + event_id % 14 AS STRING) || '.50' END AS price,
 CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'Pints at $' || CAST(2 + event_id % 9 AS STRING) WHEN 1 THEN 'Nachos' WHEN 2 THEN 'Cocktail hour' END AS title, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'house special $6' WHEN 1 THEN 'Pizza' END AS description,
 CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'Food' WHEN 1 THEN 'beverage' END AS deal_type FROM {events}"""
VIEWS["offers_n"] = "SELECT event_id AS seq, 'user-' || CAST(2 * (user_id % 150) AS STRING) AS slug, event_id AS e FROM {events}"


@query(oracle("""a AS (SELECT slug, CASE WHEN e % 3 = 1 THEN 3.5 + e % 14 WHEN e % 4 = 0 THEN 2 + e % 9 WHEN e % 4 = 3 AND e % 5 = 0 THEN 6 END AS amount, e % 4 = 2 AS drink, e % 4 = 1 OR e % 5 = 1 AS food, CASE WHEN e % 6 = 0 THEN 'f' WHEN e % 6 = 1 THEN 'd' END AS kind FROM offers_n),
k AS (SELECT slug, amount, drink OR (NOT drink AND NOT food AND CASE kind WHEN 'f' THEN false WHEN 'd' THEN true ELSE amount <= 10 END) AS drink, food OR (NOT drink AND NOT food AND CASE kind WHEN 'f' THEN true WHEN 'd' THEN false ELSE amount > 10 END) AS food FROM a),
g AS (SELECT slug, count(*) AS n, round(avg(amount) FILTER (drink), 2)::DOUBLE AS d, round(avg(amount) FILTER (food), 2)::DOUBLE AS f FROM k GROUP BY slug),
r AS (SELECT slug, CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 14 WHEN 1 THEN 11 WHEN 3 THEN 6 ELSE 8 END + CASE CAST(s_suppkey % 7 AS INT) WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN -0.5 WHEN 4 THEN 1 ELSE 0 END AS d0,
 CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 18 WHEN 1 THEN 14 WHEN 3 THEN 8 ELSE 11 END + CASE CAST(s_suppkey % 7 AS INT) WHEN 0 THEN 3 WHEN 1 THEN -2 WHEN 2 THEN 2 WHEN 3 THEN -1 WHEN 4 THEN 0 WHEN 5 THEN 1 ELSE 0 END AS f0 FROM rated_x)
SELECT r.slug, coalesce(n, 0) AS n_deals, CASE WHEN n > 0 THEN coalesce(d, d0)::DOUBLE END AS drink_price, CASE WHEN n > 0 THEN coalesce(f, f0)::DOUBLE END AS food_price FROM r LEFT JOIN g ON g.slug = r.slug""", "rated_x", "offers_n"))
def a25_average_prices(spark, sf_dir):
    """Mean prices by kind over all deals, with estimates for restaurants whose deals tell none."""
    return P.average_prices(view(spark, sf_dir, "rated_x"), view(spark, sf_dir, "offers_x"))


AT = "2024-01-17 16:20:00"  # a Wednesday


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '0' || (6 + s_suppkey % 4) || ':00-1' || (2 + s_suppkey % 8) || ':30' WHEN s_suppkey % 3 = 1 THEN '0' || (5 + s_suppkey % 5) || ':0' || (s_suppkey % 10) || '-1' || (2 + s_suppkey % 7) || ':00' END AS wednesday,
 CASE WHEN s_suppkey % 4 <> 1 THEN '18:00-02:00' END AS sunday, CASE WHEN s_suppkey % 3 = 2 AND s_suppkey % 4 = 1 THEN NULL WHEN s_suppkey % 3 = 0 THEN 2 + s_suppkey % 8 >= 6 WHEN s_suppkey % 3 = 1 THEN 2 + s_suppkey % 7 > 6 ELSE false END AS is_open FROM supplier""")
def h18_h19_period_hours(spark, sf_dir):
    """Hours of periods in both forms, half-told ones among them, and whether the place is open."""
    k, none = F.col("s_suppkey"), F.lit(None)
    end = lambda day, time=none, hour=none, minute=none: F.struct(day.cast("int").alias("day"), time.cast("string").alias("time"), hour.cast("int").alias("hour"), minute.cast("int").alias("minute"))
    period = lambda a, b: F.struct(a.alias("open"), b.alias("close"))
    wed = F.lit(3)
    timed = period(end(wed, F.concat(F.lit("0"), 6 + k % 4, F.lit("00"))), end(wed, F.concat(F.lit("1"), 2 + k % 8, F.lit("30"))))
    told = period(end(wed, hour=5 + k % 5, minute=k % 10), end(wed, hour=12 + k % 7))
    mixed = period(end(wed, F.lit("0700")), end(wed, hour=F.lit(15)))
    late = period(end(F.when(k % 4 != 1, 0), F.lit("1800")), end(F.lit(1), F.lit("0200")))
    x = view(spark, sf_dir, "supplier").select("s_suppkey", F.array(late, period(end(F.lit(9), F.lit("0100")), end(F.lit(9), F.lit("0200"))), F.when(k % 3 == 0, timed).when(k % 3 == 1, told).otherwise(mixed)).alias("p"))
    x = x.withColumn("h", T.period_hours(F.col("p")))
    day = lambda d: F.concat(F.col("h")[d]["open"], F.lit("-"), F.col("h")[d]["close"])
    hours = F.transform_values("h", lambda _, v: F.struct(v["open"].alias("open"), v["close"].alias("close"), F.lit(False).alias("closed")))
    return x.select("s_suppkey", day("wednesday").alias("wednesday"), day("sunday").alias("sunday"), E.open_now(hours, F.lit(AT).cast("timestamp")).alias("is_open"))


@query("""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 <> 5 THEN CAST(c_custkey AS VARCHAR) END AS number, CASE WHEN c_custkey % 6 <> 5 THEN CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'United Street' WHEN 1 THEN 'E 7th Ave' WHEN 2 THEN 'Unit Way' ELSE 'St. Paul' END END AS street,
 CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN '4B' WHEN 1 THEN '12' WHEN 2 THEN '3' WHEN 3 THEN 'C' END AS unit, CASE WHEN c_custkey % 5 <> 0 THEN 'Denver' END AS city, CASE WHEN c_custkey % 7 <> 0 THEN 'CO' END AS state, CASE WHEN c_custkey % 3 <> 0 THEN '80202' END AS zip FROM customer),
 f AS (SELECT *, CASE WHEN number IS NULL THEN NULL ELSE concat_ws(' ', number, street, unit) END AS line, CASE WHEN city IS NOT NULL THEN concat_ws(', ', city, nullif(concat_ws(' ', state, zip), '')) WHEN state IS NOT NULL THEN concat_ws(', ', state, zip) ELSE zip END AS place FROM a)
SELECT k AS c_custkey, number, street, unit, nullif(concat_ws(', ', line, place), '') AS address, 'https://maps.example.com/?q=' || replace(replace(nullif(concat_ws(', ', line, place), ''), ',', '%2C'), ' ', '+') AS link FROM f""")
def h42_addresses(spark, sf_dir):
    """Address lines in several forms to parts, and back to one form with a link."""
    k = F.col("c_custkey")
    street = F.when(k % 4 == 0, "United Street").when(k % 4 == 1, "E 7th Ave").when(k % 4 == 2, "Unit Way").otherwise("St. Paul")
    unit = F.when(k % 6 == 0, " #4B").when(k % 6 == 1, " Suite 12").when(k % 6 == 2, " apt. 3").when(k % 6 == 3, "#C").otherwise("")
    line = F.when(k % 6 == 5, street).otherwise(F.concat(k.cast("string"), F.lit(" "), street, unit, F.when(k % 2 == 0, ", Springfield").otherwise("")))
    parts = view(spark, sf_dir, "customer").select("c_custkey", *D.street_parts(line))
    shown = D.formatted_address(F.col("number"), F.col("street"), F.col("unit"), F.when(k % 5 != 0, "Denver"), F.when(k % 7 != 0, "CO").otherwise(" "), F.when(k % 3 != 0, "80202"))
    out = parts.withColumn("address", shown)
    return out.withColumn("link", Q.map_link(F.col("address"), "https://maps.example.com/?q="))


VIEWS["due_x"] = "SELECT event_id AS seq, CASE WHEN event_id % 10 <> 0 THEN ts END AS updated, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' WHEN 3 THEN 'quarterly' WHEN 4 THEN 'other' END AS kind, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 400 AS INT) END AS hours FROM {events}"


@query(oracle("""SELECT seq FROM due_x WHERE updated IS NULL OR epoch(TIMESTAMP '2024-02-10 16:20:00') - epoch(updated) >= CASE WHEN hours IS NOT NULL THEN hours * 3600 ELSE 86400 * CASE kind WHEN 'daily' THEN 1 WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 90 ELSE 7 END END""", "due_x"))
def t5_due(spark, sf_dir):
    """Rows due by their class of data or by hours of their own."""
    return S.due(view(spark, sf_dir, "due_x"), F.lit("2024-02-10 16:20:00").cast("timestamp"), "updated", F.col("kind"), F.col("hours")).select("seq")


@query(oracle(f"""{SLOTS_SQL}, g AS (SELECT district, count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'upcoming') AS upcoming FROM restaurant_x x LEFT JOIN status s ON s.slug = x.slug GROUP BY district)
SELECT *, CASE WHEN active > 0 THEN active || ' happy hours active now' WHEN upcoming > 0 THEN upcoming || ' starting soon' ELSE 'No active happy hours' END AS message FROM g""", "raw_x", "restaurant_x"))
def a33_district_status(spark, sf_dir):
    """Live status of all restaurants of each district, those without hours included."""
    status = S.live_status(slots(spark, sf_dir), F.lit(CLOCK).cast("timestamp")).select("slug", "status")
    return S.status_rollup(view(spark, sf_dir, "restaurant_x").select("slug", "district").join(status, "slug", "left"), "district")

"""Extraction from prose, issues, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dealloom.functions import times as T
from dealloom.operators import extract as X
from dealloom.operators import quality as Q
from dealloom.operators.overlap import without_overlaps
from dealloom.plans.deal_queries import DAY, deals
from dealloom.plans.registry import query
from dealloom.plans.views import VIEWS, oracle, view

VIEWS["prose_x"] = """SELECT event_id AS seq, 'user-' || CAST(user_id % 40 AS STRING) AS slug,
 CASE WHEN event_id % 4 = 0 THEN 'Happy hour ' ELSE 'Join us ' END
 || CASE (day(ts)-1) % 7 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tue' WHEN 2 THEN 'Weekdays' WHEN 3 THEN 'daily' WHEN 4 THEN '' WHEN 5 THEN 'Saturday' ELSE 'sun' END
 || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' from ' || CAST(1 + hour(ts) % 11 AS STRING) || ' - ' || CAST(2 + hour(ts) % 10 AS STRING) || ' pm' END
 || CASE WHEN event_id % 5 = 0 THEN ', all day on Friday' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN '. Beer $' || CAST(event_id % 60 AS STRING) ELSE '.' END AS text
FROM {events}"""
RANGE = r"\d{1,2} - \d{1,2} pm|all day"
DAYS = "Monday|Tue|Weekdays|daily|Saturday|sun|Friday"


@query(oracle(f"""m AS (SELECT seq, text, unnest(regexp_extract_all(text, '{RANGE}')) AS match, unnest(range(len(regexp_extract_all(text, '{RANGE}')))) AS pos FROM prose_x)
SELECT seq, 'time' AS kind, CAST(pos AS INT) AS pos, CAST(instr(text, match) - 1 AS INT) AS start, match FROM m""", "prose_x"))
def x1_time_mentions(spark, sf_dir):
    return X.mentions(view(spark, sf_dir, "prose_x"), ("seq",), {"time": X.TIME_RANGE})


@query(oracle(f"""m AS (SELECT seq, text, unnest(regexp_extract_all(text, '{RANGE}')) AS match FROM prose_x),
d AS (SELECT seq, unnest(regexp_extract_all(text, '{DAYS}')) AS day, text FROM prose_x),
j AS (SELECT m.seq, match, day, instr(m.text, match) - instr(d.text, day) AS gap, instr(d.text, day) AS place FROM m LEFT JOIN d ON d.seq = m.seq)
SELECT seq, match, coalesce(arg_min(day, place) FILTER (gap BETWEEN 1 AND 20), arg_min(day, abs(gap) * 1000 + place) FILTER (abs(gap) <= 30), CASE WHEN bool_or(lower(day) LIKE '%daily%') THEN 'daily' END) AS day FROM j GROUP BY seq, match""", "prose_x"))
def j13_nearest_day(spark, sf_dir):
    x = view(spark, sf_dir, "prose_x").select("seq", F.explode(X.matches(F.col("text"), X.TIME_RANGE)).alias("m"), X.matches(F.col("text"), X.DAYS).alias("days"))
    return x.select("seq", F.col("m.text").alias("match"), X.nearest_day(F.col("m.start"), F.col("days")).alias("day"))


SECTION_DEALS = rf"""p AS (SELECT *, regexp_extract_all(text, '{RANGE}') AS ts, regexp_extract_all(text, '{DAYS}') AS ds, 0.5 + CASE WHEN lower(text) LIKE '%happy hour%' THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(text, '\$\d') THEN 0.1 ELSE 0 END AS b FROM prose_x),
r AS (SELECT seq, unnest(ts) AS "time", round(CAST(least(1.0, b + 0.3 + CASE WHEN len(ds) > 0 THEN 0.2 ELSE 0 END) AS DOUBLE), 6) AS confidence FROM p WHERE len(ts) > 0
 UNION ALL SELECT seq, NULL, round(CAST(least(1.0, b + 0.2) AS DOUBLE), 6) FROM p WHERE len(ts) = 0 AND len(ds) > 0
 UNION ALL SELECT seq, NULL, 0.5 FROM p WHERE len(ts) = 0 AND len(ds) = 0 AND lower(text) LIKE '%happy hour%')"""


@query(oracle(f'{SECTION_DEALS} SELECT seq, "time", confidence FROM r', "prose_x"))
def x2_section_deals(spark, sf_dir):
    return X.section_deals(view(spark, sf_dir, "prose_x"), ("seq",)).select("seq", "time", "confidence")


@query(oracle("""d AS (SELECT seq, unnest(regexp_extract_all(text, 'Monday|Tue|Weekdays|daily|Saturday|sun|Friday')) AS m FROM prose_x)
SELECT seq, m AS mention, CASE m WHEN 'Monday' THEN 'monday' WHEN 'Tue' THEN 'tuesday' WHEN 'Weekdays' THEN 'monday,tuesday,wednesday,thursday,friday' WHEN 'daily' THEN 'monday,tuesday,wednesday,thursday,friday,saturday,sunday' WHEN 'Saturday' THEN 'saturday' WHEN 'sun' THEN 'sunday' ELSE 'friday' END AS days FROM d""", "prose_x"))
def h16_day_arrays(spark, sf_dir):
    x = view(spark, sf_dir, "prose_x").select("seq", F.explode(X.matches(F.col("text"), X.DAYS)).alias("m"))
    return x.select("seq", F.col("m.text").alias("mention"), F.array_join(X.day_array(F.col("m.text")), ",").alias("days"))


@query(oracle(r"""SELECT seq, trim(regexp_replace(regexp_replace(text, '\$\d+', ' '), '\s+', ' ', 'g')) AS title, CAST(regexp_extract(text, '\$(\d+)', 1) AS DOUBLE) AS price, CASE WHEN lower(text) LIKE '%beer%' THEN 'drink' ELSE 'unknown' END AS category
FROM prose_x WHERE regexp_matches(text, '\$\d') AND CAST(regexp_extract(text, '\$(\d+)', 1) AS DOUBLE) BETWEEN 3 AND 50""", "prose_x"))
def x7_priced_lines(spark, sf_dir):
    return X.priced_lines(view(spark, sf_dir, "prose_x"), ("seq",), "text")


@query(oracle("SELECT seq, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), 'monday|tue|weekdays|daily|saturday|sun|friday'))), ',') AS days FROM prose_x", "prose_x"))
def x8_distinct_days(spark, sf_dir):
    return view(spark, sf_dir, "prose_x").select("seq", F.array_join(X.distinct_mentions(F.col("text"), "monday|tue|weekdays|daily|saturday|sun|friday", 10), ",").alias("days"))


@query(oracle(r"""SELECT seq, CASE WHEN seq % 2 = 0 THEN '3035550' || lpad(CAST(seq % 1000 AS VARCHAR), 3, '0') ELSE '' END AS phones, 'info' || CAST(seq AS VARCHAR) || '@place.com' AS emails, CASE WHEN seq % 3 = 0 THEN 'spot.' || CAST(seq AS VARCHAR) END AS instagram FROM raw_x""", "raw_x"))
def x10_contacts(spark, sf_dir):
    n = F.col("seq").cast("string")
    text = F.concat(F.lit("Call "), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("(303) 555-0"), F.lpad((F.col("seq") % 1000).cast("string"), 3, "0"))).otherwise("us"), F.lit(" or Info"), n, F.lit("@Place.com, "), F.when(F.col("seq") % 3 == 0, F.concat(F.lit("https://instagram.com/Spot."), n)).otherwise(""))
    out = X.contacts(view(spark, sf_dir, "raw_x").select("seq", text.alias("text")), ("seq",))
    return out.select("seq", F.array_join("phones", ",").alias("phones"), F.array_join("emails", ",").alias("emails"), "instagram")


ISSUES = """i AS (SELECT seq, slug, 'warning' AS level, 'short title' AS message FROM raw_x WHERE length(raw_title) BETWEEN 1 AND 4
 UNION ALL SELECT seq, slug, 'warning', 'low confidence' FROM raw_x WHERE confidence_score < 0.5
 UNION ALL SELECT seq, slug, 'info', 'title repeats description' FROM raw_x WHERE lower(raw_title) = lower(raw_description)
 UNION ALL SELECT seq, slug, 'warning', 'odd price' FROM raw_x WHERE CAST(regexp_extract(raw_price, '(\\d+)', 1) AS INT) > 50
 UNION ALL SELECT seq, slug, 'warning', 'end before start' FROM raw_x WHERE raw_start IS NOT NULL AND hour(extracted_at) + 3 >= 24 AND NOT (hour(extracted_at) >= 20 AND (hour(extracted_at) + 3) % 24 < 7))"""


def issues(spark, sf_dir):
    x = deals(spark, sf_dir).join(view(spark, sf_dir, "raw_x").select("seq", F.array("raw_price").alias("prices")), "seq")
    return Q.issues_of(x.withColumnRenamed("restaurant_slug", "slug"), ("seq", "slug"), [*Q.content_issues(), *Q.time_issues(), *Q.anomaly_issues()])


@query(oracle(f"{ISSUES} SELECT * FROM i", "raw_x"))
def p15_p16_p17_issues(spark, sf_dir):
    return issues(spark, sf_dir)


@query(oracle(f"{ISSUES} SELECT (SELECT count(DISTINCT slug) FROM raw_x) AS subjects, count(DISTINCT slug) AS with_issues, count(*) FILTER (level = 'warning') AS n_warning, count(*) FILTER (level = 'info') AS n_info, count(*) AS n_issues, round(greatest(0.0, 100 - 10 * count(*) / (SELECT count(DISTINCT slug) FROM raw_x)), 4) AS score FROM i", "raw_x"))
def a18_quality_report(spark, sf_dir):
    return Q.report(issues(spark, sf_dir), view(spark, sf_dir, "raw_x").select("slug"), "slug")


@query(oracle("SELECT slug, round(CASE WHEN phone IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 0.35 ELSE 0 END + CASE WHEN cuisine IS NOT NULL THEN 0.25 ELSE 0 END, 6)::DOUBLE AS completeness FROM restaurant_x", "restaurant_x"))
def h31_completeness(spark, sf_dir):
    return view(spark, sf_dir, "restaurant_x").select("slug", Q.completeness({"phone": 0.4, "website": 0.35, "cuisine": 0.25}).alias("completeness"))


@query(oracle("SELECT count(*) AS n, round(avg(c), 6) AS average, count(*) FILTER (c >= 0.5) AS half FROM (SELECT (CASE WHEN phone IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 0.35 ELSE 0 END + CASE WHEN cuisine IS NOT NULL THEN 0.25 ELSE 0 END)::DOUBLE AS c FROM restaurant_x)", "restaurant_x"))
def a6_profile_completeness(spark, sf_dir):
    c = h31_completeness(spark, sf_dir)
    return c.agg(F.count("*").alias("n"), F.round(F.avg("completeness"), 6).alias("average"), F.count_if(F.col("completeness") >= 0.5).alias("half"))


@query(oracle("SELECT slug, CASE WHEN regexp_matches(website, 's[0-9]+[02468]\\.') THEN website END AS website FROM restaurant_x", "restaurant_x"))
def p8_invalid_to_null(spark, sf_dir):
    out, _ = Q.with_invalid_nulled(view(spark, sf_dir, "restaurant_x").select("slug", "website"), {"website": F.col("website").rlike(r"s[0-9]+[02468]\.")})
    return out


@query(oracle("SELECT slug, seq, r AS rank FROM (SELECT slug, seq, row_number() OVER (PARTITION BY slug ORDER BY s DESC, seq) AS r FROM (SELECT slug, seq, (CASE WHEN lower(substr(raw_day,1,3)) = 'wed' THEN 100 ELSE 0 END) + (CASE WHEN raw_description LIKE '%all day%' THEN 50 ELSE 0 END) + confidence_score * 20 AS s FROM raw_x WHERE confidence_score >= 0.25)) WHERE r <= 3", "raw_x"))
def w5_relevant_deals(spark, sf_dir):
    """Best three deals of each restaurant on a Wednesday."""
    c = F.col("confidence_score")
    score = F.when(T.day_name(F.col("raw_day")) == "wednesday", 100).otherwise(0) + F.when(F.col("raw_description").contains("all day"), 50).otherwise(0) + c * 20
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc(score), "seq"))
    return view(spark, sf_dir, "raw_x").filter(c >= 0.25).withColumn("rank", rank).filter("rank <= 3").select("slug", "seq", "rank")


@query(oracle("m AS (SELECT slug, max(CAST(extracted_at AS DATE)) AS d FROM raw_x GROUP BY slug) SELECT r.slug, r.seq FROM raw_x r JOIN m ON m.slug = r.slug AND m.d = CAST(r.extracted_at AS DATE)", "raw_x"))
def w8_s4_newest_snapshot(spark, sf_dir):
    from dealloom.sources.tables import newest

    x = view(spark, sf_dir, "raw_x").withColumn("snapshot_date", F.to_date("extracted_at"))
    return newest(x).select("slug", "seq")


@query(oracle(f"g AS (SELECT slug, {DAY.format('raw_day')} AS day, raw_start, raw_end, confidence_score, raw_title FROM raw_x) SELECT slug, day, raw_start AS start, raw_end AS \"end\", max(confidence_score) AS confidence, string_agg(DISTINCT raw_title, ';' ORDER BY raw_title) AS titles, count(*) AS n FROM g GROUP BY slug, day, raw_start, raw_end", "raw_x"))
def w14_schedule_groups(spark, sf_dir):
    x = view(spark, sf_dir, "raw_x").select("slug", T.day_name(F.col("raw_day")).alias("day"), F.col("raw_start").alias("start"), F.col("raw_end").alias("end"), "confidence_score", "raw_title")
    return x.groupBy("slug", "day", "start", "end").agg(F.max("confidence_score").alias("confidence"), F.array_join(F.array_sort(F.collect_set("raw_title")), ";").alias("titles"), F.count("*").alias("n"))


@query(oracle("SELECT slug, coalesce(nullif(string_agg(DISTINCT CASE WHEN raw_title NOT IN ('Happy Hour', '') THEN raw_title END, ';' ORDER BY CASE WHEN raw_title NOT IN ('Happy Hour', '') THEN raw_title END), ''), 'Special') AS offers FROM raw_x GROUP BY slug", "raw_x"))
def w15_offers(spark, sf_dir):
    title = F.when(~F.col("raw_title").isin("Happy Hour", ""), F.col("raw_title"))
    return view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(title)), ";"), F.lit("")), F.lit("Special")).alias("offers"))


# Greedy removal in SQL: each restaurant's rows in their order, folded into the list of those that stay.
CLASH = "(x[1].mask & k.mask) = x[1].mask AND (x[1].s IS NULL OR (k.s IS NOT NULL AND (k.s = x[1].s AND k.e = x[1].e OR least(k.e, x[1].e) - greatest(k.s, x[1].s) >= 0.5 * least(k.e - k.s, x[1].e - x[1].s))))"
GREEDY = f"""b AS (SELECT slug, mask, s, e, max(c) AS c, arg_min(seq, (-c, seq)) AS seq FROM d GROUP BY slug, mask, s, e),
l AS (SELECT slug, list([{{'mask': mask, 's': s, 'e': e, 'seq': seq}}] ORDER BY c DESC, (CASE WHEN s IS NULL THEN 0 ELSE 1 END) + (CASE WHEN mask > 0 THEN 1 ELSE 0 END) DESC, seq) AS l FROM b GROUP BY slug),
r AS (SELECT list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda k: {CLASH})) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM l)
SELECT unnest(kept).seq AS seq FROM r"""
MINUTE = "(CAST(regexp_extract({0}, '^(\\d+)', 1) AS INT) % 12 + CASE WHEN {0} LIKE '%pm' THEN 12 ELSE 0 END) * 60"
NUMBER = "CASE lower(substr(raw_day, 1, 3)) WHEN 'mon' THEN 0 WHEN 'tue' THEN 1 WHEN 'wed' THEN 2 WHEN 'thu' THEN 3 WHEN 'fri' THEN 4 WHEN 'sat' THEN 5 ELSE 6 END"
DATED = f"t AS (SELECT seq, slug, confidence_score AS c, {NUMBER} AS n, {MINUTE.format('raw_start')} AS s, {MINUTE.format('raw_end')} AS e0 FROM raw_x), d AS (SELECT seq, slug, c, {{mask}} AS mask, s, CASE WHEN e0 <= s THEN e0 + 1440 ELSE e0 END AS e FROM t), {GREEDY}"


@query(oracle(DATED.replace("{mask}", "1 << n"), "raw_x"), name="w7_without_overlaps")
def w7(spark, sf_dir):
    return without_overlaps(deals(spark, sf_dir))


@query(oracle(DATED.replace("{mask}", "(1 << n) | CASE WHEN seq % 3 > 0 THEN 1 << ((n + 1) % 7) ELSE 0 END | CASE WHEN seq % 3 = 2 THEN 1 << ((n + 3) % 7) ELSE 0 END"), "raw_x"))
def w7_day_sets(spark, sf_dir):
    """The same with sets of up to three days."""
    day = F.get("days", F.lit(0))
    week = F.array(*map(F.lit, T.WEEK))
    later = lambda k: F.element_at(week, (F.pmod(F.array_position(week, day) - 1 + k, F.lit(7)) + 1).cast("int"))
    sets = F.when(F.col("seq") % 3 == 0, F.array(day)).when(F.col("seq") % 3 == 1, F.array(day, later(1))).otherwise(F.array(day, later(1), later(3)))
    return without_overlaps(deals(spark, sf_dir).withColumn("days", sets))


@query(oracle("SELECT slug, min(source) AS source FROM (SELECT slug, 1 AS source FROM restaurant_x UNION ALL SELECT slug, 2 FROM overlay_x) GROUP BY slug", "restaurant_x", "overlay_x"))
def u2_ordered_union(spark, sf_dir):
    a = view(spark, sf_dir, "restaurant_x").select("slug", F.lit(1).alias("source"))
    return a.unionByName(view(spark, sf_dir, "overlay_x").select("slug", F.lit(2).alias("source"))).groupBy("slug").agg(F.min("source").alias("source"))


@query(oracle("SELECT district, arg_max(name, s_suppkey) AS name, count(*) AS n FROM restaurant_x GROUP BY district", "restaurant_x"))
def u3_last_wins(spark, sf_dir):
    return view(spark, sf_dir, "restaurant_x").groupBy("district").agg(F.max_by("name", "s_suppkey").alias("name"), F.count("*").alias("n"))


@query(oracle("SELECT seq, raw_title FROM raw_x WHERE seq % 2 = 0 UNION ALL SELECT seq, raw_title FROM raw_x WHERE seq % 3 = 0", "raw_x"))
def u1_bag_union(spark, sf_dir):
    x = view(spark, sf_dir, "raw_x").select("seq", "raw_title")
    return x.filter("seq % 2 = 0").unionByName(x.filter("seq % 3 = 0"))


@query(oracle("SELECT slug, name FROM restaurant_x WHERE lower(district) IN ('france', 'germany', 'india', 'china', 'canada') AND website IS NOT NULL", "restaurant_x"))
def p21_p22_subset(spark, sf_dir):
    return view(spark, sf_dir, "restaurant_x").filter(F.lower("district").isin("france", "germany", "india", "china", "canada") & F.col("website").isNotNull()).select("slug", "name")


@query(oracle("d AS (SELECT slug, count(*) AS n FROM raw_x GROUP BY slug), c AS (SELECT slug, n, CASE WHEN n > 30 THEN 'many' WHEN n > 5 THEN 'some' ELSE 'few' END AS class FROM d) SELECT slug, n, class, count(*) OVER w AS n_restaurants, round(avg(n) OVER w, 4) AS average FROM c WINDOW w AS (PARTITION BY class)", "raw_x"))
def a31_classes(spark, sf_dir):
    """Restaurants by their number of deals, beside the totals of the class."""
    d = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.count("*").alias("n"))
    d = d.withColumn("class", F.when(F.col("n") > 30, "many").when(F.col("n") > 5, "some").otherwise("few"))
    return d.join(d.groupBy("class").agg(F.count("*").alias("n_restaurants"), F.round(F.avg("n"), 4).alias("average")), "class").select("slug", "n", "class", "n_restaurants", "average")


@query(oracle("SELECT count(*) AS n, round(count(*) * 0.049, 4)::DOUBLE AS cost FROM restaurant_x", "restaurant_x"))
def a34_cost(spark, sf_dir):
    return view(spark, sf_dir, "restaurant_x").agg(F.count("*").alias("n"), F.round(F.count("*") * 0.049, 4).alias("cost"))


@query(oracle("SELECT event_type AS status, count(*) AS n, round(avg(value), 4) AS average FROM raw_x JOIN (SELECT event_id, event_type FROM events) e ON e.event_id = seq GROUP BY event_type", "raw_x"))
def a35_run_results(spark, sf_dir):
    return view(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("average"))


VIEWS["fallback_x"] = """SELECT 'user-' || CAST(s_suppkey AS STRING) AS slug, 'House special' AS raw_title, CASE WHEN s_suppkey % 2 = 0 THEN '$' || CAST(5 + s_suppkey % 9 AS STRING) END AS raw_price FROM {supplier}"""


@query(oracle("""g AS (SELECT DISTINCT slug FROM raw_x WHERE confidence_score >= 0.6 AND (raw_start IS NOT NULL OR (raw_price <> '' AND confidence_score >= 0.9)))
SELECT slug, seq, raw_title, raw_price, confidence_score FROM raw_x WHERE slug IN (SELECT slug FROM g)
UNION ALL SELECT slug, NULL, raw_title, raw_price, 0.3::DOUBLE FROM fallback_x WHERE slug NOT IN (SELECT slug FROM g)""", "raw_x", "fallback_x"))
def j11_fallback(spark, sf_dir):
    """Restaurants without a good deal get their static ones, with a low confidence; others keep their own."""
    x = view(spark, sf_dir, "raw_x").select("slug", "seq", "raw_title", "raw_price", "confidence_score", "raw_start")
    sure = F.col("confidence_score")
    good = x.filter((sure >= 0.6) & (F.col("raw_start").isNotNull() | ((F.col("raw_price") != "") & (sure >= 0.9)))).select("slug").distinct()
    own = x.drop("raw_start").join(good, "slug", "left_semi")
    other = view(spark, sf_dir, "fallback_x").join(good, "slug", "left_anti")
    return own.unionByName(other.select("slug", F.lit(None).cast("long").alias("seq"), "raw_title", "raw_price", F.lit(0.3).alias("confidence_score")))


@query(oracle("o AS (SELECT slug, 'http://www.s' || substr(slug, 6) || '.example.com/menu/' AS old, website AS new FROM overlay_x WHERE website IS NOT NULL) SELECT x.slug, coalesce(o.new, x.website) AS website FROM restaurant_x x LEFT JOIN o ON o.old = x.website", "restaurant_x", "overlay_x"))
def j7_redirects(spark, sf_dir):
    o = view(spark, sf_dir, "overlay_x").filter("website IS NOT NULL").select(F.concat(F.lit("http://www.s"), F.substring("slug", 6, 30), F.lit(".example.com/menu/")).alias("website"), F.col("website").alias("new"))
    return view(spark, sf_dir, "restaurant_x").select("slug", "website").join(o, "website", "left").select("slug", F.coalesce("new", "website").alias("website"))


@query(oracle("SELECT x.slug, coalesce(o.phone, '(303) 555-0199') AS phone, coalesce(rating_src, 0.0) AS rating FROM restaurant_x x LEFT JOIN overlay_x o ON o.slug = x.slug", "restaurant_x", "overlay_x"))
def j8_defaults(spark, sf_dir):
    o = view(spark, sf_dir, "overlay_x").select("slug", F.col("phone"), F.col("rating_src").alias("rating"))
    return view(spark, sf_dir, "restaurant_x").select("slug").join(o, "slug", "left").select("slug", F.coalesce("phone", F.lit("(303) 555-0199")).alias("phone"), F.coalesce("rating", F.lit(0.0)).alias("rating"))


@query(oracle(r"k AS (SELECT s_suppkey, slug, CASE WHEN s_suppkey % 2 = 0 THEN '\$(\d+)' ELSE '([a-z]+) plate' END AS pattern FROM restaurant_x) SELECT r.seq, regexp_extract(raw_price, CASE WHEN CAST(substr(r.slug, 6) AS INT) % 2 = 0 THEN '\$(\d+)' ELSE '([a-z]+) plate' END, 1) AS found FROM raw_x r JOIN k ON k.slug = r.slug", "raw_x", "restaurant_x"))
def j20_rules_on_text(spark, sf_dir):
    """Each restaurant's own pattern on its own texts: the pattern is a column."""
    even = F.col("s_suppkey") % 2 == 0
    rules = view(spark, sf_dir, "restaurant_x").select("slug", F.when(even, r"\$(\d+)").otherwise("([a-z]+) plate").alias("pattern"))
    x = view(spark, sf_dir, "raw_x").join(rules, "slug")
    return x.select("seq", F.coalesce(F.get(F.regexp_extract_all("raw_price", F.col("pattern"), F.lit(1)), F.lit(0)), F.lit("")).alias("found"))


@query(oracle("f AS (SELECT slug, CAST(regexp_extract(raw_price, '(\\d+)', 1) AS DOUBLE) AS p, NOT raw_price LIKE '%oyster%' AS drink FROM raw_x) SELECT slug, count(*) FILTER (drink) AS n_drinks, count(*) FILTER (NOT drink) AS n_food, round(coalesce(avg(CASE WHEN drink THEN p END), 8.0), 4) AS drink_price, round(coalesce(avg(CASE WHEN NOT drink THEN p END), 12.0), 4) AS food_price FROM f GROUP BY slug", "raw_x"))
def a9_a25_prices(spark, sf_dir):
    """Food and drink of each restaurant, with an estimate where there is no price."""
    p, drink = F.regexp_extract("raw_price", r"(\d+)", 1).cast("double"), ~F.col("raw_price").contains("oyster")
    mean = lambda c, v: F.round(F.coalesce(F.avg(F.when(c, p)), F.lit(v)), 4)
    return view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.count_if(drink).alias("n_drinks"), F.count_if(~drink).alias("n_food"), mean(drink, 8.0).alias("drink_price"), mean(~drink, 12.0).alias("food_price"))

"""Pricing, overlays, reports, status."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dealloom.functions import times as T
from dealloom.operators import overlay as O  # noqa: E741
from dealloom.operators import pricing as M
from dealloom.operators import status as S
from dealloom.operators.pages import normal_url
from dealloom.operators.ranks import ranked
from dealloom.plans.registry import query
from dealloom.plans.views import oracle, view

NORMAL = r"CASE WHEN regexp_matches(trim({0}), '(?i)^https?://[^/?#]+') THEN 'https://' || lower(regexp_extract(trim({0}), '(?i)^https?://([^/?#]+)', 1)) || regexp_replace(regexp_extract(trim({0}), '(?i)^https?://[^/?#]+([^#]*)', 1), '/+$', '') END"
ITEMS = r"""sec AS (SELECT *, last_value(CASE WHEN NOT regexp_matches(line, '\$\d') THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM menu_x),
items AS (SELECT page_id, pos, slug, menu_type, section, CAST(regexp_extract(line, '\$(\d+)', 1) AS DOUBLE) AS price, trim(regexp_replace(line, '\s*\$\d+.*$', '')) AS item FROM sec WHERE regexp_matches(line, '\$\d') AND CAST(regexp_extract(line, '\$(\d+)', 1) AS DOUBLE) BETWEEN 3 AND 200)"""
PAGES = f"""{ITEMS}, st AS (SELECT page_id, slug, menu_type, count(*) AS n_items, avg(price) AS average, min(price) AS lowest, max(price) AS highest FROM items GROUP BY ALL),
cuts AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in M.BANDS.items())}) v(menu_type, c1, c2, c3)),
base AS (SELECT st.*, c3, CASE WHEN average <= c1 THEN 1 WHEN average <= c2 THEN 2 WHEN average <= c3 THEN 3 ELSE 4 END AS b FROM st JOIN cuts USING (menu_type)),
banded AS (SELECT *, repeat('$', CASE WHEN b < 3 AND highest > c3 THEN b + 1 WHEN highest > 60 AND average > 35 THEN 4 ELSE b END) AS band FROM base)"""


def items(spark, sf_dir):
    return M.price_items(M.with_section(view(spark, sf_dir, "menu_x")))


@query(oracle(f"{ITEMS} SELECT page_id, pos, section, item, price FROM items", "menu_x"))
def x6_w11_price_items(spark, sf_dir):
    return items(spark, sf_dir).select("page_id", "pos", "section", "item", "price")


@query(oracle(f"{PAGES} SELECT page_id, n_items, round(average, 4) AS average, lowest, highest, CASE WHEN average < 15 THEN '$' WHEN average < 25 THEN '$$' WHEN average < 40 THEN '$$$' ELSE '$$$$' END AS page_band, band FROM banded", "menu_x"))
def a32_h29_page_bands(spark, sf_dir):
    out = M.page_statistics(items(spark, sf_dir), "page_id", "slug", "menu_type").withColumn("band", M.band("menu_type", "average", "highest", "n_items"))
    return out.select("page_id", "n_items", F.round("average", 4).alias("average"), "lowest", "highest", "page_band", "band")


@query(oracle(f"{PAGES} SELECT slug, coalesce(max(CASE WHEN menu_type = 'dinner' THEN band END), max(band)) AS overall_band, round(avg(average), 4) AS average, min(lowest) AS lowest, max(highest) AS highest, CAST(sum(n_items) AS BIGINT) AS n_items, string_agg(DISTINCT menu_type, ',' ORDER BY menu_type) AS menu_types FROM banded GROUP BY slug", "menu_x"))
def x14_a8_pricing_summary(spark, sf_dir):
    out = M.restaurant_summary(M.page_statistics(items(spark, sf_dir), "page_id", "slug", "menu_type"))
    return out.withColumn("average", F.round("average", 4))


@query(oracle(f"{PAGES}, n AS (SELECT band, count(*) AS n FROM banded GROUP BY band) SELECT band, n, round(100.0 * n / sum(n) OVER (), 4) AS percent FROM n", "menu_x"))
def a7_band_shares(spark, sf_dir):
    """Bands are four, so the window over all of them is small."""
    out = M.page_statistics(items(spark, sf_dir), "page_id", "slug", "menu_type").groupBy(M.band("menu_type", "average", "highest", "n_items").alias("band")).agg(F.count("*").alias("n"))
    return out.withColumn("percent", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 4))


@query(oracle(f"{ITEMS} SELECT slug, item, price, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY price, item, page_id, pos) AS r FROM items) WHERE r <= 3", "menu_x"))
def w4_cheapest_items(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("slug").orderBy("price", "item", "page_id", "pos"))
    return items(spark, sf_dir).withColumn("rank", rank).filter("rank <= 3").select("slug", "item", "price", "rank")


@query(oracle(f"{ITEMS} SELECT page_id, string_agg(CASE WHEN price <= 50 THEN '$' || CAST(CAST(price AS INT) AS VARCHAR) END, ',' ORDER BY pos) AS prices FROM items GROUP BY page_id", "menu_x"))
def p9_prices_in_range(spark, sf_dir):
    out = items(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("price").cast("int").cast("string").alias("p")))).alias("prices"))
    out = M.deals_in_range(out.withColumn("prices", F.transform("prices", lambda x: x["p"])))
    return out.select("page_id", F.nullif(F.array_join("prices", ","), F.lit("")).alias("prices"))


@query(r"SELECT event_id, coalesce(try_cast(regexp_replace(CASE WHEN event_id % 3 = 0 THEN '$' || CAST(event_id AS VARCHAR) || ',000' WHEN event_id % 3 = 1 THEN 'market' ELSE CAST(event_id AS VARCHAR) END, '[$,]', '', 'g') AS DOUBLE), 0.0) AS amount FROM events")
def p10_amounts(spark, sf_dir):
    n = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("$"), n, F.lit(",000"))).when(F.col("event_id") % 3 == 1, "market").otherwise(n)
    return view(spark, sf_dir, "events").select("event_id", M.amount(text).alias("amount"))


# Overlays.
PHONE = "CASE WHEN phone IS NULL THEN NULL ELSE '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) END"


@query(oracle(f"p AS (SELECT *, CASE WHEN length(regexp_replace(phone, '\\D', '', 'g')) = 11 THEN substr(regexp_replace(phone, '\\D', '', 'g'), 2) ELSE regexp_replace(phone, '\\D', '', 'g') END AS d FROM restaurant_x) SELECT slug, {PHONE} AS phone, {NORMAL.format('website')} AS website FROM p", "restaurant_x"))
def p3_h41_contacts(spark, sf_dir):
    return view(spark, sf_dir, "restaurant_x").select("slug", O.us_phone(F.col("phone")).alias("phone"), normal_url(F.col("website")).alias("website"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN lower(e) END AS email, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'cust' || CAST(c_custkey AS VARCHAR) END AS handle FROM (SELECT c_custkey, 'User' || CAST(c_custkey AS VARCHAR) || '@Mail.org' AS e FROM customer)")
def p4_p5_email_and_handle(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    mail = F.concat(F.lit("User"), k, F.when(F.col("c_custkey") % 3 == 0, "@example.com").otherwise("@Mail.org"))
    social = F.when(F.col("c_custkey") % 5 == 0, "a b").when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://social.net/Cust"), k, F.lit("/?x=1"))).otherwise(F.concat(F.lit("@cust"), k))
    return view(spark, sf_dir, "customer").select("c_custkey", O.email(mail).alias("email"), O.handle(social).alias("handle"))


@query(oracle("SELECT r.slug, count(*) AS n_deals, coalesce(max(name), 'Unknown') AS name, coalesce(max(district), 'Unknown') AS district FROM raw_x r LEFT JOIN restaurant_x x ON x.slug = r.slug AND x.s_suppkey % 3 <> 0 GROUP BY r.slug", "raw_x", "restaurant_x"))
def j1_deals_with_restaurants(spark, sf_dir):
    n = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.count("*").alias("n_deals"))
    return O.looked_up(n, view(spark, sf_dir, "restaurant_x").filter("s_suppkey % 3 <> 0"), "slug", {"name": "Unknown", "district": "Unknown"})


@query(oracle("SELECT r.slug, count(*) AS n_deals, max(name) AS name FROM raw_x r JOIN restaurant_x x ON x.slug = r.slug AND x.s_suppkey % 3 <> 0 GROUP BY r.slug", "raw_x", "restaurant_x"))
def j2_matched_only(spark, sf_dir):
    n = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.count("*").alias("n_deals"))
    return n.join(view(spark, sf_dir, "restaurant_x").filter("s_suppkey % 3 <> 0").select("slug", "name"), "slug")


@query(oracle("SELECT DISTINCT slug FROM raw_x WHERE slug NOT IN (SELECT slug FROM restaurant_x WHERE s_suppkey % 3 <> 0)", "raw_x", "restaurant_x"))
def j2_u5_unmatched(spark, sf_dir):
    return view(spark, sf_dir, "raw_x").select("slug").distinct().join(view(spark, sf_dir, "restaurant_x").filter("s_suppkey % 3 <> 0"), "slug", "left_anti")


@query(oracle("SELECT b.slug, coalesce(o.phone, b.phone) AS phone, coalesce(o.website, b.website) AS website FROM restaurant_x b LEFT JOIN overlay_x o ON o.slug = b.slug", "restaurant_x", "overlay_x"))
def j4_j5_overlay(spark, sf_dir):
    return O.patched(view(spark, sf_dir, "restaurant_x"), view(spark, sf_dir, "overlay_x"), "slug", ("phone", "website")).select("slug", "phone", "website")


@query(oracle("SELECT b.slug, coalesce(b.phone, o.phone) AS phone, coalesce(b.website, o.website) AS website FROM restaurant_x b LEFT JOIN overlay_x o ON o.slug = b.slug", "restaurant_x", "overlay_x"))
def j6_fill_missing(spark, sf_dir):
    return O.patched(view(spark, sf_dir, "restaurant_x"), view(spark, sf_dir, "overlay_x"), "slug", ("phone", "website"), only_missing=True).select("slug", "phone", "website")


@query(oracle("SELECT r.seq, r.raw_title, CASE WHEN regexp_matches(raw_title, 'Night') THEN 'night' WHEN regexp_matches(raw_title, 'Hour|Brunch') THEN 'day' END AS new_title FROM raw_x r", "raw_x"))
def j9_first_rule(spark, sf_dir):
    rules = spark.createDataFrame([(1, "Night", "night"), (2, "Hour|Brunch", "day"), (3, "Late", "late")], "ord int, pattern string, new_title string")
    return O.transformed(view(spark, sf_dir, "raw_x").select("seq", "raw_title"), rules, "raw_title")


@query(oracle("""t AS (SELECT 0 AS tier, slug, seq FROM raw_x WHERE seq % 97 = 0 UNION ALL SELECT 1, slug, seq FROM raw_x WHERE seq % 31 = 0 UNION ALL SELECT 2, slug, seq FROM raw_x WHERE seq % 7 = 0),
b AS (SELECT slug, min(tier) AS tier FROM t GROUP BY slug) SELECT slug, tier, count(*) AS n FROM t JOIN b USING (slug, tier) GROUP BY ALL""", "raw_x"))
def j15_deal_tiers(spark, sf_dir):
    x = view(spark, sf_dir, "raw_x").select("slug", "seq")
    return O.first_tier([x.filter(F.col("seq") % k == 0) for k in (97, 31, 7)], "slug").groupBy("slug", "tier").agg(F.count("*").alias("n"))


@query(oracle("SELECT x.slug, CASE WHEN x.website IS NULL THEN 'website' ELSE 'overlay' END AS missing FROM restaurant_x x LEFT JOIN overlay_x o ON o.slug = x.slug WHERE x.website IS NULL OR o.slug IS NULL", "restaurant_x", "overlay_x"))
def j17_missing(spark, sf_dir):
    x = view(spark, sf_dir, "restaurant_x").join(view(spark, sf_dir, "overlay_x").select("slug", F.lit(1).alias("has")), "slug", "left")
    return x.filter("website IS NULL OR has IS NULL").select("slug", F.when(F.col("website").isNull(), "website").otherwise("overlay").alias("missing"))


FIELDS = ("phone", "website", "cuisine", "district")


@query(oracle(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n, round(100.0 * count({c}) / count(*), 2) AS percent, CASE WHEN round(100.0 * count({c}) / count(*), 2) >= 80 THEN 'good' WHEN round(100.0 * count({c}) / count(*), 2) >= 60 THEN 'fair' ELSE 'poor' END AS status FROM restaurant_x" for c in FIELDS), "restaurant_x"))
def a21_coverage(spark, sf_dir):
    return O.coverage(view(spark, sf_dir, "restaurant_x"), FIELDS)


@query(oracle(f"""j AS (SELECT {NORMAL.format('x.website')} AS a, {NORMAL.format('o.website')} AS b FROM restaurant_x x LEFT JOIN overlay_x o ON o.slug = x.slug)
SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'neither' WHEN a IS NULL THEN 'only_second' WHEN b IS NULL THEN 'only_first' WHEN a = b THEN 'same' WHEN starts_with(a, b) OR starts_with(b, a) THEN 'more_specific' ELSE 'different' END AS class, count(*) AS n FROM j GROUP BY ALL""", "restaurant_x", "overlay_x"))
def a22_url_comparison(spark, sf_dir):
    x = view(spark, sf_dir, "restaurant_x").select("slug", normal_url(F.col("website")).alias("a"))
    y = view(spark, sf_dir, "overlay_x").select("slug", normal_url(F.col("website")).alias("b"))
    a, b = F.col("a"), F.col("b")
    kind = F.when(a.isNull() & b.isNull(), "neither").when(a.isNull(), "only_second").when(b.isNull(), "only_first").when(a == b, "same").when(a.startswith(b) | b.startswith(a), "more_specific").otherwise("different")
    return x.join(y, "slug", "left").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(oracle("SELECT metro, string_agg(DISTINCT district, ',' ORDER BY district) AS districts, count(*) AS n FROM restaurant_x GROUP BY metro", "restaurant_x"))
def a23_a24_districts(spark, sf_dir):
    return view(spark, sf_dir, "restaurant_x").groupBy("metro").agg(F.array_join(F.sort_array(F.collect_set("district")), ",").alias("districts"), F.count("*").alias("n"))


@query(oracle("SELECT cuisine, district, count(*) AS n FROM restaurant_x GROUP BY ROLLUP (district, cuisine)", "restaurant_x"))
def a16_cuisine_rollup(spark, sf_dir):
    return view(spark, sf_dir, "restaurant_x").rollup("district", "cuisine").agg(F.count("*").alias("n"))


# Reports on deals.
@query(oracle("SELECT slug, count(*) AS n_deals, round(avg(confidence_score), 6) AS confidence FROM raw_x GROUP BY slug ORDER BY n_deals DESC, slug LIMIT 10", "raw_x"))
def a1_l1_top_restaurants(spark, sf_dir):
    out = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.count("*").alias("n_deals"), F.round(F.avg("confidence_score"), 6).alias("confidence"))
    return out.orderBy(F.desc("n_deals"), "slug").limit(10)


@query(oracle("SELECT count(*) AS n, round(avg(confidence_score), 6) AS mean, min(confidence_score) AS least, max(confidence_score) AS most, count(*) FILTER (confidence_score >= 0.8) AS sure, count(*) FILTER (confidence_score < 0.6) AS unsure FROM raw_x", "raw_x"))
def a2_confidence(spark, sf_dir):
    c = F.col("confidence_score")
    return view(spark, sf_dir, "raw_x").agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(c >= 0.8).alias("sure"), F.count_if(c < 0.6).alias("unsure"))


@query(oracle("SELECT round(confidence_score, 1) AS bin, count(*) AS n FROM raw_x GROUP BY ALL", "raw_x"))
def a2_histogram(spark, sf_dir):
    return view(spark, sf_dir, "raw_x").groupBy(F.round("confidence_score", 1).alias("bin")).agg(F.count("*").alias("n"))


@query(oracle("SELECT extraction_method, count(*) AS n, round(avg(confidence_score), 6) AS confidence FROM raw_x GROUP BY extraction_method", "raw_x"))
def a3_methods(spark, sf_dir):
    return view(spark, sf_dir, "raw_x").groupBy("extraction_method").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 6).alias("confidence"))


@query(oracle("SELECT count(DISTINCT r.slug) AS covered, (SELECT count(*) FROM restaurant_x) AS total FROM raw_x r JOIN restaurant_x x ON x.slug = r.slug", "raw_x", "restaurant_x"))
def a4_coverage(spark, sf_dir):
    x = view(spark, sf_dir, "restaurant_x").select("slug")
    seen = view(spark, sf_dir, "raw_x").select("slug").distinct().withColumn("seen", F.lit(1))
    return x.join(seen, "slug", "left").agg(F.count("seen").alias("covered"), F.count("*").alias("total"))


@query("SELECT regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY ALL ORDER BY n DESC, host LIMIT 5")
def a5_pages_per_host(spark, sf_dir):
    from dealloom.operators.pages import host

    return view(spark, sf_dir, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(5)


@query(oracle("""j AS (SELECT x.district, x.slug, r.seq, r.confidence_score, r.value FROM restaurant_x x LEFT JOIN raw_x r ON r.slug = x.slug)
SELECT district, count(DISTINCT slug) AS n_restaurants, count(seq) AS n_deals, round(100.0 * count(DISTINCT CASE WHEN seq IS NOT NULL THEN slug END) / count(DISTINCT slug), 4) AS coverage, round(avg(CASE WHEN value > 0 THEN value END), 4) AS average, min(CASE WHEN value > 0 THEN value END) AS lowest, max(value) AS highest FROM j GROUP BY district""", "raw_x", "restaurant_x"))
def x18_a15_district_insights(spark, sf_dir):
    """Deals are summed by restaurant before the join, so a restaurant with many deals is one row in it."""
    v = F.when(F.col("value") > 0, F.col("value"))
    by = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.count(v).alias("k"), F.min(v).alias("lo"), F.max("value").alias("hi"))
    x = view(spark, sf_dir, "restaurant_x").select("slug", "district").join(by, "slug", "left")
    return x.groupBy("district").agg(
        F.count("*").alias("n_restaurants"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_deals"), F.round(F.count("n") * 100 / F.count("*"), 4).alias("coverage"),
        F.round(F.try_divide(F.sum("s"), F.sum("k")), 4).alias("average"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"),
    )


@query(oracle("""t AS (SELECT 'times' AS kind, raw_start || '-' || raw_end AS item, count(*) AS n FROM raw_x WHERE raw_start IS NOT NULL GROUP BY ALL UNION ALL SELECT 'days', raw_day, count(*) FROM raw_x GROUP BY ALL)
SELECT kind, item, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, item) AS r FROM t) WHERE r <= 5""", "raw_x"))
def a16_common_times_and_days(spark, sf_dir):
    x = view(spark, sf_dir, "raw_x")
    both = x.select(F.explode(F.array(F.struct(F.lit("times").alias("kind"), F.concat(F.col("raw_start"), F.lit("-"), F.col("raw_end")).alias("item")), F.struct(F.lit("days").alias("kind"), F.col("raw_day").alias("item")))).alias("s")).select("s.*").filter("item IS NOT NULL")
    n = both.groupBy("kind", "item").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "item"))).filter("r <= 5").drop("r")


@query(oracle("k AS (SELECT slug, count(*) FILTER (raw_price LIKE '%oyster%') AS food, count(*) FILTER (NOT raw_price LIKE '%oyster%') AS drink FROM raw_x GROUP BY slug) SELECT count(*) FILTER (food > drink) AS food_focused, count(*) FILTER (drink > food) AS drink_focused, count(*) FILTER (food = drink) AS balanced FROM k", "raw_x"))
def a17_focus(spark, sf_dir):
    food = F.col("raw_price").contains("oyster")
    k = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.count_if(food).alias("food"), F.count_if(~food).alias("drink"))
    return k.agg(F.count_if(F.col("food") > F.col("drink")).alias("food_focused"), F.count_if(F.col("drink") > F.col("food")).alias("drink_focused"), F.count_if(F.col("food") == F.col("drink")).alias("balanced"))


ISSUES = {"low_confidence": "confidence_score < 0.5", "no_title": "raw_title = ''", "no_time": "raw_start IS NULL", "dear": "CAST(regexp_extract(raw_price, '(\\\\d+)', 1) AS INT) > 45"}


@query(oracle(" UNION ALL ".join(f"SELECT '{k}' AS issue, count(*) AS n, count(DISTINCT slug) AS subjects FROM raw_x WHERE {v.replace(chr(92) * 2, chr(92))} HAVING count(*) > 0" for k, v in ISSUES.items()), "raw_x"))
def a18_p12_p17_issues(spark, sf_dir):
    found = F.filter(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in ISSUES.items()]), lambda x: x.isNotNull())
    return view(spark, sf_dir, "raw_x").select("slug", F.explode(found).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"), F.countDistinct("slug").alias("subjects"))


@query(oracle("SELECT slug, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, slug) AS rank FROM raw_x GROUP BY slug", "raw_x"))
def w1_ranks(spark, sf_dir):
    """The rank of all restaurants by ranges of their sums: no task meets all of them."""
    out = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.count("*").alias("n"))
    return ranked(out, [F.desc("n"), F.col("slug").asc()])


@query(oracle("r AS (SELECT raw_title, lower(raw_title) AS slugged, seq FROM raw_x) SELECT seq, trim(regexp_replace(regexp_replace(slugged, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM r", "raw_x"))
def h40_slugs(spark, sf_dir):
    dashed = F.regexp_replace(F.lower("raw_title"), "[^a-z0-9]+", "-")
    return view(spark, sf_dir, "raw_x").select("seq", F.regexp_replace(dashed, "^-+|-+$", "").alias("slug"))


# Status at a clock.
CLOCK = "2024-01-17 16:20:00"  # a Wednesday
MIN = "(CAST(regexp_extract({0}, '^(\\d+)', 1) AS INT) % 12 + CASE WHEN {0} LIKE '%pm' THEN 12 ELSE 0 END) * 60"
SLOTS = f"""s0 AS (SELECT slug, CASE lower(substr(raw_day,1,3)) WHEN 'mon' THEN 0 WHEN 'tue' THEN 1 WHEN 'wed' THEN 2 WHEN 'thu' THEN 3 WHEN 'fri' THEN 4 WHEN 'sat' THEN 5 ELSE 6 END AS day, {MIN.format('raw_start')} AS s, {MIN.format('raw_end')} AS e0 FROM raw_x WHERE raw_start IS NOT NULL),
slots AS (SELECT slug, day, s, CASE WHEN e0 <= s THEN e0 + 1440 ELSE e0 END AS e FROM s0),
ago AS (SELECT *, ((2 - day + 7) % 7) * 1440 + 980 - s AS ago FROM slots),
st AS (SELECT slug, bool_or(ago BETWEEN 0 AND e - s) AS on_, min(CASE WHEN (10080 - ago) % 10080 > 0 THEN (10080 - ago) % 10080 END) AS wait FROM ago GROUP BY slug),
status AS (SELECT slug, CASE WHEN on_ THEN 'active' WHEN wait < 180 THEN 'upcoming' ELSE 'closed' END AS status, wait FROM st)"""


def slots(spark, sf_dir):
    x = view(spark, sf_dir, "raw_x")
    return S.slots(x.select("slug", T.day_name(F.col("raw_day")).alias("day"), F.col("raw_start").alias("start"), F.col("raw_end").alias("end")))


@query(oracle(f"{SLOTS} SELECT slug, status, CASE WHEN status = 'upcoming' THEN wait END AS minutes FROM status", "raw_x"))
def h35_t4_live_status(spark, sf_dir):
    return S.live_status(slots(spark, sf_dir), F.lit(CLOCK).cast("timestamp"))


@query(oracle(f"{SLOTS} SELECT status, count(*) AS n FROM status GROUP BY status", "raw_x"))
def a33_status_counts(spark, sf_dir):
    return S.live_status(slots(spark, sf_dir), F.lit(CLOCK).cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"))


@query(oracle(f"{SLOTS}, w AS (SELECT slug, day, s, (day * 1440 + s - (2 * 1440 + 980) + 10080) % 10080 AS wait FROM slots) SELECT slug, min(wait) AS wait, arg_min(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][day + 1] || ' ' || lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0'), wait) AS label FROM w GROUP BY slug", "raw_x"))
def w10_next_opening(spark, sf_dir):
    return S.next_opening(slots(spark, sf_dir), F.lit(CLOCK).cast("timestamp"))


@query(oracle(f"u AS (SELECT slug, max(extracted_at) AS t FROM raw_x GROUP BY slug) SELECT slug FROM u WHERE t <= TIMESTAMP '{CLOCK}' + INTERVAL 12 DAY", "raw_x"))
def t5_stale(spark, sf_dir):
    u = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.max(F.col("extracted_at").cast("timestamp")).alias("t"))
    return S.stale(u, F.lit("2024-01-30 16:20:00").cast("timestamp"), "t", 1).select("slug")


@query(oracle("u AS (SELECT x.slug, max(r.extracted_at) AS t FROM restaurant_x x LEFT JOIN raw_x r ON r.slug = x.slug GROUP BY x.slug) SELECT count(*) AS n, count(t) AS n_updated, count(*) FILTER (t > TIMESTAMP '2024-01-28 16:20:00') AS n_fresh, round(count(*) FILTER (t > TIMESTAMP '2024-01-28 16:20:00') / count(*), 4) AS fresh_share FROM u", "raw_x", "restaurant_x"))
def a20_freshness(spark, sf_dir):
    last = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.max(F.col("extracted_at").cast("timestamp")).alias("t"))
    u = view(spark, sf_dir, "restaurant_x").select("slug").join(last, "slug", "left")
    return S.freshness(u, F.lit("2024-01-30 16:20:00").cast("timestamp"), "t", 2)


@query(oracle("d AS (SELECT slug, raw_title, bit_or(1 << (CASE lower(substr(raw_day,1,3)) WHEN 'mon' THEN 0 WHEN 'tue' THEN 1 WHEN 'wed' THEN 2 WHEN 'thu' THEN 3 WHEN 'fri' THEN 4 WHEN 'sat' THEN 5 ELSE 6 END)) AS mask FROM raw_x GROUP BY slug, raw_title) SELECT slug, raw_title, mask FROM d", "raw_x"))
def h9_day_masks(spark, sf_dir):
    x = view(spark, sf_dir, "raw_x").groupBy("slug", "raw_title").agg(F.collect_set(T.day_name(F.col("raw_day"))).alias("days"))
    return x.select("slug", "raw_title", T.day_mask(F.col("days")).alias("mask"))


@query("""SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER w > 0 AS near_user FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def w13_context_window(spark, sf_dir):
    """Whether a line with the keyword's mark is at most two lines away."""
    near = F.max(F.col("role") == "user").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2))
    return view(spark, sf_dir, "conversations").select("conv_id", "turn", near.alias("near_user"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def w12_carry_forward(spark, sf_dir):
    frame = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return view(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") != "assistant", F.col("role")), ignorenulls=True).over(frame).alias("section"))


@query("SELECT count(*) AS n, count(l.doc_id) AS labelled, count(*) FILTER (quality = 1) AS good, round(100.0 * count(l.doc_id) / count(*), 4) AS percent FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def a21_label_coverage(spark, sf_dir):
    x = view(spark, sf_dir, "documents").select("doc_id").join(view(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("has")), "doc_id", "left")
    return x.agg(F.count("*").alias("n"), F.count("has").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.count("has") * 100 / F.count("*"), 4).alias("percent"))

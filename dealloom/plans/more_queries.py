"""Loose times, labels, insights, migrations, exports and work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealloom.functions import deals as D
from dealloom.functions import times as T
from dealloom.operators import overlay as O  # noqa: E741
from dealloom.operators import quality as Q
from dealloom.operators import status as S
from dealloom.plans.deal_queries import DAY, TIME
from dealloom.plans.registry import query
from dealloom.plans.report_queries import CLOCK, NORMAL, slots
from dealloom.plans.report_queries import SLOTS as SLOTS_SQL
from dealloom.plans.views import oracle, view

HOUR = "CAST(seq % 14 AS INT)"


@query(oracle(f"""SELECT seq, CASE WHEN seq % 3 = 0 THEN CASE WHEN {HOUR} BETWEEN 3 AND 11 THEN lpad(CAST({HOUR} + 12 AS VARCHAR), 2, '0') || ':00' WHEN {HOUR} = 12 THEN '12:00' WHEN {HOUR} IN (1, 2) THEN '0' || CAST({HOUR} AS VARCHAR) || ':00' END
 WHEN seq % 3 = 1 THEN {TIME.format('raw_start')} ELSE lpad(CAST({HOUR} AS VARCHAR), 2, '0') || ':30' END AS time FROM raw_x""", "raw_x"))
def h3_loose_times(spark, sf_dir):
    h = (F.col("seq") % 14).cast("string")
    text = F.when(F.col("seq") % 3 == 0, h).when(F.col("seq") % 3 == 1, F.col("raw_start")).otherwise(F.concat(h, F.lit(".30")))
    return view(spark, sf_dir, "raw_x").select("seq", T.loose_time_24h(text).alias("time"))


@query(oracle("SELECT seq, CASE WHEN seq % 14 BETWEEN 2 AND 11 THEN CAST(seq % 14 AS VARCHAR) || ':00 PM' ELSE CAST(seq % 14 AS VARCHAR) END AS bare, replace(replace(raw_start, ' am', ':00 AM'), ' pm', ':00 PM') AS shown FROM raw_x", "raw_x"))
def h4_shown_times(spark, sf_dir):
    return view(spark, sf_dir, "raw_x").select("seq", T.shown_time((F.col("seq") % 14).cast("string")).alias("bare"), T.shown_time(F.col("raw_start")).alias("shown"))


@query(oracle("SELECT seq, replace(replace(raw_start, ' am', ':00 AM'), ' pm', ':00 PM') || ' - ' || replace(replace(raw_end, ' am', ':00 AM'), ' pm', ':00 PM') AS timeframe FROM raw_x", "raw_x"))
def h13_timeframes(spark, sf_dir):
    return view(spark, sf_dir, "raw_x").select("seq", T.timeframe(F.concat_ws(" - ", F.col("raw_start"), F.when(F.col("raw_start").isNotNull(), F.col("raw_end")))).alias("timeframe"))


@query(oracle(f"SELECT seq, upper(substr({DAY.format('raw_day')}, 1, 1)) || substr({DAY.format('raw_day')}, 2) AS days FROM raw_x", "raw_x"))
def h14_day_titles(spark, sf_dir):
    return view(spark, sf_dir, "raw_x").select("seq", F.array_join(T.day_titles(F.array("raw_day", F.upper("raw_day"), F.lit("holiday"))), ",").alias("days"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 IN (1, 2, 3, 4, 5) THEN 'Mon-Fri' ELSE 'Thu, Sun-Tue' END AS days FROM supplier")
def h9_compact_days(spark, sf_dir):
    some = F.when((F.col("s_suppkey") % 7).between(1, 5), F.array(*map(F.lit, T.WEEK[:5]))).otherwise(F.array(*map(F.lit, ("sunday", "monday", "tuesday", "thursday"))))
    x = view(spark, sf_dir, "supplier").select("s_suppkey", some.alias("d"))
    return x.select("s_suppkey", T.compact_days(F.col("d")).alias("days"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '11:30' ELSE '09:00' END AS monday_open, '22:00' AS sunday_close FROM supplier")
def h18_hours(spark, sf_dir):
    first = F.when(F.col("s_suppkey") % 2 == 0, "1130").otherwise("0900")
    period = lambda d, a, b: F.struct(F.lit(d).alias("day"), a.alias("open"), F.lit(b).alias("close"))
    x = view(spark, sf_dir, "supplier").select("s_suppkey", F.array(period(0, F.lit("0800"), "2200"), period(1, F.lit("0700"), "1500"), period(1, first, "2100")).alias("p"))
    x = x.withColumn("h", T.hours_map(F.col("p")))
    return x.select("s_suppkey", F.col("h")["monday"]["open"].alias("monday_open"), F.col("h")["sunday"]["close"].alias("sunday_close"))


@query(oracle(f"u AS (SELECT slug, max(extracted_at) AS t FROM raw_x GROUP BY slug), m AS (SELECT slug, CAST(floor(epoch(TIMESTAMP '{CLOCK}' + INTERVAL 14 DAY - t) / 60) AS BIGINT) AS m FROM u) SELECT slug, CASE WHEN m < 60 THEN m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END WHEN m < 1440 THEN (m // 60) || ' hour' || CASE WHEN m // 60 = 1 THEN '' ELSE 's' END ELSE (m // 1440) || ' day' || CASE WHEN m // 1440 = 1 THEN '' ELSE 's' END END || ' ago' AS updated FROM m", "raw_x"))
def h19_ago(spark, sf_dir):
    u = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.max("extracted_at").alias("t"))
    return u.select("slug", T.ago(F.col("t"), F.lit("2024-01-31 16:20:00").cast("timestamp")).alias("updated"))


@query(oracle("SELECT seq, '$5 Beers|' || raw_price || '|$10 Cocktails' AS prices FROM raw_x", "raw_x"))
def h37_price_list(spark, sf_dir):
    text = F.concat(F.lit("$5 Beers, "), F.col("raw_price"), F.lit(" and $10  Cocktails"))
    return view(spark, sf_dir, "raw_x").select("seq", F.array_join(D.price_list(text), "|").alias("prices"))


@query(oracle("SELECT seq, trim(regexp_replace(replace(raw_description, '$5 beer', ''), '\\s+', ' ', 'g')) AS description FROM raw_x", "raw_x"))
def h39_without_prices(spark, sf_dir):
    return view(spark, sf_dir, "raw_x").select("seq", D.without_prices(F.col("raw_description"), F.array(F.lit("$5 beer"))).alias("description"))


@query(oracle("g AS (SELECT slug, count(*) AS n, count(*) FILTER (raw_price LIKE '$1%') AS p, bool_or(raw_title = 'Happy Hour') AS c FROM raw_x GROUP BY slug) SELECT slug, round(least(least(n * 0.1, 0.5) + CASE WHEN c THEN 0.3 ELSE 0 END + CASE WHEN p > 0 THEN 0.2 ELSE 0 END + p * 0.1 + 3 * 0.05, 1.0), 6)::DOUBLE AS confidence FROM g", "raw_x"))
def h25_page_confidence(spark, sf_dir):
    g = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.count("*").alias("n"), F.count_if(F.col("raw_price").startswith("$1")).alias("p"), F.bool_or(F.col("raw_title") == "Happy Hour").alias("c"))
    return g.select("slug", D.page_deal_confidence(F.col("n"), F.col("c"), F.col("p"), F.lit(3)).alias("confidence"))


@query(oracle("SELECT slug, round(0.5 - CASE WHEN cuisine = 'Steakhouse' THEN 0.1 ELSE 0 END, 6)::DOUBLE AS prior FROM restaurant_x", "restaurant_x"))
def h26_type_prior(spark, sf_dir):
    return view(spark, sf_dir, "restaurant_x").select("slug", D.type_prior(F.col("name"), F.col("cuisine")).alias("prior"))


@query("SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0 ELSE round(least(1.0, 0.5 + CASE WHEN length(text) > 1000 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '\\d{3}[-. \\t\\n\\x0B\\f\\r]?\\d{3}[-. \\t\\n\\x0B\\f\\r]?\\d{4}') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\d+[ \\t\\n\\x0B\\f\\r]+[a-z \\t\\n\\x0B\\f\\r]+(street|st|avenue|ave)') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'hours|open|monday|tuesday') THEN 0.1 ELSE 0 END), 6) END::DOUBLE AS quality FROM documents")
def h32_source_quality(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", D.source_quality(F.col("text")).alias("quality"))


@query(oracle("""g AS (SELECT slug, count(*) AS n, count(*) FILTER (raw_price LIKE '%oyster%') AS f, count(*) FILTER (NOT raw_price LIKE '%oyster%') AS d, avg(value) AS v FROM raw_x GROUP BY slug)
SELECT g.slug, concat_ws(';', CASE WHEN n > 100 THEN 'deal leader' WHEN n > 50 THEN 'strong offering' WHEN n < 10 THEN 'limited data' END, CASE WHEN v > 0 THEN CASE WHEN v < 10 THEN 'excellent value' WHEN v > 15 THEN 'premium' ELSE 'balanced pricing' END END, CASE WHEN cuisine = 'Italian' THEN 'wine and aperitivo' WHEN cuisine = 'Steakhouse' THEN 'premium dining' END, CASE WHEN d > f * 2 THEN 'drink-focused' WHEN f > d THEN 'food-forward' END) AS insights FROM g LEFT JOIN restaurant_x x ON x.slug = g.slug""", "raw_x", "restaurant_x"))
def x19_h33_insights(spark, sf_dir):
    food = F.col("raw_price").contains("oyster")
    g = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.count("*").alias("n"), F.count_if(food).alias("f"), F.count_if(~food).alias("d"), F.avg("value").alias("v"))
    g = g.join(view(spark, sf_dir, "restaurant_x").select("slug", "cuisine"), "slug", "left")
    return g.select("slug", F.array_join(D.insights(F.col("n"), F.col("f"), F.col("d"), F.col("v"), F.col("cuisine")), ";").alias("insights"))


@query("SELECT n_name AS district, r_name AS metro, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def h34_district_metro(spark, sf_dir):
    """The small dimension is 25 rows by its nature; Spark broadcasts it by size."""
    dim = view(spark, sf_dir, "nation").join(view(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("district"), F.col("r_name").alias("metro"))
    n = view(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return n.join(dim, F.col("s_nationkey") == F.col("n_nationkey")).select("district", "metro", "n")


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS number, 'Main Street' AS street, CASE WHEN c_custkey % 2 = 0 THEN '4B' END AS unit FROM customer")
def h42_streets(spark, sf_dir):
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(" Main Street"), F.when(F.col("c_custkey") % 2 == 0, " #4B").otherwise(""), F.lit(", Springfield"))
    return view(spark, sf_dir, "customer").select("c_custkey", *D.street_parts(line))


@query(oracle("SELECT seq, concat_ws(' • ', raw_day, raw_start || ' - ' || raw_end, raw_price) AS line FROM raw_x", "raw_x"))
def h43_display_lines(spark, sf_dir):
    return view(spark, sf_dir, "raw_x").select("seq", D.display_line(F.col("raw_day"), F.col("raw_start"), F.col("raw_end"), F.col("raw_price")).alias("line"))


@query(oracle("SELECT slug, CASE WHEN website IS NULL THEN 'no website' WHEN website LIKE 'http://%' THEN 'insecure website' END AS message FROM restaurant_x WHERE website IS NULL OR website LIKE 'http://%' UNION ALL SELECT slug, 'no phone' FROM restaurant_x WHERE phone IS NULL", "restaurant_x"))
def p14_restaurant_issues(spark, sf_dir):
    w = F.col("website")
    found = [Q.issue(w.isNull(), "warning", "no website"), Q.issue(w.startswith("http://"), "info", "insecure website"), Q.issue(F.col("phone").isNull(), "warning", "no phone")]
    return Q.issues_of(view(spark, sf_dir, "restaurant_x"), ("slug",), found).select("slug", "message")


@query(oracle("b AS (SELECT DISTINCT slug FROM raw_x WHERE confidence_score < 0.2) SELECT slug, seq FROM raw_x WHERE confidence_score >= 0.2 AND raw_title <> ''", "raw_x"))
def p13_validated_only(spark, sf_dir):
    """Only deals without issues replace live ones."""
    bad = F.array(Q.issue(F.col("confidence_score") < 0.2, "warning", "low confidence"), Q.issue(F.col("raw_title") == "", "error", "no title"))
    return view(spark, sf_dir, "raw_x").filter(F.size(F.filter(bad, lambda i: i.isNotNull())) == 0).select("slug", "seq")


@query(oracle("SELECT seq, trim(regexp_replace(raw_title, '(?i)late night', '')) AS title FROM raw_x", "raw_x"))
def p20_excluded_patterns(spark, sf_dir):
    return view(spark, sf_dir, "raw_x").select("seq", F.trim(F.regexp_replace("raw_title", "(?i)late night", "")).alias("title"))


@query(oracle("SELECT seq, confidence_score FROM raw_x WHERE confidence_score > 0.3 ORDER BY confidence_score DESC, seq LIMIT 50", "raw_x"))
def p23_l4_work_list(spark, sf_dir):
    """The 50 best of the work list: a limit is the feature."""
    return view(spark, sf_dir, "raw_x").filter("confidence_score > 0.3").orderBy(F.desc("confidence_score"), "seq").limit(50).select("seq", "confidence_score")


@query(oracle("SELECT slug, coalesce(website, 'none') AS website, name FROM restaurant_x", "restaurant_x"))
def p28_p29_moved_fields(spark, sf_dir):
    """A field moves from one struct to another, and the emptied struct goes."""
    x = view(spark, sf_dir, "restaurant_x").select("slug", F.struct("website").alias("service_info"), F.struct("name").alias("places"))
    x = x.withColumn("places", F.col("places").withField("website", F.coalesce(F.col("service_info.website"), F.lit("none")))).drop("service_info")
    return x.select("slug", "places.website", "places.name")


@query(oracle("SELECT sha256(slug || '|' || CAST(seq AS VARCHAR) || '|' || raw_title) AS extraction_id, seq, raw_start AS first_time FROM raw_x", "raw_x"))
def p31_raw_layer(spark, sf_dir):
    """Ids from content, so that a repeated run gives the same ones."""
    x = view(spark, sf_dir, "raw_x").withColumn("raw_times", F.array("raw_start", "raw_end"))
    return x.select(F.sha2(F.concat_ws("|", "slug", F.col("seq").cast("string"), "raw_title"), 256).alias("extraction_id"), "seq", F.get("raw_times", F.lit(0)).alias("first_time"))


@query(oracle(f"SELECT x.slug, coalesce(x.phone, o.phone) AS phone, coalesce({NORMAL.format('o.website')}, {NORMAL.format('x.website')}) AS website FROM restaurant_x x LEFT JOIN overlay_x o ON o.slug = x.slug", "restaurant_x", "overlay_x"))
def p32_picked_fields(spark, sf_dir):
    from dealloom.operators.pages import normal_url

    o = view(spark, sf_dir, "overlay_x").select("slug", F.col("phone").alias("p2"), F.col("website").alias("w2"))
    x = view(spark, sf_dir, "restaurant_x").join(o, "slug", "left")
    return x.select("slug", F.coalesce(F.nullif("phone", F.lit("")), "p2").alias("phone"), F.coalesce(normal_url(F.col("w2")), normal_url(F.col("website"))).alias("website"))


@query(oracle("SELECT seq, CASE WHEN raw_title = 'Taco Night' THEN 'Two for one. ' ELSE '' END || raw_description AS description FROM raw_x", "raw_x"))
def j10_merge_rules(spark, sf_dir):
    """Rules for all deals or for a title put text in front of a description."""
    rules = spark.createDataFrame([(1, "^Taco Night$", "Two for one. ")], "ord int, pattern string, prefix string")
    x = O.transformed(view(spark, sf_dir, "raw_x").select("seq", "raw_title", "raw_description"), rules, "raw_title")
    return x.select("seq", F.concat(F.coalesce("prefix", F.lit("")), "raw_description").alias("description"))


@query(oracle("b AS (SELECT slug, count(*) AS n FROM raw_x GROUP BY slug) SELECT x.slug, r.seq, coalesce(n, 0) AS n FROM restaurant_x x LEFT JOIN b ON b.slug = x.slug LEFT JOIN raw_x r ON r.slug = x.slug", "raw_x", "restaurant_x"))
def j19_deals_by_restaurant(spark, sf_dir):
    """Each deal beside its restaurant's number of deals; restaurants without deals have one row."""
    x = view(spark, sf_dir, "raw_x").select("slug", "seq")
    n = x.groupBy("slug").agg(F.count("*").alias("n"))
    out = view(spark, sf_dir, "restaurant_x").select("slug").join(n, "slug", "left").join(x, "slug", "left")
    return out.select("slug", "seq", F.coalesce("n", F.lit(0)).alias("n"))


@query(oracle("SELECT 'no_website' AS need, count(*) AS n FROM restaurant_x WHERE website IS NULL HAVING count(*) > 0 UNION ALL SELECT 'no_phone', count(*) FROM restaurant_x WHERE phone IS NULL HAVING count(*) > 0 UNION ALL SELECT 'no_cuisine', count(*) FROM restaurant_x WHERE cuisine IS NULL HAVING count(*) > 0", "restaurant_x"))
def a19_needs(spark, sf_dir):
    one = view(spark, sf_dir, "restaurant_x").agg(*[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("website", "phone", "cuisine")])
    return one.unpivot([], ["no_website", "no_phone", "no_cuisine"], "need", "n").filter("n > 0")


@query(oracle(f"{SLOTS_SQL} SELECT slug, status, CASE status WHEN 'active' THEN 0 WHEN 'upcoming' THEN 1 WHEN 'closed' THEN 2 ELSE 3 END AS priority FROM status", "raw_x"))
def l3_status_order(spark, sf_dir):
    s = F.col("status")
    out = S.live_status(slots(spark, sf_dir), F.lit(CLOCK).cast("timestamp"))
    return out.select("slug", "status", F.when(s == "active", 0).when(s == "upcoming", 1).when(s == "closed", 2).otherwise(3).alias("priority")).orderBy("priority", "slug")


@query(oracle(f"SELECT DISTINCT {DAY.format('raw_day')} AS day, CASE {DAY.format('raw_day')} WHEN 'monday' THEN 1 WHEN 'tuesday' THEN 2 WHEN 'wednesday' THEN 3 WHEN 'thursday' THEN 4 WHEN 'friday' THEN 5 WHEN 'saturday' THEN 6 ELSE 7 END AS number FROM raw_x", "raw_x"))
def l5_day_order(spark, sf_dir):
    day = T.day_name(F.col("raw_day"))
    return view(spark, sf_dir, "raw_x").select(day.alias("day"), F.array_position(F.array(*map(F.lit, T.WEEK)), day).cast("int").alias("number")).distinct()


@query(oracle(f"a AS (SELECT slug, list_distinct(list({DAY.format('raw_day')}) FILTER (seq % 2 = 0)) AS x, list_distinct(list({DAY.format('raw_day')}) FILTER (seq % 3 = 0)) AS y FROM raw_x GROUP BY slug) SELECT slug, coalesce(len(list_intersect(x, y)), 0)::INT AS common, (coalesce(len(x), 0) + coalesce(len(y), 0) - coalesce(len(list_intersect(x, y)), 0))::INT AS either FROM a", "raw_x"))
def u4_day_sets(spark, sf_dir):
    day = T.day_name(F.col("raw_day"))
    a = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.collect_set(F.when(F.col("seq") % 2 == 0, day)).alias("x"), F.collect_set(F.when(F.col("seq") % 3 == 0, day)).alias("y"))
    return a.select("slug", F.size(F.array_intersect("x", "y")).alias("common"), F.size(F.array_union("x", "y")).alias("either"))


@query(oracle("c AS (SELECT slug, count(*) AS n, arg_max(raw_title, confidence_score * 1000000 - seq) AS best FROM raw_x WHERE confidence_score >= 0.7 GROUP BY slug) SELECT x.slug, x.district, x.metro, coalesce(n, 0) AS n_deals, best FROM restaurant_x x LEFT JOIN c ON c.slug = x.slug", "raw_x", "restaurant_x"))
def s14_website_export(spark, sf_dir):
    sure = view(spark, sf_dir, "raw_x").filter("confidence_score >= 0.7")
    c = sure.groupBy("slug").agg(F.count("*").alias("n_deals"), F.max_by("raw_title", F.struct("confidence_score", (-F.col("seq")).alias("early"))).alias("best"))
    x = view(spark, sf_dir, "restaurant_x").select("slug", "district", "metro").join(c, "slug", "left")
    return x.withColumn("n_deals", F.coalesce("n_deals", F.lit(0)))


@query(oracle("SELECT seq, CASE WHEN seq % 3 = 0 THEN 'Daily | 3 - 6' WHEN seq % 3 = 1 THEN 'Mon - Fri 3 - 6' ELSE 'Sat - Sun: Thu' END AS days FROM raw_x", "raw_x"))
def h10_shortened_days(spark, sf_dir):
    text = F.when(F.col("seq") % 3 == 0, "Monday, Tuesday, Wednesday,  Thursday, Friday, Saturday, Sunday|3-6").when(F.col("seq") % 3 == 1, "Mon, Tue, Wed, Thu, Fri 3 -6").otherwise("Saturday, Sunday: thursday")
    return view(spark, sf_dir, "raw_x").select("seq", T.shortened_days(text).alias("days"))


@query("SELECT doc_id, round(least(1.0, CASE WHEN contains(lower(text), 'the ') THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(text), ' und ') THEN 0.2 ELSE 0 END + least(len(regexp_extract_all(lower(text), '\\d{1,2}[ \\t\\n\\x0B\\f\\r]*(:\\d{2})?[ \\t\\n\\x0B\\f\\r]*(am|pm)')) * 0.1, 0.3) + least(len(regexp_extract_all(lower(text), '\\$\\d+')) * 0.05, 0.2)), 6)::DOUBLE AS score FROM documents")
def h22_content_score(spark, sf_dir):
    from dealloom.operators.pages import content_score

    return view(spark, sf_dir, "documents").select("doc_id", content_score(F.col("text"), ("the ", " und ")).alias("score"))


@query(oracle("""SELECT seq, CAST(0 AS INT) AS pos, 'mon-fri' AS days, raw_start || '-' || raw_end AS time, false AS is_all_day, 0.9::DOUBLE AS confidence FROM raw_x WHERE raw_start IS NOT NULL
 UNION ALL SELECT seq, CASE WHEN raw_start IS NULL THEN 0 ELSE 1 END, NULL, NULL, true, 0.6 FROM raw_x UNION ALL SELECT seq, CASE WHEN raw_start IS NULL THEN 1 ELSE 2 END, NULL, NULL, false, 0.1 FROM raw_x""", "raw_x"))
def h17_legacy_entries(spark, sf_dir):
    from dealloom.operators.extract import legacy_entries

    first = F.concat(F.lit("Mon-Fri "), F.col("raw_start"), F.lit("-"), F.col("raw_end"))
    text = F.concat_ws(" | ", first, F.lit("ALL DAY"), F.lit("ask inside"))
    return legacy_entries(view(spark, sf_dir, "raw_x").select("seq", text.alias("text")), ("seq",))


@query(oracle(r"""n AS (SELECT *, max(CASE WHEN lower(line) LIKE '%steel%' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS near FROM menu_x),
a AS (SELECT *, bool_or(near) OVER (PARTITION BY page_id) AS hit FROM n)
SELECT page_id, pos, near, CAST(regexp_extract(line, '\$(\d+)', 1) AS DOUBLE) AS price FROM a WHERE (near OR NOT hit) AND regexp_matches(line, '\$\d') AND CAST(regexp_extract(line, '\$(\d+)', 1) AS DOUBLE) BETWEEN 3 AND 200""", "menu_x"))
def x9_document_deals(spark, sf_dir):
    from dealloom.operators.extract import document_deals

    return document_deals(view(spark, sf_dir, "menu_x"), words="steel", around=1).select("page_id", "pos", "near", "price")


@query(oracle("""j AS (SELECT x.district, x.slug, count(r.seq) AS n, round(avg(r.confidence_score), 6) AS confidence FROM restaurant_x x LEFT JOIN raw_x r ON r.slug = x.slug GROUP BY ALL)
SELECT district, slug, n, confidence, count(*) OVER d AS n_restaurants, CAST(sum(n) OVER d AS BIGINT) AS n_deals FROM j WINDOW d AS (PARTITION BY district)""", "raw_x", "restaurant_x"))
def s15_dashboard(spark, sf_dir):
    """A profile of each restaurant beside the totals of its district."""
    n = view(spark, sf_dir, "raw_x").groupBy("slug").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 6).alias("confidence"))
    x = view(spark, sf_dir, "restaurant_x").select("slug", "district").join(n, "slug", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = x.groupBy("district").agg(F.count("*").alias("n_restaurants"), F.sum("n").alias("n_deals"))
    return x.join(total, "district").select("district", "slug", "n", "confidence", "n_restaurants", "n_deals")


@query("SELECT page_id FROM pages WHERE page_id % 3 = 0 AND page_id % 2 = 0")
def s7_menu_documents(spark, sf_dir):
    from dealloom.operators.pages import menu_documents

    k = F.col("page_id")
    x = view(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://x.org/"), F.when(k % 3 == 0, "Menu").otherwise("about"), F.when(k % 2 == 0, ".PDF").otherwise("")).alias("url"), F.lit(None).cast("string").alias("content_type"))
    return menu_documents(x).select("page_id")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Monday,Tuesday=3-6 pm|9 pm-close' ELSE 'Friday=4-7 pm' END AS schedule FROM supplier")
def h15_weekly_schedule(spark, sf_dir):
    curated = F.create_map(F.when(F.col("s_suppkey") % 2 == 0, "monday_tue").otherwise("fri"), F.when(F.col("s_suppkey") % 2 == 0, "3-6 pm, 9 pm-close").otherwise("4-7 pm"))
    x = view(spark, sf_dir, "supplier").select("s_suppkey", T.weekly_schedule(curated).alias("w"))
    return x.select("s_suppkey", F.array_join(F.transform("w", lambda s: F.concat(F.array_join(s["days"], ","), F.lit("="), F.array_join(s["times"], "|"))), ";").alias("schedule"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) || ' Main St.' END AS street, CASE WHEN c_custkey % 3 = 0 THEN '80202' END AS zip_code FROM customer")
def p7_address_parts(spark, sf_dir):
    k = F.col("c_custkey")
    x = view(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(" Main St."))).otherwise("Main St.").alias("street"), F.when(k % 3 == 0, "80202").otherwise("8020").alias("zip_code"), F.lit("Springfield").alias("city"), F.lit("CO").alias("state"))
    out, _ = Q.with_invalid_nulled(x, Q.address_checks())
    return out.select("c_custkey", "street", "zip_code")


@query(oracle(f"""p AS (SELECT slug, phone, website, CASE WHEN phone IS NULL THEN 0 ELSE 1 END + CASE WHEN website IS NULL THEN 0 ELSE 1 END AS n FROM restaurant_x)
SELECT slug, CASE WHEN phone IS NOT NULL THEN '(' || substr(phone, 3, 3) || ') ' || substr(phone, 7) END AS phone, {NORMAL.format('website')} AS website, CAST(n AS INT) AS n_enhanced,
 round(CASE WHEN phone IS NULL THEN 0 ELSE 0.6 END + CASE WHEN website IS NULL THEN 0 ELSE 0.4 END, 6)::DOUBLE AS completeness_score, round(CASE WHEN n > 0 THEN least(0.95, 0.8 + least(0.2, n * 0.05)) ELSE 0.8 END, 6)::DOUBLE AS confidence_score FROM p""", "restaurant_x"))
def x13_enhanced_profiles(spark, sf_dir):
    x = view(spark, sf_dir, "restaurant_x").select("slug", "phone", "website", F.lit(0.8).alias("confidence_score"))
    return Q.enhanced_profiles(x, {"phone": 0.6, "website": 0.4}).select("slug", "phone", "website", "n_enhanced", "completeness_score", "confidence_score")

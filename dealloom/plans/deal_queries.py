"""Refinement and consolidation on deals derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealloom.functions import deals as D
from dealloom.functions import times as T
from dealloom.operators import consolidate as C
from dealloom.operators import refine as R
from dealloom.plans.registry import query
from dealloom.plans.views import oracle, view

# DuckDB text for the shared steps.
TIME = """CASE WHEN regexp_matches(lower(trim({0})), '^\\d{{1,2}}(:\\d{{2}})?\\s*(am|pm)$') THEN
 lpad(CAST(CAST(regexp_extract(lower({0}), '^(\\d{{1,2}})', 1) AS INT) % 12 + CASE WHEN lower({0}) LIKE '%pm' THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || ':' ||
 CASE WHEN {0} LIKE '%:%' THEN regexp_extract({0}, ':(\\d{{2}})', 1) ELSE '00' END
 WHEN regexp_matches({0}, '^\\d{{2}}:\\d{{2}}$') THEN {0} END"""
LABEL = """CAST(CASE WHEN CAST(substr({0},1,2) AS INT) % 12 = 0 THEN 12 ELSE CAST(substr({0},1,2) AS INT) % 12 END AS VARCHAR) || ':' || substr({0},4,2) || CASE WHEN CAST(substr({0},1,2) AS INT) < 12 THEN ' AM' ELSE ' PM' END"""
DAY = """CASE lower(substr({0},1,3)) WHEN 'mon' THEN 'monday' WHEN 'tue' THEN 'tuesday' WHEN 'wed' THEN 'wednesday' WHEN 'thu' THEN 'thursday' WHEN 'fri' THEN 'friday' WHEN 'sat' THEN 'saturday' ELSE 'sunday' END"""
TITLE = r"""nullif(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(raw_title, '\s+', ' ', 'g')), '^time:\s*', '', 'i'), '\s*\|\s*Days:.*$', '', 'i'), '\s*\|\s*Time:.*$', '', 'i')), '')"""
TEXT = "lower(raw_title || ' ' || raw_description)"
KIND = f"""CASE WHEN regexp_matches({TEXT}, 'bottomless|unlimited') THEN 'bottomless' WHEN regexp_matches({TEXT}, 'brunch|breakfast|mimosa') THEN 'brunch'
 WHEN regexp_matches({TEXT}, 'prix fixe|tasting menu|chef') THEN 'prix_fixe' WHEN regexp_matches({TEXT}, 'game day|football|sports') THEN 'game_day'
 WHEN regexp_matches({TEXT}, 'trivia|quiz') THEN 'trivia' WHEN regexp_matches({TEXT}, 'industry|service') THEN 'industry_night'
 WHEN regexp_matches({TEXT}, 'late night|midnight') THEN 'late_night' WHEN regexp_matches({TEXT}, 'early bird|sunset') THEN 'early_bird'
 WHEN day = 'tuesday' AND {TEXT} LIKE '%taco%' OR day = 'wednesday' AND {TEXT} LIKE '%wine%' THEN 'daily_special'
 WHEN day IN ('saturday','sunday') THEN 'weekend' ELSE 'happy_hour' END"""
CATEGORY = """CASE WHEN {0} LIKE '%wine%' THEN 'wine' WHEN {0} LIKE '%beer%' THEN 'beer' WHEN {0} LIKE '%oyster%' THEN 'oysters' ELSE 'unknown' END"""
TIER = "CASE WHEN {0} >= 0.8 THEN 'high' WHEN {0} >= 0.5 THEN 'medium' ELSE 'low' END"
TIMED = f"timed AS (SELECT *, {TIME.format('raw_start')} AS t1, {TIME.format('raw_end')} AS t2, {DAY.format('raw_day')} AS day FROM raw_x)"
TIER_OF_RAW = TIER.format("((confidence_score + ((CASE WHEN raw_title <> '' THEN 1 ELSE 0 END) + 3) / 4.0) / 2)")
KEYED = f"""{TIMED}, kinds AS (SELECT *, {KIND} AS kind, {TIER_OF_RAW} AS tier FROM timed),
keyed AS (SELECT *, slug || '-' || kind || '-' || day || '-' || coalesce(t1,'any') || '-' || coalesce(t2,'any') AS id FROM kinds)"""
FIRSTS = f"""{KEYED}, g AS (SELECT id, count(*) AS n_raw, avg(confidence_score) AS conf, max(substr(CAST(extracted_at AS VARCHAR),1,10)) AS verified, min(seq) AS s FROM keyed GROUP BY id),
sched AS (SELECT g.id, k.slug, k.kind, k.day, k.t1, k.t2, k.raw_title, k.raw_description, k.tier, k.source_url, n_raw, conf, verified FROM g JOIN keyed k ON k.seq = g.s)"""
TITLE_CASE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(substr(w,1,1)) || lower(substr(w,2))), ' ')"
NAME = f"coalesce({TITLE}, {TITLE_CASE.format(chr(39).join(['replace(kind, ', '_', ', ', ' ', ')']))})"
WHEN = f"upper(substr(day,1,1)) || substr(day,2,2) || CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL THEN ' ' || {LABEL.format('t1')} || '-' || {LABEL.format('t2')} ELSE '' END"


def raw_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = view(spark, sf_dir, "raw_x")
    times = F.when(F.col("raw_start").isNull(), F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))).otherwise(F.array("raw_start", "raw_end"))
    return x.withColumnRenamed("slug", "restaurant_slug").withColumns({"raw_times": times, "raw_days": F.array("raw_day"), "raw_prices": F.array("raw_price")})


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = view(spark, sf_dir, "raw_x")
    return x.select(
        "seq", F.col("slug").alias("restaurant_slug"), F.col("raw_title").alias("title"), F.col("raw_description").alias("description"), F.col("raw_start").alias("start_time"), F.col("raw_end").alias("end_time"),
        F.col("raw_description").contains("all day").alias("is_all_day"), T.day_list(F.array("raw_day")).alias("days"), F.col("source_url").alias("source_text"), "extraction_method", "confidence_score", "source_url", "extracted_at",
    )


@query(oracle(f"{TIMED} SELECT seq, day, t1 AS start_time, t2 AS end_time, {LABEL.format('t1')} AS start_label FROM timed", "raw_x"))
def h1_h2_h5_times(spark, sf_dir):
    x = view(spark, sf_dir, "raw_x")
    return x.select("seq", T.day_name(F.col("raw_day")).alias("day"), T.time_24h(F.col("raw_start")).alias("start_time"), T.time_24h(F.col("raw_end")).alias("end_time")).withColumn("start_label", T.time_12h(F.col("start_time")))


@query(oracle(f"{KEYED} SELECT kind AS deal_type, tier AS data_quality, count(*) AS n FROM keyed GROUP BY ALL", "raw_x"))
def h27_h30_kinds_and_tiers(spark, sf_dir):
    return R.with_schedule_id(raw_extractions(spark, sf_dir)).groupBy("deal_type", "data_quality").agg(F.count("*").alias("n"))


@query(oracle(f"SELECT seq, {TITLE} AS title, regexp_matches({TEXT}, 'all day|all-day|24 hours|always') AS is_all_day FROM raw_x", "raw_x"))
def p18_p19_titles(spark, sf_dir):
    x = view(spark, sf_dir, "raw_x")
    return x.select("seq", D.clean_title(F.col("raw_title")).alias("title"), D.all_day(F.col("raw_title"), F.col("raw_description")).alias("is_all_day"))


@query(oracle(f"{FIRSTS} SELECT id AS schedule_id, slug AS restaurant_slug, kind AS deal_type, {NAME} AS name, day AS days, t1 AS start_time, t2 AS end_time, tier AS data_quality, source_url AS menu_url, n_raw, round(conf, 6) AS average_confidence, verified AS last_verified FROM sched", "raw_x"))
def a11_a12_schedules(spark, sf_dir):
    out = R.schedules(R.with_schedule_id(raw_extractions(spark, sf_dir)))
    return out.select("schedule_id", "restaurant_slug", "deal_type", "name", F.array_join("days", ",").alias("days"), "start_time", "end_time", "data_quality", "menu_url", "n_raw", F.round("average_confidence", 6).alias("average_confidence"), "last_verified")


LAST_MENU = f"""{KEYED}, last AS (SELECT id, max(seq) AS s FROM keyed GROUP BY id),
menu AS (SELECT l.id, regexp_extract(raw_price, '(\\d+)', 1) AS price, trim(regexp_replace(raw_price, '\\$\\d+', '')) AS item, {CATEGORY.format('raw_price')} AS cat FROM last l JOIN keyed k ON k.seq = l.s)"""


@query(oracle(f"{LAST_MENU} SELECT id AS schedule_id, item, CAST(1 AS INT) AS item_count, cat AS categories, CASE WHEN cat IN ('wine','beer') THEN 'drinks' ELSE 'food' END AS menu_type, '$' || price || '-' || price AS price_range FROM menu", "raw_x"))
def a13_menus(spark, sf_dir):
    out = R.menus(R.with_schedule_id(raw_extractions(spark, sf_dir)))
    return out.select("schedule_id", F.col("items")[0]["name"].alias("item"), "item_count", F.array_join("categories", ",").alias("categories"), "menu_type", "price_range")


PUBLIC = f"""{FIRSTS}, last AS (SELECT id, max(seq) AS s FROM keyed GROUP BY id),
menu AS (SELECT l.id, regexp_extract(raw_price, '(\\d+)', 1) AS price, trim(regexp_replace(raw_price, '\\$\\d+', '')) AS item FROM last l JOIN keyed k ON k.seq = l.s),
pub AS (SELECT s.id, slug AS restaurant_slug, {NAME} AS deal_name, kind AS deal_type, {WHEN} AS "when", coalesce('$' || price || ' ' || item, '') AS highlights, '$' || price || '-' || price AS savings_range, {TIER.format('conf')} AS confidence, verified AS last_verified, source_url AS menu_url, 'User ' || substr(slug, 6) AS restaurant_name FROM sched s LEFT JOIN menu m ON m.id = s.id)"""


@query(oracle(f"{PUBLIC} SELECT * FROM pub", "raw_x"))
def x16_public_deals(spark, sf_dir):
    return R.refined(raw_extractions(spark, sf_dir))


@query(oracle(f"{PUBLIC} SELECT deal_type, count(*) AS n_deals, count(DISTINCT restaurant_slug) AS n_restaurants, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM pub GROUP BY deal_type", "raw_x"))
def a14_public_summary(spark, sf_dir):
    return R.public_summary(R.refined(raw_extractions(spark, sf_dir)))


@query(oracle(f"""{TIMED}, named AS (SELECT slug || '-' || CASE WHEN day IN ('saturday','sunday') THEN 'weekend' ELSE 'day' END AS id, * FROM timed)
 SELECT id AS schedule_id, count(*) AS n, arg_min(raw_title, seq) AS title, max(confidence_score) AS confidence FROM named GROUP BY id""", "raw_x"))
def x17_legacy_schedules(spark, sf_dir):
    """The older, coarser schedule key: without times, the first row wins."""
    x = view(spark, sf_dir, "raw_x")
    day = T.day_name(F.col("raw_day"))
    key = F.concat(F.col("slug"), F.when(day.isin("saturday", "sunday"), "-weekend").otherwise("-day"))
    return x.groupBy(key.alias("schedule_id")).agg(F.count("*").alias("n"), F.min_by("raw_title", "seq").alias("title"), F.max("confidence_score").alias("confidence"))


SIGNED = rf"""d AS (SELECT seq, slug, raw_title AS title, raw_description AS description, raw_start, raw_end, confidence_score, extraction_method, source_url, raw_description LIKE '%all day%' AS is_all_day, {DAY.format('raw_day')} AS day FROM raw_x),
signed AS (SELECT *, CASE WHEN is_all_day THEN 'all_day' WHEN raw_start IS NULL THEN 'no_time' ELSE replace(raw_start, ' ', '') || '_' || replace(raw_end, ' ', '') END AS time_signature, 'single_' || day AS day_signature,
 array_to_string(list_slice(list_sort(list_distinct(list_filter(regexp_extract_all(description, '\b[a-z]{{3,}}\b'), lambda w: w NOT IN ('happy','hour','found','pattern')))), 1, 3), '_') AS content_key,
 round(confidence_score * 0.4 + ((CASE WHEN raw_start IS NOT NULL THEN 0.5 ELSE 0.0 END) + 0.5) * 0.3 + least(length(source_url) / 200, 1.0) * 0.2 + (CASE WHEN extraction_method = 'universal_html_section' THEN 0.8 ELSE 0.5 END) * 0.1, 9) AS score FROM d)"""
RANKED = f"""{SIGNED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY slug, time_signature ORDER BY score DESC, seq) AS r1, row_number() OVER (PARTITION BY slug, content_key ORDER BY score DESC, seq) AS r2 FROM signed)"""


@query(oracle(f"{SIGNED} SELECT seq, time_signature, day_signature, content_key, score FROM signed", "raw_x"))
def h7_h8_h36_signatures(spark, sf_dir):
    return C.signed(deals(spark, sf_dir)).select("seq", "time_signature", "day_signature", "content_key", "score")


@query(oracle(f"{RANKED} SELECT seq, slug AS restaurant_slug, time_signature, content_key, score FROM ranked WHERE r1 = 1 AND r2 = 1", "raw_x"))
def x15_w3_consolidated(spark, sf_dir):
    return C.consolidated(C.signed(C.cleaned(deals(spark, sf_dir)))).select("seq", "restaurant_slug", "time_signature", "content_key", "score")


@query(oracle(f"{RANKED} SELECT slug AS restaurant_slug, time_signature, max(CASE WHEN r1 = 1 THEN seq END) AS representative, max(score) AS score, count(*) AS n FROM ranked GROUP BY ALL", "raw_x"))
def w2_a26_time_clusters(spark, sf_dir):
    return C.best_of(C.signed(deals(spark, sf_dir)), "restaurant_slug", "time_signature")


@query(oracle(f"{RANKED} SELECT slug AS restaurant_slug, content_key, max(CASE WHEN r2 = 1 THEN seq END) AS representative, max(score) AS score, count(*) AS n FROM ranked GROUP BY ALL HAVING count(*) > 1", "raw_x"))
def a27_content_groups(spark, sf_dir):
    return C.best_of(C.signed(deals(spark, sf_dir)), "restaurant_slug", "content_key").filter("n > 1")


@query(oracle(f"{SIGNED} SELECT slug AS restaurant_slug, count(*) AS n, round(0.4 * (1 - count(DISTINCT time_signature) / count(*)) + 0.4 * (1 - count(DISTINCT day_signature) / count(*)) + 0.2 * (1 - (max(confidence_score) - min(confidence_score))), 6) AS similarity FROM signed GROUP BY slug", "raw_x"))
def a28_group_similarity(spark, sf_dir):
    return C.group_similarity(C.signed(deals(spark, sf_dir)))


@query(oracle(f"{RANKED} SELECT slug AS restaurant_slug, count(*) AS n, count(*) FILTER (r1 = 1 AND r2 = 1) AS kept, round(greatest(0.0, least(1.0, 0.5 * avg(confidence_score) + 0.3 * avg(CASE WHEN confidence_score >= 0.8 THEN 1.0 ELSE 0.0 END) - 0.2 * (1 - count(*) FILTER (r1 = 1 AND r2 = 1) / count(*)))), 6) AS quality FROM ranked GROUP BY slug", "raw_x"))
def a29_extraction_quality(spark, sf_dir):
    keyed = C.signed(deals(spark, sf_dir))
    return C.extraction_quality(keyed, C.consolidated(keyed))


@query(oracle(f"{RANKED} SELECT count(*) AS n_deals, count(*) FILTER (r1 = 1 AND r2 = 1) AS n_kept, count(DISTINCT slug || time_signature) AS n_time_clusters, count(DISTINCT slug || content_key) AS n_content_groups FROM ranked", "raw_x"))
def a30_consolidation_report(spark, sf_dir):
    keyed = C.signed(deals(spark, sf_dir))
    kept = C.consolidated(keyed).agg(F.count("*").alias("n_kept"))
    sums = keyed.agg(F.count("*").alias("n_deals"), F.countDistinct("restaurant_slug", "time_signature").alias("n_time_clusters"), F.countDistinct("restaurant_slug", "content_key").alias("n_content_groups"))
    return sums.join(F.broadcast(kept), F.lit(True)).select("n_deals", "n_kept", "n_time_clusters", "n_content_groups")


@query(oracle("SELECT CASE WHEN trim(raw_title) = '' THEN 'no_title' END AS reject, count(*) AS n FROM raw_x GROUP BY ALL", "raw_x"))
def p1_rejects(spark, sf_dir):
    return C.with_reject(deals(spark, sf_dir)).groupBy("reject").agg(F.count("*").alias("n"))


@query(oracle(f"SELECT seq, trim(raw_title) AS title, greatest(0.0, least(1.0, confidence_score)) AS confidence_score, {DAY.format('raw_day')} AS days FROM raw_x", "raw_x"))
def p2_cleaned(spark, sf_dir):
    return C.cleaned(deals(spark, sf_dir)).select("seq", "title", "confidence_score", F.array_join("days", ",").alias("days"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def w6_exact_dedupe(spark, sf_dir):
    """First of each exact text, by aggregation on a digest: the texts themselves are not shuffled."""
    docs = view(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("key")

"""Queries on web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealloom.operators import pages as P
from dealloom.plans.registry import query
from dealloom.plans.views import VIEWS, oracle, view

TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""
TITLE = r"nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), '')"
N = "len(regexp_extract_all({0}, '(?i){1}'))"
ANCHORS = r"""a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS html, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), 1) - 1 AS pos FROM pages),
link AS (SELECT page_id, url AS source_url, pos, regexp_extract(url, '^(https?://[^/]+)', 1) AS base, regexp_extract(html, '(?i)href="([^"]*)"', 1) AS href, """ + TEXT + """ AS anchor_text FROM a),
links AS (SELECT page_id, source_url, pos, CASE WHEN href LIKE '/%' THEN base || href ELSE href END AS url, anchor_text FROM link)"""


@query(f"SELECT page_id, url, {TITLE} AS title, md5({TEXT}) AS text_md5, length({TEXT}) AS n_chars FROM pages")
def s8_page_text(spark, sf_dir):
    return P.page_text(view(spark, sf_dir, "pages")).select("page_id", "url", "title", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query(f"WITH {ANCHORS} SELECT * FROM links")
def s8_links(spark, sf_dir):
    return P.links(view(spark, sf_dir, "pages"))


@query(rf"""WITH parts AS (SELECT page_id, url, 'p' AS tag, unnest(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1)) AS html, generate_subscripts(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, url, tag, pos, md5({TEXT}) AS text_md5 FROM parts WHERE length({TEXT}) > 20""")
def s9_sections(spark, sf_dir):
    return P.sections(view(spark, sf_dir, "pages"), tags=("p",), distinct=False).select("page_id", "url", "tag", "pos", F.md5("text").alias("text_md5"))


W, E = "CAST(user_id AS STRING)", "CAST(event_id AS STRING)"
VIEWS["nest_x"] = f"""SELECT event_id AS page_id, '<html><body><div class="wrap content" id="top"><p>alpha ' || {W} || ' beta gamma delta</p><DIV class=''specials''>inner <b>deal</b> number ' || {E} || ' for all</DIV> tail of the outer part</div>'
 || '<section id=content>start of the section' || CASE WHEN event_id % 3 = 0 THEN '<section class="x content"><div>deep inside words ' || {E} || '</div></section>' ELSE '' END || ' and its end</section>'
 || '<!-- <div class="content">hidden words that are long</div> --><script>var a="<div class=content> more hidden words";</script><div>short</div><div>left open with long words ' || {W} || CASE WHEN event_id % 2 = 0 THEN '</div>' ELSE '' END || ' the end' AS html FROM {{events}}"""
VIEWS["nest_parts"] = "SELECT event_id, user_id FROM {events}"
NEST = f"""d AS (SELECT event_id AS page_id, 'alpha ' || {W} || ' beta gamma delta inner deal number ' || {E} || ' for all tail of the outer part' AS outer_text, 'inner deal number ' || {E} || ' for all' AS inner_text, 'deep inside words ' || {E} AS deep, event_id % 3 = 0 AS has_deep,
 'start of the section' || CASE WHEN event_id % 3 = 0 THEN ' deep inside words ' || {E} ELSE '' END || ' and its end' AS section, 'left open with long words ' || {W} || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' the end' END AS last_text FROM nest_parts),
r AS (SELECT page_id, '.content' AS selector, 0 AS pos, outer_text AS text FROM d UNION ALL SELECT page_id, '.content', 1, deep FROM d WHERE has_deep UNION ALL SELECT page_id, '#content', 0, section FROM d UNION ALL SELECT page_id, 'div.specials', 0, inner_text FROM d
 UNION ALL SELECT page_id, 'section', 0, section FROM d UNION ALL SELECT page_id, 'section', 1, deep FROM d WHERE has_deep
 UNION ALL SELECT page_id, 'div', 0, outer_text FROM d UNION ALL SELECT page_id, 'div', 1, inner_text FROM d UNION ALL SELECT page_id, 'div', 2, deep FROM d WHERE has_deep UNION ALL SELECT page_id, 'div', CASE WHEN has_deep THEN 4 ELSE 3 END, last_text FROM d)"""


@query(oracle(f"{NEST} SELECT page_id, selector, CAST(pos AS INT) AS pos, text FROM r WHERE length(text) > 20", "nest_parts"))
def s9_containers(spark, sf_dir):
    """Texts of elements by tag, class and id, with what is nested in them."""
    return P.containers(view(spark, sf_dir, "nest_x"), ("page_id",), (".content", "#content", "div.specials", "section", "div"))


@query(f"WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 'is') AS html FROM pages), t AS (SELECT page_id, {TEXT} AS text FROM a) SELECT page_id, md5(text) AS text_md5 FROM t WHERE length(text) > 20")
def s9_articles(spark, sf_dir):
    """The article of each web page."""
    return P.containers(view(spark, sf_dir, "pages"), ("page_id",), ("article",)).select("page_id", F.md5("text").alias("text_md5"))


REL = " + ".join(f"CASE WHEN regexp_matches(lower(url), '{p}') THEN 0.3 ELSE 0 END" for p in P.URL_PATTERNS)
HITS = lambda c, ps, w: " + ".join(f"CASE WHEN regexp_matches({c}, '(?i){p}') THEN {w} ELSE 0 END" for p in ps)
HAS = " + ".join(f"CASE WHEN contains(anchor_text, '{w}') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(url), '{w}') THEN 0.3 ELSE 0 END" for w in P.STRONG_TERMS)
MORE = " + ".join([f"CASE WHEN contains(anchor_text, '{w}') THEN {a} ELSE 0 END + CASE WHEN contains(lower(url), '{w}') THEN {b} ELSE 0 END" for ws, a, b in ((P.MENU_TERMS, 0.6, 0.4), (P.PRICE_TERMS, 0.4, 0.3)) for w in ws])
RELEVANCE = f"round(CAST(least(1.0, {REL} + {HITS('anchor_text', P.DEAL_PATTERNS, 0.4)} + {HITS('anchor_text', P.MENU_PATTERNS, 0.35)} + {HAS} + {MORE} + CASE WHEN lower(url) LIKE '%.pdf' THEN CASE WHEN regexp_matches(lower(url), 'menu|food|drink|price') THEN 0.8 ELSE 0.5 END ELSE 0 END) AS DOUBLE), 6)"


@query(f"WITH {ANCHORS} SELECT page_id, pos, url, {RELEVANCE} AS relevance FROM links")
def h21_link_relevance(spark, sf_dir):
    x = P.links(view(spark, sf_dir, "pages"))
    return x.select("page_id", "pos", "url", P.relevance(F.col("url"), F.col("anchor_text")).alias("relevance"))


@query(f"WITH {ANCHORS} SELECT page_id, pos, url FROM links WHERE {RELEVANCE} >= 0.3 OR regexp_matches(lower(anchor_text), 'menu|price|wine|deal') OR lower(url) LIKE '%.pdf'")
def p24_p25_link_work_list(spark, sf_dir):
    x = P.links(view(spark, sf_dir, "pages"))
    good = (P.relevance(F.col("url"), F.col("anchor_text")) >= 0.3) | F.lower("anchor_text").rlike("menu|price|wine|deal") | F.lower("url").endswith(".pdf")
    return x.filter(good).select("page_id", "pos", "url")


@query(rf"""SELECT page_id, list_aggregate(list_slice(list_sort(list_distinct(list_concat(regexp_extract_all(lower({TEXT}), 'th[a-z]+ '), regexp_extract_all(lower({TEXT}), 'und ')))), 1, 20), 'string_agg', ',') AS keywords FROM pages""")
def h23_l2_keywords(spark, sf_dir):
    x = P.page_text(view(spark, sf_dir, "pages"))
    return x.select("page_id", F.nullif(F.array_join(P.keywords(F.col("text"), ("th[a-z]+ ", "und ")), ","), F.lit("")).alias("keywords"))


@query(f"""SELECT page_id, length({TEXT}) < 1000 AND regexp_matches(lower({TEXT}), 'access denied|captcha|forbidden|are you a robot') AS is_blocked, length({TEXT}) < 300 AS is_thin,
 {N.format('html', '<script')} > {N.format('html', '<p[ >]')} AS is_script_shell FROM pages""")
def p26_page_flags(spark, sf_dir):
    x = view(spark, sf_dir, "pages").withColumn("text", P.visible_text(F.col("html")))
    return x.select("page_id", *P.page_flags(F.col("text"), F.col("html")))


@query(rf"""SELECT page_id, round(CAST(least(1.0, least({N.format('html', 'react|angular|vue|__next_data__|ng-app')} * 0.2, 0.4) + least({N.format('html', '<div[^>]*>[ \t\n\x0B\f\r]*</div>')} * 0.1, 0.3) + least({N.format('html', '<script')} * 0.05, 0.3)) AS DOUBLE), 6) AS score FROM pages""")
def p27_dynamic_score(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", P.dynamic_score(F.col("html")).alias("score"))


@query(rf"""WITH {ANCHORS}, h AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages WHERE page_id % 3 = 0)
SELECT page_id, pos, url FROM links WHERE regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') IN (SELECT host FROM h)""")
def j14_known_hosts(spark, sf_dir):
    pages = view(spark, sf_dir, "pages")
    known = pages.filter("page_id % 3 = 0").select(F.col("url").alias("website"))
    return P.of_known_hosts(P.links(pages), known).select("page_id", "pos", "url")


@query(f"""WITH RECURSIVE {ANCHORS}, e AS (SELECT DISTINCT source_url AS a, url AS b FROM links WHERE {RELEVANCE} > 0.3), s AS (SELECT min(url) AS node FROM pages GROUP BY lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))),
r(node, depth) AS (SELECT node, 0 FROM s UNION SELECT b, depth + 1 FROM r JOIN e ON e.a = r.node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def j16_reachable(spark, sf_dir):
    """Addresses within three relevant links of the first page of each host."""
    pages = view(spark, sf_dir, "pages")
    links = P.links(pages)
    edges = links.filter(P.relevance(F.col("url"), F.col("anchor_text")) > 0.3).select(F.col("source_url").alias("a"), F.col("url").alias("b")).distinct()
    seeds = pages.groupBy(F.lower(F.regexp_extract("url", "^https?://([^/:?#]+)", 1))).agg(F.min("url").alias("node"))
    return P.reachable(edges, seeds, 3)


@query(f"WITH {ANCHORS}, s AS (SELECT page_id, url, min(pos) AS pos, max({RELEVANCE}) AS score FROM links GROUP BY page_id, url) SELECT page_id, url, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS r FROM s) WHERE r <= 5")
def w9_best_links(spark, sf_dir):
    x = P.links(view(spark, sf_dir, "pages"))
    scored = x.groupBy("page_id", "url").agg(F.max(P.relevance(F.col("url"), F.col("anchor_text"))).alias("score"))
    return P.best_candidates(scored, "page_id", "score", "url", 5).select("page_id", "url", "score", "rank")


@query("""WITH k AS (SELECT url FROM pages), b AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS base FROM pages), p AS (SELECT * FROM (VALUES (0, '/menu'), (1, '/p/1'), (2, '/')) v(ord, path)),
f AS (SELECT base, arg_min(base || path, ord) AS found FROM (SELECT DISTINCT base FROM b) d, p WHERE base || path IN (SELECT url FROM k) GROUP BY base)
SELECT page_id, b.base, coalesce(found, b.base) AS url FROM b LEFT JOIN f ON f.base = b.base""")
def j18_repaired_urls(spark, sf_dir):
    pages = view(spark, sf_dir, "pages")
    base = pages.select("page_id", F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("base"))
    return P.repaired(base.select("base").distinct(), ("/menu", "/p/1", "/"), pages).join(base, "base").select("page_id", "base", "url")


@query(rf"""SELECT page_id, CASE WHEN regexp_matches(trim(url), '(?i)^https?://[^/?#]+') THEN 'https://' || lower(regexp_extract(trim(url), '(?i)^https?://([^/?#]+)', 1)) || regexp_replace(regexp_extract(trim(url), '(?i)^https?://[^/?#]+([^#]*)', 1), '/+$', '') END AS normal_url,
 regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages""")
def h41_urls(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", P.normal_url(F.col("url")).alias("normal_url"), P.host(F.col("url")).alias("host"))

"""Extraction from plain text, rules, page likelihood, relevance of deals and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealloom.functions import times as T
from dealloom.operators import pages as P
from dealloom.operators import profiles as R
from dealloom.operators import prose as X
from dealloom.operators import status as S
from dealloom.operators.rules import rule_errors
from dealloom.plans.deal_queries import DAY
from dealloom.plans.registry import query
from dealloom.plans.views import VIEWS, oracle, view

WEEKDAY = "CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday' WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' WHEN 6 THEN 'Sunday' ELSE 'today' END"
VIEWS["notice_x"] = f"""SELECT event_id AS seq, 'user-' || CAST(user_id % 40 AS STRING) AS slug,
 'Welcome to table ' || CAST(user_id AS STRING) || chr(10)
 || CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'Happy Hour ' || {WEEKDAY} || ' ' || CAST(1 + hour(ts) % 6 AS STRING) || ' - ' || CAST(3 + hour(ts) % 7 AS STRING) || ' pm' WHEN 1 THEN 'we pour 3pm to 6:30pm' WHEN 2 THEN 'daily specials for ' || event_type
    WHEN 3 THEN 'ask for deals on ' || {WEEKDAY} ELSE 'events and newsletter' END || chr(10)
 || CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '4:30pm-7 pm at the bar' WHEN 1 THEN CAST(7 + event_id % 4 AS STRING) || ' PM - Close' WHEN 2 THEN '3:00 - 6:00 and more' ELSE '' END || chr(10)
 || 'line four' || chr(10) || CASE WHEN event_id % 3 = 0 THEN 'brunch 10 am - 2 pm' ELSE 'ask inside' END || chr(10)
 || CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'Friday 9:00 am - 5:30 pm' WHEN 1 THEN 'about us: happy hour. Sunday: 10:15 am - 9:00 pm' WHEN 2 THEN 'Open 11:00 am - 9:00 pm' WHEN 3 THEN 'Kitchen hours: daily 11:30 am - 9:30 pm' WHEN 4 THEN 'Hours: 10:00 am - 8:00 pm' ELSE 'the end' END AS text
FROM {{events}}"""
MENTION = "(?i)Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|daily"
HAS_KEY = " OR ".join(f"contains(lower({{0}}), '{w}')" for w in X.KEYWORDS)
SECTIONS = f"""l AS (SELECT seq, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM notice_x),
c AS (SELECT seq, i, line, string_agg(line, chr(10)) OVER (PARTITION BY seq ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS section FROM l),
k AS (SELECT seq, i AS line, section FROM c WHERE {HAS_KEY.format('line')}),
s AS (SELECT * FROM k UNION ALL SELECT seq, 0, text FROM notice_x WHERE seq NOT IN (SELECT seq FROM k))"""


@query(oracle(f"{SECTIONS} SELECT seq, CAST(line AS INT) AS line, md5(section) AS section_md5 FROM s", "notice_x"))
def x3_w13_contexts(spark, sf_dir):
    return X.keyword_contexts(view(spark, sf_dir, "notice_x"), ("seq",)).select("seq", "line", F.md5("section").alias("section_md5"))


# Written by themselves: the forms as the view has them, each with its own parts.
SPANS = r"""list_concat(regexp_extract_all(section, '(?i)\d+(:\d\d)? ?([ap]m)? ?- ?\d+(:\d\d)? ?[ap]m'), regexp_extract_all(section, '(?i)\d+pm to \d+:\d\dpm'), regexp_extract_all(section, '\d:00 - \d:00 and'), regexp_extract_all(section, '\d+ PM - Close'))"""


@query(oracle(rf"""{SECTIONS},
t AS (SELECT seq, line, section, unnest({SPANS}) AS span FROM s),
d AS (SELECT seq, line, section, unnest(regexp_extract_all(section, '{MENTION}')) AS day FROM s),
j AS (SELECT t.seq, t.line, span, d.day, instr(t.section, span) - instr(d.section, d.day) AS gap, instr(d.section, d.day) AS place FROM t LEFT JOIN d ON d.seq = t.seq AND d.line = t.line),
n AS (SELECT seq, line, span, coalesce(arg_min(day, place) FILTER (gap BETWEEN 1 AND 20), arg_min(day, abs(gap) * 1000 + place) FILTER (abs(gap) <= 30), CASE WHEN bool_or(lower(day) = 'daily') THEN 'daily' END) AS day FROM j GROUP BY ALL),
p AS (SELECT seq, line, day, regexp_extract(span, '^[0-9:]+', 0) AS one, nullif(regexp_extract(span, '(?i)^[0-9:]+ ?([ap]m)', 1), '') AS half, CASE WHEN span LIKE '%Close' THEN 'Close' ELSE regexp_extract(span, '(?:-|to) ?([0-9:]+)', 1) END AS two, nullif(regexp_extract(span, '(?i)([ap]m)$', 1), '') AS late FROM n),
r AS (SELECT seq, line, one || ' ' || coalesce(half, late, 'pm') AS start_time, CASE WHEN two = 'Close' THEN two ELSE two || ' ' || coalesce(late, half, 'pm') END AS end_time, day FROM p
 UNION ALL SELECT seq, line, NULL, NULL, arg_min(day, instr(section, day)) FROM d WHERE (seq, line) NOT IN (SELECT seq, line FROM t) GROUP BY seq, line)
SELECT seq, start_time, end_time, day, CAST(min(line) AS INT) AS line FROM r GROUP BY ALL""", "notice_x"))
def x3_text_deals(spark, sf_dir):
    return X.text_deals(view(spark, sf_dir, "notice_x"), ("seq",))


NEAR = "substr(t, greatest(p - 50, 1), least(p - 1, 50) + length(m) + 50)"


# The opening hours of the view's last line, as they stand there.
LAST = "CASE CAST(seq % 7 AS INT) WHEN 0 THEN 'Friday 9:00 am - 5:30 pm' WHEN 1 THEN 'Sunday: 10:15 am - 9:00 pm' WHEN 2 THEN 'Open 11:00 am - 9:00 pm' WHEN 3 THEN 'Kitchen hours: daily 11:30 am - 9:30 pm' WHEN 4 THEN 'Hours: 10:00 am - 8:00 pm' ELSE '' END"


@query(oracle(rf"""c AS (SELECT seq, regexp_replace(text, '{'|'.join(X.NOISE)}', '', 'gi') AS t FROM notice_x),
e AS (SELECT seq, t, {LAST} AS m, instr(t, {LAST}) AS p FROM c)
SELECT seq, md5(trim(CASE WHEN m <> '' AND NOT ({HAS_KEY.format(NEAR)}) THEN replace(t, m, '') ELSE t END, ' ')) AS text_md5 FROM e""", "notice_x"))
def p20_guarded_noise(spark, sf_dir):
    """Opening hours go unless a keyword is near."""
    return view(spark, sf_dir, "notice_x").select("seq", F.md5(X.without_noise(F.col("text"))).alias("text_md5"))


VIEWS["priced_x"] = """SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos,
 CASE CAST(l_orderkey % 4 AS INT) WHEN 0 THEN 'food' WHEN 1 THEN 'cocktails' WHEN 2 THEN 'beer_wine' ELSE 'general' END AS section,
 CASE CAST((l_partkey + l_linenumber) % 15 AS INT)
  WHEN 0 THEN '$' || CAST(CAST(l_quantity AS INT) AS STRING) || ' craft cocktails' WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || '% off ' || p_name
  WHEN 2 THEN '$' || CAST(CAST(l_quantity AS INT) AS STRING) || ' glass of wine' WHEN 3 THEN '$' || CAST(CAST(l_quantity AS INT) AS STRING) || '.50 ' || p_name || ' martini'
  WHEN 4 THEN '$' || CAST(CAST(l_quantity AS INT) AS STRING) || ' ' || p_name || ' oysters' WHEN 5 THEN '$' || CAST(CAST(l_quantity AS INT) AS STRING) || '-$' || CAST(CAST(l_quantity + 6 AS INT) AS STRING) || ' ' || p_name
  WHEN 6 THEN upper(p_name) || ' with salt   ' || CAST(CAST(l_quantity AS INT) AS STRING) WHEN 7 THEN upper(p_name) || ' in butter — $' || CAST(CAST(l_quantity AS INT) AS STRING)
  WHEN 8 THEN upper(p_name) || ' — $' || CAST(CAST(l_quantity AS INT) AS STRING) || '.25' WHEN 9 THEN '$' || CAST(CAST(l_quantity AS INT) AS STRING) || ' each'
  WHEN 10 THEN upper(p_name) || ' from the grill $' || CAST(CAST(l_quantity AS INT) AS STRING) WHEN 11 THEN '$' || CAST(CAST(l_quantity AS INT) AS STRING) || ' ' || upper(p_name)
  WHEN 12 THEN upper(p_name) || '  ' || CAST(CAST(l_quantity AS INT) AS STRING) WHEN 13 THEN 'expertly crafted ' || p_name || ' for $' || CAST(CAST(l_quantity AS INT) AS STRING)
  ELSE 'Half off order of ' || p_name END AS line
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


def _priced_sql() -> str:
    each = []
    for k, (pattern, title, one, two, description) in enumerate(X.PRICED, 1):
        p = "(?i)" + pattern.replace("'", "''")
        part = lambda g, p=p: f"trim(regexp_extract(m, '{p}', {g}))" if g else "NULL::VARCHAR"
        each.append(f"SELECT doc, pos, section, {k} AS form, {part(title)} AS title, {part(one)} AS one, {part(two)} AS two, nullif({part(description)}, '') AS description FROM (SELECT doc, pos, section, unnest(regexp_extract_all(trim(line), '{p}')) AS m FROM priced_x WHERE length(trim(line)) >= 5)")
    words = lambda ws: " OR ".join(f"contains(w, '{x}')" for x in ws)
    return f"""f AS ({' UNION ALL '.join(each)}), g AS (SELECT *, regexp_matches(one, '(?i)%|half') AS share, try_cast(one AS DOUBLE) AS x, try_cast(two AS DOUBLE) AS y, lower(concat_ws(' ', title, description)) AS w FROM f)
SELECT doc, pos, form, title, description, CASE WHEN share THEN one WHEN two IS NOT NULL THEN '$' || one || '-$' || two ELSE '$' || one END AS price,
 CASE WHEN section = 'food' THEN 'food' WHEN section IN ('cocktails', 'drinks', 'beer_wine') THEN 'drink' WHEN {words(X.DRINK_WORDS)} THEN 'drink' WHEN {words(X.FOOD_WORDS)} THEN 'food' ELSE 'unknown' END AS kind
FROM g WHERE (share OR (x >= 3 AND coalesce(y, x) <= 50)) AND length(title) >= 3 AND NOT regexp_matches(lower(title), 'minimum|each|order')"""


@query(oracle(_priced_sql(), "priced_x"))
def x7_priced_forms(spark, sf_dir):
    return X.priced_forms(view(spark, sf_dir, "priced_x"), ("doc", "pos"), "line", "section")


RULES = r"""SELECT 'user-' || CAST(s_suppkey AS STRING) AS slug, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE s_name END AS name,
 CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE '(\\d\\d?)(?::\\d\\d)? ?(am|pm)? ?- ?(\\d\\d?)(?::\\d\\d)? ?(am|pm)?' END AS time_pattern,
 CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN '(monday|friday)' WHEN 1 THEN '[a-z]+day' ELSE '(sunday' END AS day_pattern,
 CASE WHEN s_suppkey % 2 = 0 THEN 'brunch [^\\n]*' END AS exclude
FROM {supplier}"""
VIEWS["rule_x"] = RULES


@query(oracle("SELECT slug, concat_ws(';', CASE WHEN name = '' THEN 'Missing required field: name' END, CASE WHEN day_pattern = '(sunday' THEN 'Invalid regex in day_pattern' END) AS errors FROM rule_x", "rule_x").replace("\\\\", "\\"))
def s5_rule_errors(spark, sf_dir):
    return rule_errors(view(spark, sf_dir, "rule_x")).select("slug", F.array_join("errors", ";").alias("errors"))


@query(oracle(r"""k AS (SELECT * REPLACE (coalesce(time_pattern, '(x)(x)(x)(x)\bnone') AS time_pattern) FROM rule_x WHERE day_pattern <> '(sunday'),
b AS (SELECT n.seq, k.time_pattern AS tp, k.day_pattern AS dp, CASE WHEN exclude IS NULL THEN text ELSE regexp_replace(text, 'brunch [^\n]*', '', 'gi') END AS body FROM notice_x n JOIN k ON k.slug = n.slug),
a AS (SELECT seq, CASE WHEN tp LIKE '(x)%' THEN []::VARCHAR[] ELSE regexp_extract_all(body, '(?i)(\d\d?)(?::\d\d)? ?(am|pm)? ?- ?(\d\d?)(?::\d\d)? ?(am|pm)?') END AS spans,
 CASE WHEN dp LIKE '(m%' THEN regexp_extract_all(body, '(?i)(monday|friday)') ELSE regexp_extract_all(body, '(?i)[a-z]+day') END AS days FROM b),
u AS (SELECT seq, unnest(spans) AS s, array_to_string(days, ',') AS days FROM a UNION ALL SELECT seq, NULL, array_to_string(days, ',') FROM a WHERE len(spans) = 0 AND len(days) > 0),
g AS (SELECT seq, days, s, regexp_extract(s, '(?i)(\d\d?)(?::\d\d)? ?(am|pm)? ?- ?(\d\d?)(?::\d\d)? ?(am|pm)?', ['h1', 'a1', 'h2', 'a2']) AS x FROM u)
SELECT seq, CASE WHEN s IS NOT NULL THEN x.h1 || ' ' || upper(coalesce(nullif(x.a1, ''), nullif(x.a2, ''), 'pm')) END AS start_time, CASE WHEN s IS NOT NULL THEN x.h2 || ' ' || upper(coalesce(nullif(x.a2, ''), 'pm')) END AS end_time, days FROM g""", "notice_x", "rule_x").replace("\\\\", "\\"))
def x4_ruled_deals(spark, sf_dir):
    return X.ruled_deals(view(spark, sf_dir, "notice_x"), view(spark, sf_dir, "rule_x"), ("seq",))


VIEWS["site_x"] = """SELECT event_id AS page_id,
 'https://s' || CAST(user_id % 40 AS STRING) || '.example.com/' || CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'chef-menu' WHEN 1 THEN 'about' WHEN 2 THEN 'Lunch' WHEN 3 THEN 'card.PDF' WHEN 4 THEN 'contact' ELSE 'x' END AS url,
 CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'Our seasonal menu' WHEN 1 THEN 'Desserts' WHEN 3 THEN 'Happy Hour' WHEN 4 THEN NULL ELSE 'Home' END AS title,
 CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'Appetizers and entrées' WHEN 1 THEN 'Beverage list, mains' WHEN 2 THEN 'Chef''s menu' WHEN 3 THEN 'late night' ELSE 'words' END
 || CASE WHEN event_id % 11 = 0 THEN ' for $' || CAST(CAST(value AS INT) AS STRING) || ' each, market price' ELSE ' and so on' END || CASE WHEN event_id % 13 = 0 THEN ' on Monday 3 pm' ELSE '' END AS text
FROM {events}"""


def _likelihood_sql() -> str:
    count = lambda ps, w: " + ".join(f"len(regexp_extract_all(text, '(?i){p}')) * {w}" for p in ps)
    hits = lambda c, ps, w: " + ".join(f"CASE WHEN regexp_matches({c}, '(?i){p}') THEN {w} ELSE 0 END" for p in ps)
    return f"""SELECT page_id, round(CAST(least(1.0, {count(P.DEAL_PATTERNS, 0.2)} + {count(P.MENU_PATTERNS, 0.15)} + {count(P.PRICE_PATTERNS, 0.25)} + {hits('lower(url)', P.URL_PATTERNS, 0.3)} + {hits("lower(coalesce(title, ''))", (*P.DEAL_PATTERNS, *P.MENU_PATTERNS), 0.4)}
 + (len(regexp_extract_all(text, '(?i)\\d{{1,2}}\\s*(?::\\d{{2}})?\\s*(?:am|pm)')) + len(regexp_extract_all(text, '(?i)monday|tuesday|wednesday|thursday|friday|saturday|sunday'))) * 0.1 + CASE WHEN lower(url) LIKE '%.pdf' THEN 0.5 ELSE 0 END) AS DOUBLE), 6) AS likelihood FROM site_x"""


@query(oracle(_likelihood_sql(), "site_x"))
def h20_likelihood(spark, sf_dir):
    return view(spark, sf_dir, "site_x").select("page_id", P.likelihood(F.col("text"), F.col("url"), F.col("title")).alias("likelihood"))


MINUTES = "CASE WHEN raw_start IS NULL THEN NULL ELSE hour(extracted_at) * 60 END"
OFFER = " OR ".join(f"contains(lower(raw_title || ' ' || raw_description), '{w}')" for w in S.OFFER_WORDS)


@query(oracle(f"""d AS (SELECT slug, seq, {DAY.format('raw_day')} = 'wednesday' AS today, raw_description LIKE '%all day%' AS whole, {MINUTES} AS a, ({MINUTES} + 180) % 1440 AS b, confidence_score AS c, {OFFER} AS offer FROM raw_x),
s AS (SELECT slug, seq, round(CAST(100 + CASE WHEN whole THEN 50 WHEN a IS NULL THEN 0 WHEN 1000 BETWEEN a AND CASE WHEN b < a THEN b + 1440 ELSE b END THEN 150 WHEN 1000 < a AND a - 1000 <= 120 THEN 75 WHEN 1000 < a AND a - 1000 <= 360 THEN 25 ELSE 0 END
 + CASE WHEN offer THEN 25 ELSE 0 END + c * 20 AS DOUBLE), 6) AS relevance FROM d WHERE c >= 0.25 AND (today OR c < 0.5))
SELECT slug, seq, relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY relevance DESC, seq) AS rank FROM s) WHERE rank <= 3""", "raw_x"))
def w5_relevant_now(spark, sf_dir):
    """The best three deals of each restaurant on a Wednesday at 16:40."""
    x = view(spark, sf_dir, "raw_x")
    minutes = F.when(F.col("raw_start").isNotNull(), F.hour("extracted_at") * 60)
    deals = x.select(
        "slug", "seq", F.array(T.day_name(F.col("raw_day"))).alias("days"), F.col("raw_description").contains("all day").alias("is_all_day"), minutes.alias("start_minute"), F.pmod(minutes + 180, F.lit(1440)).alias("end_minute"),
        F.col("raw_title").alias("title"), F.col("raw_description").alias("description"), "confidence_score",
    )
    return S.relevant_now(deals, "wednesday", 1000).select("slug", "seq", "relevance", "rank")


VIEWS["attempt_x"] = """SELECT 'user-' || CAST(s_suppkey AS STRING) AS slug, s_name AS name,
 CASE WHEN s_acctbal < 0 THEN 'robots_txt' WHEN s_suppkey % 5 = 0 THEN 'timeout' WHEN s_suppkey % 7 = 0 THEN 'not_found' WHEN s_suppkey % 11 = 0 THEN '' END AS last_failure_reason
FROM {supplier}"""


@query(oracle("""f AS (SELECT last_failure_reason AS reason, name, row_number() OVER (PARTITION BY last_failure_reason ORDER BY name) AS r FROM attempt_x WHERE last_failure_reason <> '')
SELECT reason, count(*) AS n, string_agg(name, ',' ORDER BY name) FILTER (r <= 5) AS examples FROM f GROUP BY reason""", "attempt_x"))
def a31_failure_reasons(spark, sf_dir):
    return S.failure_reasons(view(spark, sf_dir, "attempt_x"), "last_failure_reason", "name")


@query(oracle("""SELECT 'rows' AS counter, count(*) AS n FROM raw_x UNION ALL SELECT 'no_title', count(*) FILTER (raw_title = '') FROM raw_x
UNION ALL SELECT 'unsure', count(*) FILTER (confidence_score < 0.5) FROM raw_x UNION ALL SELECT 'without_time', count(*) FILTER (raw_start IS NULL) FROM raw_x""", "raw_x"))
def a10_run_counters(spark, sf_dir):
    """Counters of a run, observed while its rows are written."""
    from dealloom.sources.tables import counters

    seen, read = counters(view(spark, sf_dir, "raw_x"), {"no_title": F.col("raw_title") == "", "unsure": F.col("confidence_score") < 0.5, "without_time": F.col("raw_start").isNull()})
    seen.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted(read().items()), "counter string, n long")


@query(oracle("""c AS (SELECT count(*) AS n, count(*) FILTER (website IS NOT NULL AND NOT regexp_matches(website, 's[0-9]+[02468]\\.')) AS website, count(*) FILTER (phone IS NOT NULL AND NOT regexp_matches(phone, '[13579]$')) AS phone FROM restaurant_x)
SELECT 'website' AS field, website AS n FROM c UNION ALL SELECT 'phone', phone FROM c""", "restaurant_x").replace("\\\\", "\\"))
def p8_issue_counts(spark, sf_dir):
    """How many values each check made null."""
    from dealloom.operators import quality as Q

    x = view(spark, sf_dir, "restaurant_x").select("slug", "website", "phone")
    _, counts = Q.with_invalid_nulled(x, {"website": F.col("website").rlike(r"s[0-9]+[02468]\."), "phone": F.col("phone").rlike("[13579]$")})
    return counts.unpivot([], ["website", "phone"], "field", "n")


VIEWS["focus_x"] = VIEWS["notice_x"].replace("END AS text", """END
 || chr(10) || CASE CAST(user_id % 6 AS INT) WHEN 0 THEN 'Our patio is romantic! Book at resy.com/user' || CAST(user_id AS STRING) WHEN 1 THEN 'Kids eat free. Trivia and live music' WHEN 2 THEN 'Reserve on OpenTable. A refined garden? Yes'
    WHEN 3 THEN 'Summer discount. Birthday offer' WHEN 4 THEN 'market price' ELSE '' END
 || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'Draft beer $' || CAST(3 + event_id % 48 AS STRING) || ' - house pour' || chr(10) || '$' || CAST(user_id % 90 AS STRING) || '.50 oysters. Happy hour at $4' ELSE '' END AS text,
 CASE WHEN user_id % 5 = 0 THEN array('https://www.resy.com/a', 'https://tock.com/' || CAST(user_id AS STRING), '/menu') END AS links""")


def _held(words, text="low"):
    """SQL of the list of words that a text holds."""
    return f"list_filter([{', '.join(map(repr, words))}], lambda w: contains({text}, w))"


def _some(words):
    return "(" + " OR ".join(f"contains(low, {w!r})" for w in words) + ")"


@query(oracle(rf"""b AS (SELECT seq, text, lower(text) AS low, links FROM focus_x),
p AS (SELECT *, regexp_extract_all(text, '{R.PRICED_ITEM}', 1) AS price, regexp_extract_all(text, '{R.PRICED_ITEM}', 2) AS item,
 CASE {' '.join(f"WHEN {_some(w)} THEN '{k}'" for k, w in R.PRICE_WORDS.items())} END AS price_range,
 {', '.join(f"array_to_string({_held(w)}, ',') AS {k}" for k, w in R.EVENT_WORDS.items())},
 concat_ws(',', {', '.join(f"CASE WHEN {_some(w)} THEN '{k}' END" for k, w in R.MOOD_WORDS.items())}) AS atmosphere,
 array_to_string(list_transform(regexp_extract_all(low, '{R.HAPPY_PRICE}', 1), lambda x: '$' || x), ',') AS happy_prices,
 array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: contains(lower(x), 'happy hour'))[1:3], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), '|') AS context,
 array_to_string({_held(R.DEAL_WORDS)}, ',') AS deal_types,
 {' + '.join(f"len(list_filter(coalesce(links, []), lambda x: contains(x, '{s}')))" for s in R.SERVICES)} AS n_links,
 {' + '.join(f"CAST(contains(low, '{s}') AS INT) + CAST(regexp_matches(low, '{s}[.]com/[^/[:space:]]') AS INT)" for s in R.SERVICES)} AS n_named FROM b)
SELECT seq, CAST(least(len(price), 10) AS INT) AS n_prices, '$' || price[1] AS first_price, regexp_replace(item[1], '^\s+|\s+$', '', 'g') AS first_item, price_range, {', '.join(R.EVENT_WORDS)}, atmosphere, happy_prices, md5(context) AS context_md5, deal_types,
 CAST(n_links + n_named + CAST(len(price) > 0 AS INT) + CAST(price_range IS NOT NULL AS INT) + CAST({' || '.join(R.EVENT_WORDS)} <> '' AS INT) + CAST(atmosphere <> '' AS INT)
  + CAST(contains(low, 'happy hour') AS INT) + CAST(contains(low, 'happy hour') OR deal_types <> '' AS INT) AS INT) AS fields_extracted FROM p""", "focus_x").replace("array('https", "list_value('https"))
def x12_deal_focus(spark, sf_dir):
    out = R.deal_focus(view(spark, sf_dir, "focus_x"), links="links")
    joined = lambda c, by=",": F.array_join(c, by)
    first = F.try_element_at("menu_pricing", F.lit(1))
    return out.select(
        "seq", F.size("menu_pricing").alias("n_prices"), first["price"].alias("first_price"), first["item"].alias("first_item"), "price_range", *(joined(f"special_events.{k}").alias(k) for k in R.EVENT_WORDS),
        joined("atmosphere").alias("atmosphere"), joined("happy_hour_prices").alias("happy_prices"), F.md5(joined("happy_hour_context", "|")).alias("context_md5"), joined("deal_types").alias("deal_types"), "fields_extracted",
    )

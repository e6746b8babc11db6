"""Views derived from the driver tables, in SQL text that Spark and DuckDB both take; {name} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW_X = """SELECT event_id AS seq, 'user-' || CAST(user_id % 40 AS STRING) AS slug,
 CASE event_type WHEN 'view' THEN 'Happy Hour' WHEN 'click' THEN 'Time: Late Night' WHEN 'purchase' THEN 'Weekend Brunch'
                 WHEN 'signup' THEN 'Taco Night' ELSE '' END AS raw_title,
 CASE WHEN event_id % 7 = 0 THEN 'all day $5 beer' ELSE event_type || ' special' END AS raw_description,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END AS STRING)
   || CASE WHEN hour(ts) < 12 THEN ' am' ELSE ' pm' END END AS raw_start,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(CASE WHEN (hour(ts)+3) % 12 = 0 THEN 12 ELSE (hour(ts)+3) % 12 END AS STRING)
   || CASE WHEN (hour(ts)+3) % 24 < 12 THEN ' am' ELSE ' pm' END END AS raw_end,
 CASE (day(ts)-1) % 7 WHEN 0 THEN 'mon' WHEN 1 THEN 'Tue' WHEN 2 THEN 'wed' WHEN 3 THEN 'Thursday' WHEN 4 THEN 'fri'
                      WHEN 5 THEN 'sat' ELSE 'sunday' END AS raw_day,
 '$' || CAST(3 + event_id % 48 AS STRING)
   || CASE event_id % 3 WHEN 0 THEN ' draft beer' WHEN 1 THEN ' house wine' ELSE ' oyster plate' END AS raw_price,
 CAST(event_id % 11 AS DOUBLE) / 10 AS confidence_score,
 CASE WHEN event_id % 2 = 0 THEN 'universal_html_section' ELSE 'pdf_section_analysis' END AS extraction_method,
 'https://s' || CAST(user_id % 40 AS STRING) || '.example.com/p' || CAST(event_id % 4 AS STRING) AS source_url,
 ts AS extracted_at, value
FROM {events}"""
MENU_X = """SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos,
 'user-' || CAST(l_orderkey % 40 AS STRING) AS slug,
 CASE l_orderkey % 5 WHEN 0 THEN 'happy_hour' WHEN 1 THEN 'brunch' WHEN 2 THEN 'lunch' WHEN 3 THEN 'wine' ELSE 'dinner' END AS menu_type,
 CASE WHEN l_linenumber = 1 THEN 'Starters' ELSE p_name || ' $' || CAST(CAST(3 + l_quantity AS INT) AS STRING) END AS line
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
RESTAURANT_X = """SELECT s_suppkey, 'user-' || CAST(s_suppkey AS STRING) AS slug, s_name AS name, n_name AS district, r_name AS metro,
 CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '1-303-555-' || substr(CAST(10000 + s_suppkey AS STRING), 2, 4) END AS phone,
 CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'http://www.s' || CAST(s_suppkey AS STRING) || '.example.com/menu/' END AS website,
 CASE s_suppkey % 5 WHEN 0 THEN 'Steakhouse' WHEN 1 THEN 'Italian' WHEN 2 THEN 'American' WHEN 3 THEN 'Mediterranean' ELSE NULL END AS cuisine,
 s_acctbal
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
OVERLAY_X = """SELECT 'user-' || CAST(c_custkey AS STRING) AS slug, CASE WHEN c_custkey % 2 = 0 THEN '(720) 555-0100' END AS phone,
 CASE WHEN c_custkey % 9 = 0 THEN 'https://new' || CAST(c_custkey AS STRING) || '.example.com' END AS website, c_acctbal AS rating_src
FROM {customer} WHERE c_custkey % 3 = 0"""
VIEWS = {"raw_x": RAW_X, "menu_x": MENU_X, "restaurant_x": RESTAURANT_X, "overlay_x": OVERLAY_X}


def tables_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a driver table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_in(sql)})


def oracle(body: str, *names: str) -> str:
    """body after WITH clauses for the named views; body may begin with more clauses ("x AS (...), ... SELECT")."""
    heads = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names]
    body = body.strip()
    if not heads:
        return body if body.upper().startswith(("SELECT", "WITH")) else f"WITH {body}"
    return f"WITH {', '.join(heads)}" + (" " if body.upper().startswith("SELECT") else ", ") + body

"""Duplicate deals of a restaurant: clusters, representatives and what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealloom.functions import deals as D
from dealloom.functions import times as T


def cleaned(deals: DataFrame) -> DataFrame:
    """Trimmed titles, confidence within 0 and 1, days in lower case without repeats."""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return deals.withColumns({
        "title": tidy(F.col("title")), "confidence_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence_score", F.lit(0.5)))),
        "days": F.array_distinct(F.transform("days", lambda d: F.lower(F.trim(d)))),
    })


def with_reject(deals: DataFrame) -> DataFrame:
    """The reason why a deal is refused: no title, or no restaurant; null for valid deals."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return deals.withColumn("reject", F.when(blank("title"), "no_title").when(blank("restaurant_slug"), "no_slug"))


def signed(deals: DataFrame, include_days: bool = False) -> DataFrame:
    """Cluster keys and the score as a representative."""
    times = T.time_signature(F.col("start_time"), F.col("end_time"), F.col("is_all_day"))
    key = F.when(F.col("description") != "", D.content_key(F.col("description")))
    has_time = (F.col("start_time") != "") & (F.col("end_time") != "")
    score = D.representative_score(F.col("confidence_score"), has_time, F.size("days") > 0, F.length("source_text"), F.col("extraction_method") == "universal_html_section")
    days = T.day_signature(F.col("days"))
    return deals.withColumns({"time_signature": F.concat_ws("|", times, days) if include_days else times, "day_signature": days, "content_key": key, "score": F.round(score, 9)})


def consolidated(keyed: DataFrame) -> DataFrame:
    """Deals that are the best of their time cluster and, with a description, of their content group.

    The best of each cluster come from max_by aggregations, which combine on the map side, so a
    restaurant with most of the deals is no hot window. The best of a time cluster is carried as a whole
    row, so only these few rows are joined.
    """
    order = F.struct(F.col("score"), (-F.col("seq")).alias("early"))
    best = keyed.groupBy("restaurant_slug", "time_signature").agg(F.max_by(F.struct(*keyed.columns), order).alias("k")).select("k.*")
    best_text = keyed.filter("content_key IS NOT NULL").groupBy("restaurant_slug", "content_key").agg(F.max_by("seq", order).alias("best_text"))
    out = best.join(best_text, ["restaurant_slug", "content_key"], "left").filter(F.col("content_key").isNull() | (F.col("seq") == F.col("best_text")))
    return out.select(keyed.columns)


def best_of(keyed: DataFrame, *by: str) -> DataFrame:
    """seq and score of the best row of each cluster, the earliest at ties."""
    order = F.struct(F.col("score"), (-F.col("seq")).alias("early"))
    best = keyed.groupBy(*by).agg(F.max_by(F.struct("seq", "score"), order).alias("b"), F.count("*").alias("n"))
    return best.select(*by, F.col("b.seq").alias("representative"), F.col("b.score").alias("score"), "n")


def group_similarity(keyed: DataFrame, parity: bool = False) -> DataFrame:
    """Likeness of the deals of a restaurant: few distinct times and days, little spread of confidence.

    parity keeps the formula that rises with more distinct signatures.
    """
    out = keyed.groupBy("restaurant_slug").agg(F.count("*").alias("n"), F.countDistinct("time_signature").alias("times"), F.countDistinct("day_signature").alias("days"), (F.max("confidence_score") - F.min("confidence_score")).alias("spread"))
    share = lambda c: F.col(c) / F.col("n") if parity else 1 - F.col(c) / F.col("n")
    return out.select("restaurant_slug", "n", F.round(0.4 * share("times") + 0.4 * share("days") + 0.2 * (1 - F.col("spread")), 6).alias("similarity"))


def extraction_quality(keyed: DataFrame, after: DataFrame) -> DataFrame:
    """0.5 mean confidence + 0.3 share of sure rows - 0.2 share of duplicates, within 0 and 1."""
    a = keyed.groupBy("restaurant_slug").agg(F.count("*").alias("n"), F.avg("confidence_score").alias("mean"), F.avg(F.when(F.col("confidence_score") >= 0.8, 1.0).otherwise(0.0)).alias("sure"))
    b = after.groupBy("restaurant_slug").agg(F.count("*").alias("kept"))
    out = a.join(b, "restaurant_slug", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    value = 0.5 * F.col("mean") + 0.3 * F.col("sure") - 0.2 * (1 - F.col("kept") / F.col("n"))
    return out.select("restaurant_slug", "n", "kept", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6).alias("quality"))


def first_of_each(rows: DataFrame, *by: str, order: str = "seq") -> DataFrame:
    """Exact duplicates by the columns in by: the row that comes first stays."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter("_r = 1").drop("_r")

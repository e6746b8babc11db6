"""Displays of deals with answers by hand."""

import pytest
from pyspark.sql import functions as F

from dealloom.operators import display as X

DEALS = "slug string, title string, description string, days array<string>, start string, end string, all_day boolean, prices array<string>, confidence double, title_of string"


def groups(spark, rows):
    out = X.display_groups(spark.createDataFrame([(*r, "clash") for r in rows], DEALS))
    return {(r.slug, r.group, r.line, r.confidence, r.group_confidence, r.n_deals) for r in out.collect()}


def test_price_of_an_only_deal_stands_with_its_hours(spark):
    one = ("a", "Happy Hour", "$5 beer", ["fri"], "3 pm", "6 pm", False, ["$5 beer"], 0.5)
    assert groups(spark, [one]) == {("a", "Happy Hours", "Fri: 3 pm - 6 pm - $5 beer", 0.5, 0.5, 1)}
    two = ("a", None, None, None, None, None, None, None, None)
    assert groups(spark, [one, two]) == {("a", "Happy Hours", "Fri: 3 pm - 6 pm - $5 beer", 0.5, 0.5, 1), ("a", "Friday Specials", "$5 beer", 0.5, 0.5, 1)}


def test_repeated_rows_null_keys_and_default_lines(spark):
    rows = [(None, "Wine Dinner", "special", ["mon"], None, None, None, None, 0.2)] * 3 + [(None, "Wine Dinner", "", ["Monday"], None, None, False, None, 0.4), ("b", "Off hours", "", None, "3 pm", None, False, None, 0.9)]
    assert groups(spark, rows) == {
        (None, "Happy Hours", "Mon: Happy Hour", 0.4, 0.4, 1), (None, "Monday Specials", X.NO_OFFER, 0.4, 0.4, 4), ("b", "Special Offers", X.NO_OFFER, 0.9, 0.9, 1),
    }
    assert groups(spark, []) == set()


@pytest.mark.parametrize(
    "text, left",
    [
        (None, ""), ("", ""), ("Half off every Friday, all day", "Half off"), ("wine 3pm - 6pm friday and more", "wine and more"), ("3:00 pm-6:30 PM", ""), ("beer 3pm - 6pm", "beer 3pm - 6pm"),
        ("x‍y  z", "x y z"), ("tacos on Monday", "tacos on"), ("Monday", "Monday"), ("word " * 20000, ("word " * 20000).strip()),
    ],
)
def test_descriptions(spark, text, left):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.without_schedule(F.col("t"))).first()[0] == left


def test_titles(spark):
    rows = [
        ("Happy Hour", "sushi and wine", ["fri"], None, None, False), ("Taco Night", "wine", [], None, None, False), ("TIME-BASED special", "", ["sat", "sun"], "3 pm", "6 pm", None), ("happy hour", None, None, None, None, True),
        ("happy hour", None, ["mon"], "3 pm", "", False), (None, "beer", None, None, None, None),
    ]
    parts = [F.col(c) for c in ("title", "text", "days", "start", "end", "all_day")]
    out = spark.createDataFrame(rows, "title string, text string, days array<string>, start string, end string, all_day boolean").select(X.display_title(*parts).alias("t"), X.group_title(*parts[2:]).alias("g")).collect()
    assert [r.t for r in out] == ["Sushi Specials", "Taco Night", "Weekend Happy Hour", "All-Day Happy Hour", "Special Offers", None]
    assert [r.g for r in out] == ["Friday Special", "Special Offer", "Weekend 3 pm - 6 pm", "All Day Special", "Monday Special", "Special Offer"]


def test_user_schedules(spark):
    rows = [({}, ["mon"], ["3-6 pm"]), (None, None, None), ({"sat_sun": "1-4 pm"}, ["mon"], ["3-6 pm"]), (None, None, ["3-6 pm"])]
    df = spark.createDataFrame(rows, "c map<string,string>, d array<string>, t array<string>")
    weekly, summary = X.user_schedule(F.col("c"), F.col("d"), F.col("t"))
    out = df.select(weekly.alias("w"), summary.alias("s")).collect()
    assert [r.s for r in out] == ["Monday • 3:00 PM - 6:00 PM", X.NO_SUMMARY, "Saturday, Sunday • 1-4 pm", " • 3:00 PM - 6:00 PM"]
    assert [[(x.days, x.times) for x in r.w] for r in out] == [[(["Monday"], ["3:00 PM - 6:00 PM"])], [], [(["Saturday", "Sunday"], ["1-4 pm"])], [([], ["3:00 PM - 6:00 PM"])]]


def test_summary_takes_the_last_page_with_prices(spark):
    rows = [("a", 1, "food", "$4", "x", "mon", None, 0.3), ("a", 2, "food", "$6.50", None, None, "bar", 0.9), ("a", 2, "food", "$7", "y", "mon", None, 0.9), ("a", 3, "drink", "free", None, None, None, 0.1), (None, 1, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "slug string, page int, kind string, price string, timeframe string, day string, restriction string, confidence double")
    out = {r.slug: tuple(r)[1:] for r in X.deals_summary(df).collect()}
    assert out == {"a": (4, 3, 1, ["x", "y"], ["mon"], ["bar"], 6.75, 0.0, 0.1), None: (1, 0, 0, [], [], [], 0.0, 0.0, None)}

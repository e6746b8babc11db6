"""What is searched or read of a text is searched and read once: counts of the expressions in the plans, and answers by hand."""

import re

from pyspark.sql import functions as F

from dealloom.functions import times as T
from dealloom.functions.arrays import running_sums
from dealloom.operators import pages as P
from dealloom.operators import prose as X
from dealloom.operators.extract import matches
from dealloom.sources import guide as G


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shown_times_read_the_text_once(spark):
    df = spark.createDataFrame([("3pm",), ("7",), ("13:05",), ("12:30 AM",), ("25:00",), ("soon",), (None,), ("13pm",)], "t string")
    got = df.select(F.transform(F.array("t"), T.shown_time)[0])
    assert [r[0] for r in got.collect()] == ["3:00 PM", "7:00 PM", "1:05 PM", "12:30 AM", "25:00", "soon", None, "13pm"]
    assert len(re.findall("regexp_extract", plan(got))) <= 12


def test_matches_with_marks_in_the_text(spark):
    df = spark.createDataFrame([("a1 b22",), ("none",), ("",), (None,), ("\u00011\u0002x 3",), ("\u0001\u0002",), ("9" * 3 + " x" * 200 + " 7",)], "t string")
    got = [[tuple(m) for m in r[0]] for r in df.select(matches(F.col("t"), r"\d+")).collect()]
    assert got == [[(1, "1"), (4, "22")], [], [], [], [(1, "1"), (5, "3")], [], [(0, "999"), (404, "7")]]
    sums = spark.createDataFrame([([1] * 64,), ([2] * 65,), ([],), (None,)], "v array<int>").select(running_sums(F.col("v"))).collect()
    assert [r[0] for r in sums] == [list(range(1, 65)), list(range(2, 131, 2)), [], []]


def test_noise_is_removed_once(spark):
    df = spark.createDataFrame([("About us: x",), ("Open 9:00 am - 5:00 pm",), ("none",), (None,)], "t string")
    got = df.select(X.without_noise(F.col("t")).alias("x"))
    assert [r[0] for r in got.collect()] == [": x", "", "none", None]
    assert len(re.findall(r"\(\?i\)newsletter,", plan(got))) == 1


def test_containers_read_a_text_once(spark):
    df = spark.createDataFrame([(1, "<div>short</div><DIV>words that are long enough to stay</DIV>"), (2, None), (3, "no tags")], "page_id int, html string")
    got = P.containers(df, ("page_id",), ("div", "nav"))
    assert [tuple(r) for r in got.collect()] == [(1, "div", 1, "words that are long enough to stay")]
    assert "Filter (length(" not in plan(got)


def test_places_are_read_within_their_row(spark):
    text = "***LoHi***\n\n**Cafe A**\n*Thai*\n12 First St\n7 Other Street vegan\nOld Town\nBy the river\n*Greek*\n[a](http://x)\n[b](http://y)\n\n**Cafe A**\n**Mon | 3 pm**\nvegan menu"
    df = spark.createDataFrame([(1, text), (2, None)], "seq int, text string")
    got = G.guide_places(df, ("seq",))
    assert [tuple(r) for r in got.collect()] == [(1, "LoHi", "cafe-a", "Cafe A", None, None, None, ["Mon | 3 pm"], None, True)]
    lines = [(r.block, r["class"]) for r in G.guide_lines(df, ("seq",)).orderBy("block", "line").collect()]
    assert lines == [(1, c) for c in ("name", "cuisine", "address", "note", "location", "other", "cuisine", "link", "link")] + [(2, c) for c in ("name", "schedule", "note")]
    assert plan(got).count("Aggregate") == 1


def test_priced_forms_extract_within_the_match(spark):
    df = spark.createDataFrame([(1, "OYSTERS IN BUTTER  12"), (2, "20% off tacos"), (3, "DUCK — $9.50"), (4, "$4 Big Plate"), (5, "fish and chips $12")], "doc int, line string")
    got = X.priced_forms(df, ("doc",))
    assert {(r.doc, r.form, r.title, r.price) for r in got.collect()} >= {(1, 13, "OYSTERS IN BUTTER", "$12"), (2, 2, "tacos", "20%"), (3, 9, "DUCK", "$9.50"), (4, 12, "Big Plate", "$4")}
    assert plan(got).count("regexp_extract(") <= 36  # 32 parts, four of them named twice

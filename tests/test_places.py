"""Prices, hours, addresses and due rows with answers by hand."""

from pyspark.sql import functions as F

from dealloom.functions import deals as D
from dealloom.functions import times as T
from dealloom.operators import pricing as P
from dealloom.operators import status as S


def test_kinds_of_deals(spark):
    rows = [("$5.50", "Beer", None, None), (None, "Plate for $12", None, "drink"), ("", "", "$4", None), (None, None, "$11", None), (None, None, "$11", "Happy drink"), ("free", "x", "y $3", "food"), ("$7", "wine and pizza", None, None), (None, None, None, None)]
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "i int, price string, title string, description string, deal_type string, n string")
    got = [(r.amount, r.is_drink, r.is_food) for r in P.deal_kinds(df).orderBy("i").collect()]
    assert got == [(5.5, True, False), (12.0, False, True), (4.0, True, False), (11.0, False, True), (11.0, True, False), (None, False, True), (7.0, True, True), (None, None, None)]


def test_estimates(spark):
    rows = [("$$$$", "Steakhouse", "The Vine"), (None, None, None), ("$", "Mexican Bar", ""), ("?", "Sushi", "x")]
    df = spark.createDataFrame(rows, "p string, c string, n string")
    price = lambda kind: P.estimated_price(kind, F.col("p"), F.col("c"), F.col("n"), ((("vine",), 1.5),))
    assert [tuple(r) for r in df.select(price("drink"), price("food")).collect()] == [(17.5, 22.5), (8.0, 11.0), (7.0, 5.0), (6.0, 10.0)]


def test_period_hours(spark):
    end = "struct<day:int,time:string,hour:int,minute:int>"
    e = lambda day=None, time=None, hour=None, minute=None: (day, time, hour, minute)
    rows = [(None,), ([],), ([(e(0, "0900"), e(0, "1700")), (e(0, "1000"), e(0, "1800"))],), ([(e(6, None, 9, 5), e(6, None, 22)), (e(2, "0900"), None), (None, e(3, "1000")), (e(7, "0900"), e(7, "1000")), (e(None, "0900"), e(1, "1000"))],)]
    df = spark.createDataFrame(rows, f"p array<struct<open:{end},close:{end}>>")
    got = [{k: tuple(v) for k, v in r[0].items()} for r in df.select(T.period_hours(F.col("p"))).collect()]
    assert got == [{}, {}, {"sunday": ("10:00", "18:00")}, {"saturday": ("09:05", "22:00")}]


def test_addresses(spark):
    rows = [("12 United St Suite 5, Denver",), ("7 Main#4B",), ("Main 7",), (None,), ("",), ("9 Apt Road, x",), ("5 Long Way APT. c",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(*D.street_parts(F.col("t"))).collect()]
    assert got == [("12", "United St", "5"), ("7", "Main", "4B"), (None,) * 3, (None,) * 3, (None,) * 3, ("9", "Apt Road", None), ("5", "Long Way", "c")]
    rows = [("1", "A", "2", "B", "C", "3"), (None, "A", None, "B", None, "3"), ("1", "A", "", "", "", ""), (None, None, None, None, None, "3"), (" ", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n string, s string, u string, c string, t string, z string")
    assert [r[0] for r in df.select(D.formatted_address(*[F.col(c) for c in "nsuctz"])).collect()] == ["1 A 2, B, C 3", "B, 3", "1 A", "3", None]


def test_due_and_rollup(spark):
    rows = [(1, None, "daily", None), (2, "2024-01-09 12:00:00", "daily", None), (3, "2024-01-09 12:00:01", "daily", None), (4, "2024-01-03 12:00:00", None, None), (5, "2024-01-09 12:00:00", "quarterly", 24), (6, "2024-01-10 12:00:00", "daily", 0), (7, "2024-01-09 12:00:00", "weekly", None)]
    df = spark.createDataFrame(rows, "i int, u string, k string, h int").withColumn("u", F.to_timestamp("u"))
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    assert {r.i for r in S.due(df, now, "u", F.col("k"), F.col("h")).collect()} == {1, 2, 4, 5, 6}
    assert {r.i for r in S.due(df, now, "u").collect()} == {1, 4}
    status = spark.createDataFrame([("a", "active"), ("a", "upcoming"), ("b", "upcoming"), ("b", None), ("c", None), (None, "active")], "d string, status string")
    assert {tuple(r) for r in S.status_rollup(status, "d").collect()} == {
        ("a", 2, 1, 1, "1 happy hours active now"), ("b", 2, 0, 1, "1 starting soon"), ("c", 1, 0, 0, "No active happy hours"), (None, 1, 1, 0, "1 happy hours active now"),
    }

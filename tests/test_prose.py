"""Plain-text operators on small made texts."""

import pytest
from pyspark.sql import functions as F

from dealloom.functions import times as T
from dealloom.operators import profiles, rules
from dealloom.operators import prose as X


def test_patterns_that_do_not_compile(spark):
    good = ["", "a", "(a|b)*", r"\(", r"[(]", r"(?:am|pm)?", r"(?i)x", r"\d{1,2}", "a|b", r"(?<=x)y", "(?!x)"]
    bad = ["(", "a)", ")(", "*a", "(+b)", "[a", "(?:x", "x\\", "((a)", "a{2,1}", "[z-a]", "(?<n)", r"\k<x>", r"\p{Foo}"]
    rows = [(str(i), "n", p, None) for i, p in enumerate(good + bad)] + [("x", None, None, None)]
    found = {r.slug: list(r.errors) for r in rules.rule_errors(spark.createDataFrame(rows, "slug string, name string, time_pattern string, day_pattern string")).collect()}
    assert [found[str(i)] for i in range(len(good))] == [[]] * len(good)
    assert [found[str(len(good) + i)] for i in range(len(bad))] == [["Invalid regex in time_pattern"]] * len(bad)
    assert found["x"] == ["Missing required field: name"]
    with pytest.raises(ValueError):
        rules.rule_errors(spark.createDataFrame(rows, "slug string, name string, time_pattern string, day_pattern string"), most=3)


def test_a_broken_rule_costs_its_own_rows_only(spark):
    texts = spark.createDataFrame([(1, "a", "3 - 6 pm"), (2, "b", "3 - 6 pm")], "id long, slug string, text string")
    table = spark.createDataFrame([("a", r"(\d+)()? ?- ?(\d+) ?(pm)", "x", None), ("b", "(x", "x", None)], "slug string, time_pattern string, day_pattern string, exclude string")
    assert [(r.id, r.start_time, r.end_time) for r in X.ruled_deals(texts, table, ("id",)).collect()] == [(1, "3 PM", "6 PM")]


def test_contexts_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "a\nb\nhappy hour\nd\ne\nf\nDEALS"), (5, "x\u0001y 3 - 6 pm\u0002")], "id long, text string")
    found = {(r.id, r.line): r.section for r in X.keyword_contexts(docs, ("id",)).collect()}
    assert found == {(3, 0): "one", (4, 3): "a\nb\nhappy hour\nd\ne", (4, 7): "e\nf\nDEALS", (5, 0): "x\u0001y 3 - 6 pm\u0002"}
    assert [(r.id, r.start_time, r.end_time, r.day) for r in X.text_deals(docs, ("id",)).collect()] == [(5, "3 pm", "6 pm", None)]
    assert X.text_deals(docs.limit(0), ("id",)).count() == 0


def test_priced_forms(spark):
    lines = ["$9 craft cocktails", "Half off wine", "$5-$60 plates", "$2 glass of wine", "$7 each", "OYSTERS ROYAL with lemon — $12", "minimum order $9 Beer", "$8 House red wine"]
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = {(r.id, r.title.lower(), r.price, r.kind) for r in X.priced_forms(rows, ("id",)).collect()}
    assert {(0, "craft cocktails", "$9", "drink"), (1, "wine", "Half", "drink"), (7, "house red wine", "$8", "drink")} <= got
    assert any(i == 5 and p == "$12" and k == "food" for i, _, p, k in got) and not {2, 3, 4} & {i for i, *_ in got}


def test_deal_focus_on_odd_rows(spark):
    rows = [(1, None, None), (2, "", []), (3, "Happy hour! $5 beer", ["https://resy.com/x", None])]
    got = {r.i: r for r in profiles.deal_focus(spark.createDataFrame(rows, "i int, text string, links array<string>"), links="links").collect()}
    assert [got[i].fields_extracted for i in (1, 2)] == [0, 0] and got[1].price_range is None and got[2].menu_pricing == []
    assert got[3].happy_hour_context == ["Happy hour"] and got[3].reservation_services[0].url == "https://resy.com/x"
    assert got[3].fields_extracted == 5  # price, level, happy hour, sign of a deal, link


def test_time_ranges(spark):
    texts = ["3pm to 6pm", "3:00 - 6:00", "4:30pm-7 pm", "9PM-Close", "3:15 - 6:45 pm", "10:30 AM ~ 2 PM and 9pm - close", "12–2:30pm", "from 5 to 7", None]
    want = [
        {("3 pm", "6 pm")}, {("3:00 pm", "6:00 pm")}, {("4:30 pm", "7 pm")}, {("9 PM", "Close")}, {("3:15 pm", "6:45 pm")}, {("10:30 AM", "2 PM"), ("9 pm", "Close")}, {("12 pm", "2:30 pm")}, set(), set(),
    ]
    got = [set() for _ in texts]
    for r in X.text_deals(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), ("id",)).collect():
        got[r.id].add((r.start_time, r.end_time))
    assert got == want


def test_opening_hours_go_unless_a_keyword_is_near(spark):
    far = "x" * 60
    texts = ["Kitchen hours: Mon 11:00 am - 9:00 pm", f"Open 9:00 am - 5:00 pm {far} tail", "Happy hour! Monday: 3:00 pm - 6:00 pm", "Restaurant Hours daily 8:00 am - 9:30 am; Hour: 1:00 pm - 2:00 pm", "Dining hours 5:00 pm – 9:00 pm", "Hours 9 - 5"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(X.without_noise(F.col("t")).alias("t")).collect()]
    assert got == ["", f"{far} tail", "Happy hour! Monday: 3:00 pm - 6:00 pm", "", "", "Hours 9 - 5"]


def test_all_sets_of_days_in_short(spark):
    short = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

    def plain(on):
        if len(on) in (0, 7):
            return "Daily" if on else ""
        out = []
        for first in (d for d in range(7) if d in on and (d - 1) % 7 not in on):
            run = [first]
            while (run[-1] + 1) % 7 in on:
                run.append((run[-1] + 1) % 7)
            out.append(f"{short[run[0]]}-{short[run[-1]]}" if len(run) > 2 else ", ".join(short[d] for d in run))
        return ", ".join(out)

    sets = [[d for d in range(7) if mask >> d & 1] for mask in range(128)]
    rows = spark.createDataFrame([(i, [T.WEEK[d] for d in on]) for i, on in enumerate(sets)], "i int, days array<string>")
    got = {r.i: (r.s, r.m) for r in rows.select("i", T.compact_days(F.col("days")).alias("s"), T.day_mask(F.col("days")).alias("m")).collect()}
    assert got == {i: (plain(set(on)), i) for i, on in enumerate(sets)}

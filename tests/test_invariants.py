"""What holds for any input: consolidation, plans without Python, edge rows."""

import pytest
from pyspark.sql import functions as F

from dealloom.functions import deals as D
from dealloom.functions import times as T
from dealloom.operators import consolidate as C
from dealloom.operators import quality as Q
from dealloom.operators import ranks
from dealloom.operators import refine as R
from dealloom.operators.overlay import us_phone
from dealloom.plans import registry
from dealloom.plans.deal_queries import deals, raw_extractions
from dealloom.sources import tables

SF = "/root/testdata/sf0.001"
NATIVE = sorted(set(registry.queries()) - {"w7_without_overlaps", "w7_day_sets", "u10_extractors"})
FOREIGN = ("ArrowEval", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin")
ONE_ROW = {"a18_quality_report", "a30_consolidation_report", "j7_redirected_lists"}  # joins with a table of one row


@pytest.mark.parametrize("name", NATIVE)
def test_plan_has_no_python_and_no_cartesian_product(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(w in plan for w in FOREIGN if name not in ONE_ROW or w != "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name, module", [("j16_reachable", tables), ("w1_ranks", ranks)])
def test_plans_before_checkpoints(spark, monkeypatch, name, module):
    plans, checkpointed = [], module.checkpointed
    monkeypatch.setattr(module, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().toString()) or checkpointed(df))
    registry.queries()[name](spark, SF)
    assert plans and not any(w in plan for w in (*FOREIGN, "SinglePartition") for plan in plans)


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.queries()["u1_bag_union"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_public_deals_take_one_scan_and_no_join(spark):
    plan = R.refined(raw_extractions(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_consolidation(spark):
    keyed = C.signed(deals(spark, SF))
    once = C.consolidated(keyed)
    kept, rows = {r.seq for r in once.collect()}, {r.seq: r.restaurant_slug for r in keyed.collect()}
    assert kept <= set(rows) and {rows[s] for s in kept} == set(rows.values())
    again = C.consolidated(once.select(keyed.columns))
    assert {r.seq for r in again.collect()} == kept


def test_schedules_do_not_depend_on_the_order_of_rows(spark):
    raw = raw_extractions(spark, SF)
    keyed = R.with_schedule_id(raw)
    mean = F.round("average_confidence", 9)
    one = {tuple(map(str, r)) for r in R.schedules(keyed).withColumn("average_confidence", mean).collect()}
    two = {tuple(map(str, r)) for r in R.schedules(keyed.orderBy(F.rand(3)).repartition(7)).withColumn("average_confidence", mean).collect()}
    assert one == two and sum(r.n_raw for r in R.schedules(keyed).collect()) == raw.count()


def test_edge_rows(spark):
    times = ["3pm", "3 PM", "3:30 PM", "12 am", "12 pm", "15:00", "Close", "All Day", "ab:cd", "", None, "25:00", "13 pm"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").orderBy("i").select(T.time_24h(F.col("t"))).collect()]
    assert got == ["15:00", "15:00", "15:30", "00:00", "12:00", "15:00", None, None, None, None, None, None, None]
    days = spark.createDataFrame([(["Mon", "MONDAY", " tue ", "", None],), ([],)], "d array<string>")
    assert [r[0] for r in days.select(T.day_list(F.col("d"))).collect()] == [["monday", "tuesday"], []]
    wrap = spark.createDataFrame([(["sunday", "monday", "tuesday", "wednesday", "thursday"],), (list(T.WEEK),), ([],), (["monday", "wednesday"],)], "d array<string>")
    assert [r[0] for r in wrap.select(T.compact_days(F.col("d"))).collect()] == ["Sun-Thu", "Daily", "", "Mon, Wed"]
    phones = spark.createDataFrame([("5550100",), ("303-555-0100",), ("1 303 555 0100",), ("2 303 555 0100",), (None,)], "p string")
    assert [r[0] for r in phones.select(us_phone(F.col("p"))).collect()] == [None, "(303) 555-0100", "(303) 555-0100", None, None]
    prices = spark.createDataFrame([("$5 beer",), ("5",), ("$2.50 taco",), ("free",)], "p string").select(D.price_item(F.col("p")).alias("x")).collect()
    assert [(r.x and (r.x["name"], r.x["price"])) for r in prices] == [("beer", 5.0), ("", 5.0), ("taco", 2.5), None]
    raw = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None)], "seq long, restaurant_slug string, raw_title string, raw_description string, raw_times array<string>, raw_days array<string>, raw_prices array<string>, confidence_score double, source_url string, extracted_at string")
    assert R.refined(raw).count() == 0
    assert R.refined(raw.withColumn("restaurant_slug", F.lit("a"))).count() == 0  # no day and no time


def test_hours(spark):
    schema = "h map<string, struct<open: string, close: string, closed: boolean>>"
    rows = [({"Monday": ("9:00", "17:00", None), "funday": ("9:00", "17:00", None), "tuesday": ("x", "17:00", None), "sunday": (None, None, True)},), ({"funday": ("9:00", "17:00", None)},)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(Q.valid_hours(F.col("h"))).collect()]
    assert set(got[0]) == {"monday", "sunday"} and got[1] is None

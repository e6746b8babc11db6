import json

from pyspark.sql import types as T

from dealloom.operators.overlap import without_overlaps
from dealloom.sources import tables as S

RECORD = T.StructType([T.StructField("name", T.StringType()), T.StructField("district", T.StringType())])
ROW = T.StructType([T.StructField("url", T.StringType()), T.StructField("likelihood", T.DoubleType())])


def test_registry_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"restaurants": {"x": {"name": "X", "district": "d", "extra": 1}, "y": {"name": "Y"}}}))
    (tmp_path / "b.json").write_text(json.dumps({"areas": {"a1": {"x": {"name": "old"}}, "a2": {"x": {"name": "new"}, "z": {"name": "Z"}}}}))
    one = {tuple(r) for r in S.registry(spark, str(tmp_path / "a.json"), RECORD).collect()}
    two = {tuple(r) for r in S.registry(spark, str(tmp_path / "b.json"), RECORD).collect()}
    assert one == {("x", "X", "d"), ("y", "Y", None)} and two == {("x", "new", None), ("z", "Z", None)}


def test_envelopes(spark, tmp_path):
    rows = [{"url": "u", "likelihood": 0.5}, {"url": "v", "likelihood": None}]
    (tmp_path / "bare.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "wrapped.json").write_text(json.dumps({"exported_at": "x", "pages": rows}))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name, lines in (("bare", False), ("wrapped", False), ("lines", True)):
        assert [tuple(r) for r in S.envelope(spark, str(tmp_path / f"{name}.json"), "pages", ROW, lines).collect()] == [("u", 0.5), ("v", None)]


def test_snapshots_retention_and_sinks(spark, tmp_path):
    deal = T.StructType([T.StructField("title", T.StringType()), T.StructField("price", T.StringType()), T.StructField("prices", T.ArrayType(T.StringType()))])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my-bar_20240101.json").write_text(json.dumps([{"title": "a", "price": "$5"}]))
    (tmp_path / "in" / "my-bar_20240301.json").write_text(json.dumps([{"title": "b", "prices": ["$6", "$7"]}, {"title": "c"}]))
    rows = S.snapshots(spark, str(tmp_path / "in"), deal)
    assert {(r.slug, str(r.snapshot_date), r.title, tuple(r.prices or ())) for r in rows.collect()} == {("my-bar", "2024-01-01", "a", ("$5",)), ("my-bar", "2024-03-01", "b", ("$6", "$7")), ("my-bar", "2024-03-01", "c", ())}
    assert {r.title for r in S.newest(rows).collect()} == {"b", "c"} == {r.title for r in S.retained(rows, "2024-03-10").collect()}
    out = str(tmp_path / "out")
    S.write_snapshots(rows, out)
    S.write_snapshots(rows.filter("title = 'b'"), out)
    assert {r.title for r in spark.read.parquet(out).collect()} == {"a", "b"}
    S.export_with_envelope(rows.select("title"), str(tmp_path / "ex"), "deals")
    assert spark.read.json(str(tmp_path / "ex" / "deals_meta")).first()["total_deals"] == 3
    S.route(rows.select("title", "slug"), "title", {"a": str(tmp_path / "r" / "a"), "b": str(tmp_path / "r" / "b")})
    assert spark.read.parquet(str(tmp_path / "r" / "a")).count() == 1


def test_overlaps(spark):
    rows = [
        (1, "s", ["monday", "tuesday"], "3 pm", "6 pm", 0.9), (2, "s", ["monday"], "4 pm", "6 pm", 0.8), (3, "s", ["friday"], "3 pm", "6 pm", 0.8), (4, "s", ["monday"], "8 pm", "10 pm", 0.7),
        (5, "t", ["monday"], None, None, 0.5), (6, "t", ["monday"], None, None, 0.6), (7, "t", ["monday"], "9 pm", "2 am", 0.4),
    ]
    deals = spark.createDataFrame(rows, "seq long, restaurant_slug string, days array<string>, start_time string, end_time string, confidence_score double")
    assert {r.seq for r in without_overlaps(deals).collect()} == {1, 3, 4, 6, 7}

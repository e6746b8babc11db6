from pyspark.sql import functions as F

from dealloom.plans.deal_queries import deals
from dealloom.sources import folders
from dealloom.streaming import jobs, keyed_table

SF = "/root/testdata/sf0.001"


def source(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    rows.repartition(3).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_best_so_far_equals_the_batch(spark, tmp_path):
    rows = deals(spark, SF)
    want = {tuple(r) for r in jobs.best_so_far(rows).collect()}
    stream = jobs.best_so_far(source(spark, tmp_path, rows))
    jobs.upsert(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["restaurant_slug", "time_signature"]).awaitTermination(120)
    got = keyed_table.current(spark, str(tmp_path / "out"), stream.schema)
    assert {tuple(r) for r in got.collect()} == want and folders.names(spark, str(tmp_path / "out" / "versions")) == [f"{n:012d}.json" for n in range(3)]


def test_a_batch_rewrites_what_it_touches(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, j string, v int"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    now = lambda: sorted((tuple(r) for r in keyed_table.current(spark, path, rows().schema).collect()), key=str)
    assert now() == []
    first = rows(*((i, "a", i) for i in range(50)), (None, None, 7))
    assert keyed_table.merge(first, 0, path, ["k", "j"], 8) == 8
    before = keyed_table.current(spark, path, first.schema)
    assert keyed_table.merge(rows((3, "a", 100)), 1, path, ["k", "j"], 8) == 1
    assert len([n for n in folders.names(spark, f"{path}/rows/{1:012d}") if n.startswith("_part=")]) == 1
    # A reader that began before the batch still sees all of its version.
    assert before.count() == 51 and before.filter("v = 100").isEmpty()
    want = sorted([*((i, "a", 100 if i == 3 else i) for i in range(50)), (None, None, 7)], key=str)
    assert now() == want
    # Repeated batches, old and new, change nothing; empty ones neither.
    assert keyed_table.merge(rows((3, "a", -1)), 1, path, ["k", "j"], 8) == 0 == keyed_table.merge(first, 0, path, ["k", "j"], 8)
    assert keyed_table.merge(rows(), 2, path, ["k", "j"], 8) == 0 and now() == want
    # A batch that was lost before its manifest is written over; null keys are equal.
    rows((1, "a", 5)).withColumn("_part", F.lit(0)).write.partitionBy("_part").parquet(f"{path}/rows/{3:012d}")
    assert keyed_table.merge(rows((None, None, 8), (99, None, 9)), 3, path, ["k", "j"], 8) in (1, 2)
    assert now() == sorted([*want[:-1], (None, None, 8), (99, None, 9)], key=str)
    assert keyed_table.vacuum(spark, path, 1) > 0 and len(now()) == 52


def test_repeats_go(spark, tmp_path):
    rows = deals(spark, SF).withColumn("scraped_at", F.col("extracted_at").cast("timestamp"))
    twice = rows.union(rows)
    out = jobs.without_repeats(source(spark, tmp_path, twice), ["restaurant_slug", "seq"], late="60 days")
    out.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("once").count() == rows.count()


def test_fan_out(spark, tmp_path):
    rows = deals(spark, SF).select("seq", F.when(F.col("seq") % 10 == 0, F.lit(None)).otherwise(F.col("extraction_method")).alias("kind"))
    sinks = {k: str(tmp_path / k) for k in ("universal_html_section", "pdf_section_analysis", "none at all")}
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    stream = source(spark, tmp_path, rows).withColumn("seq", F.udf(seen, "long")("seq"))
    counts = {}
    jobs.fan_out(stream, "kind", sinks, str(tmp_path / "ck"), lambda number, found: counts.setdefault(number, found)).awaitTermination(120)
    held = {k: spark.read.parquet(p).count() for k, p in sinks.items()}
    n = rows.filter("kind IS NULL").count()
    assert sum(held.values()) == rows.count() - n and held["none at all"] == 0
    assert {k: sum(c[k] for c in counts.values()) for k in (*sinks, "other", "rows")} == {**held, "other": n, "rows": rows.count()}
    assert len(counts) == 3 and read.value == rows.count()  # each row is read once

"""Reading and writing of registries, link files, archives and exports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealloom.sources import folders


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; a temporary folder only where that is unset and all tasks run on this machine."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def registry(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """A registry {"restaurants": {slug: record}}, or {"areas": {area: {slug: record}}}, as one row per slug.

    Where a slug is in several areas the last area by name counts.
    """
    one = T.MapType(T.StringType(), record)
    schema = T.StructType([T.StructField("restaurants", one), T.StructField("areas", T.MapType(T.StringType(), one))])
    whole = spark.read.schema(schema).json(path, multiLine=True)
    flat = whole.select(F.explode("restaurants").alias("slug", "record"), F.lit("~").alias("area"))
    nested = whole.select(F.explode("areas").alias("area", "of")).select("area", F.explode("of").alias("slug", "record"))
    both = flat.unionByName(nested)
    return both.groupBy("slug").agg(F.max_by("record", "area").alias("record")).select("slug", "record.*")


def envelope(spark: SparkSession, path: str, field: str, row: T.StructType, lines: bool = False) -> DataFrame:
    """Rows of {field: [...]}, of a bare array, or of JSON lines."""
    if lines:
        return spark.read.schema(row).json(path)
    whole = spark.read.text(path, wholetext=True)
    array = T.ArrayType(row)
    wrapped = F.from_json("value", T.StructType([T.StructField(field, array)]))
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", array)).otherwise(wrapped[field])
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def snapshots(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """Deals of {slug}_{yyyymmdd}.json files with slug and date from the name; price and prices become one column."""
    rows = spark.read.schema(row).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_name"))
    name = lambda k: F.regexp_extract("_file", r"^(.*)_(\d{8})\.json$", k)
    out = rows.withColumns({"slug": name(1), "snapshot_date": F.to_date(name(2), "yyyyMMdd")}).drop("_file")
    if {"price", "prices"} <= set(out.columns):
        out = out.withColumn("prices", F.coalesce("prices", F.when(F.col("price").isNotNull(), F.array("price")))).drop("price")
    return out


def newest(rows: DataFrame, by: str = "slug", date: str = "snapshot_date") -> DataFrame:
    """Rows of the newest snapshot of each slug."""
    last = rows.groupBy(by).agg(F.max(date).alias(date))
    return rows.join(last, [by, date])


def retained(rows: DataFrame, as_of: str, days: int = 30, date: str = "snapshot_date") -> DataFrame:
    return rows.filter(F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), days))


def export_with_envelope(rows: DataFrame, path: str, field: str) -> None:
    """Rows as JSON lines, and one row with their count."""
    rows.write.mode("overwrite").json(f"{path}/{field}")
    rows.agg(F.count("*").alias(f"total_{field}")).write.mode("overwrite").json(f"{path}/{field}_meta")


def route(rows: DataFrame, kind: str, sinks: dict[str, str]) -> dict[str, int]:
    """Each kind of row to its own Parquet folder, in one pass; gives the counters of the pass: rows, each kind, and other.

    The rows are written once, in folders by kind beside the first sink, which are then moved; all
    sinks are on one file system. A kind without rows gets an empty folder, rows of other kinds are counted only.
    """
    spark = rows.sparkSession
    names = list(sinks)
    counted, seen = counters(rows, {f"kind {n}": F.coalesce(F.col(kind) == n, F.lit(False)) for n in names})
    draft = f"{sinks[names[0]].rstrip('/')}._{uuid.uuid4().hex}"
    place = F.coalesce(*[F.when(F.col(kind) == n, F.lit(i)) for i, n in enumerate(names)], F.lit(-1))
    # Rows of other kinds pass the counters too; they are dropped behind them.
    counted.withColumn("_sink", place).filter("_sink >= 0").drop(kind).write.partitionBy("_sink").parquet(draft)
    found = seen()
    empty = spark.createDataFrame([], rows.drop(kind).schema)
    for i, n in enumerate(names):
        if folders.exists(spark, f"{draft}/_sink={i}"):
            folders.replace(spark, f"{draft}/_sink={i}", sinks[n])
        else:
            empty.write.mode("overwrite").parquet(sinks[n])
    folders.delete(spark, draft)
    each = {n: found[f"kind {n}"] for n in names}
    return {"rows": found["rows"], **each, "other": found["rows"] - sum(each.values())}


def write_snapshots(rows: DataFrame, path: str, date: str = "snapshot_date") -> None:
    """Replaces only the dates that rows has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def counters(rows: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """rows, and a function that gives the number of all rows and of those that meet each condition once an action on rows is over.

    The counts are observed while the rows pass; no job of its own runs for them.
    """
    seen = Observation()
    counted = rows.observe(seen, F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()])
    return counted, lambda: dict(seen.get)

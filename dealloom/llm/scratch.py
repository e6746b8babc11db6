"""Tables and component labels kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine, as in tests."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, *by: str, codec: str | None = None) -> DataFrame:
    """The same rows, written as Parquet to the shared folder, in folders by the columns in by, and read again: cuts the lineage and survives lost executors. codec: instead of the session's."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables from written() that no later plan reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for the vertices of edges (a, b); a component is named by its smallest vertex.

    Contraction: each vertex moves to its smallest neighbour, labels are followed twice, and the
    edges between different labels go on; the vertices at least halve in each round. Empty edges
    give an empty table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = written(both.filter("a <> b").distinct())
    label = None
    while label is None or not live.isEmpty():
        step = written(live.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        up = step.select(F.col("a").alias("to"), F.col("to").alias("up"))
        jump = step.join(up, "to").select("a", F.col("up").alias("to"))
        jump = written(jump.join(up, "to").select("a", F.col("up").alias("to")))
        if label is None:
            label = jump.select(F.col("a").alias("vertex"), F.col("to").alias("component"))
        else:
            label = label.join(jump.withColumnRenamed("a", "component"), "component", "left").select("vertex", F.coalesce("to", "component").alias("component"))
        label = written(label)
        left = live.join(jump, "a").select(F.col("to").alias("ma"), "b")
        right = jump.select(F.col("a").alias("b"), F.col("to").alias("mb"))
        after = written(left.join(right, "b").filter("ma <> mb").select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct())
        discard(live, step)
        live = after
    return label

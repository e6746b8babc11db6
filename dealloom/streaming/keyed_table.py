"""A keyed table that batches change in part, and that readers see in whole versions.

Rows lie in partitions by a hash of their key. A batch writes anew the partitions that hold one of its
keys, into a folder of its own, and then a small manifest that says for each partition which batch
wrote it last. Readers take the newest manifest, so they see the table before a batch or after it. A
batch that is repeated finds its manifest and changes nothing; one that was lost half-way is written over.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dealloom.sources import folders

PARTITIONS = 64


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, dict[str, int]]:
    """Number and partitions of the newest version, or of the newest before a batch; -1 and none for an empty table."""
    known = [int(n.removesuffix(".json")) for n in folders.names(spark, f"{path}/versions") if n.endswith(".json")]
    known = [n for n in known if before is None or n < before]
    return (max(known), json.loads(folders.read_whole(spark, f"{path}/versions/{max(known):012d}.json"))) if known else (-1, {})


def _rows(spark: SparkSession, path: str, schema: StructType, of: dict[str, int]) -> DataFrame:
    """Rows of partitions, each as of its batch."""
    paths = [f"{path}/rows/{batch:012d}/_part={part}" for part, batch in sorted(of.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest whole version."""
    return _rows(spark, path, schema, _manifest(spark, path)[1])


def merge(batch: DataFrame, number: int, path: str, keys: Sequence[str], partitions: int = PARTITIONS) -> int:
    """Puts a batch's rows in place of those with the same keys; gives the number of partitions written.

    A batch has one row for each key; keys may be null. The number of partitions stays that of the first batch.
    """
    spark = batch.sparkSession
    newest, _ = _manifest(spark, path)
    if newest >= number:
        return 0
    _, of = _manifest(spark, path, number)
    part = F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int")
    new = batch.withColumn("_part", part)
    touched = [str(r._part) for r in new.select("_part").distinct().collect()]  # partitions at most
    if touched:
        old = _rows(spark, path, batch.schema, {p: of[p] for p in touched if p in of})
        same = None
        for k in keys:
            one = old[k].eqNullSafe(new[k])
            same = one if same is None else same & one
        kept = old.join(new.select(*keys), same, "left_anti").withColumn("_part", part)
        merged = kept.unionByName(new).repartition(len(touched), "_part")
        merged.write.mode("overwrite").partitionBy("_part").parquet(f"{path}/rows/{number:012d}")
    folders.write_whole(spark, f"{path}/versions/{number:012d}.json", json.dumps(of | dict.fromkeys(touched, number)))
    return len(touched)


def vacuum(spark: SparkSession, path: str, versions: int = 2) -> int:
    """Deletes the partitions that none of the newest versions has, and older manifests; gives the number of folders deleted."""
    known = [n for n in folders.names(spark, f"{path}/versions") if n.endswith(".json")]
    used = {(part, batch) for n in known[-versions:] for part, batch in json.loads(folders.read_whole(spark, f"{path}/versions/{n}")).items()}
    gone = 0
    for batch in folders.names(spark, f"{path}/rows"):
        for name in folders.names(spark, f"{path}/rows/{batch}"):
            if name.startswith("_part=") and (name.removeprefix("_part="), int(batch)) not in used:
                folders.delete(spark, f"{path}/rows/{batch}/{name}")
                gone += 1
    for n in known[:-versions]:
        folders.delete(spark, f"{path}/versions/{n}")
    return gone

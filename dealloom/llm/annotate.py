"""Columns computed from a text column in Arrow batches, with any columns of the row carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20  # of Arrow batches with texts; Spark's defaults are meant for narrow rows


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's limits of Arrow batches, so that tasks hold a few megabytes of texts at a time."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(conf.get(key, str(most))).lower()
        now = int(now.rstrip("b")) if now.rstrip("b").lstrip("-").isdigit() else most + 1
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return df


def annotate(df: DataFrame, keep: Sequence[str], compute: Callable[[], Callable[[pa.Array], Iterator[tuple[int, int, list]]]], fields: str, text: str = "text") -> DataFrame:
    """df's columns in keep as a struct named row, and the new fields.

    compute runs once in each task and returns a function that takes the texts of a batch and
    yields (first text, number of texts, arrays of the fields) for consecutive blocks of it. The
    struct keeps the new names apart from columns of df that have the same names.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    picked = small_batches(df).select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).cast("string").alias("text"))
    row = picked.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = compute()
        for batch in batches:
            rows = batch.column("row")
            for lo, n, arrays in of(batch.column("text")):
                yield pa.RecordBatch.from_arrays([rows.slice(lo, n), *arrays], ["row", *names])

    return picked.mapInArrow(run, f"row {row}, {fields}")

"""Folders of a shared file system: moved whole, listed, and small files that appear whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    return of, of.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    of, files = _at(spark, path)
    return files.exists(of)


def delete(spark: SparkSession, path: str) -> None:
    of, files = _at(spark, path)
    files.delete(of, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    of, files = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(of)) if files.exists(of) else []


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder to a place of the same file system; what was there goes."""
    of, files = _at(spark, source)
    to, _ = _at(spark, target)
    files.delete(to, True)
    files.mkdirs(to.getParent())
    if not files.rename(of, to):
        raise OSError(f"{source} can't be moved to {target}")


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """A small file that readers find whole or not at all; one that is there already stays."""
    to, files = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(to.getParent(), f"_{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(to) or not files.rename(draft, to):
        files.delete(draft, False)


def read_whole(spark: SparkSession, path: str) -> str:
    of, _ = _at(spark, path)
    return spark.read.text(str(of.toString()), wholetext=True).first()[0]

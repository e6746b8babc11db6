"""Operator 13: hard negatives for anchors and their positives, by a secondary-sort shuffle.

Anchors meet all rows in blocks, whose scores are integer inner products. A block first gives each
anchor's best rows of the same label; the best of all blocks are its positives. In a second pass it gives,
for each positive, the best rows of other labels in the window below the positive's score. Both are
packed into keys (anchor, descending score, kind and id), which the shuffle sorts within partitions. An
iterator then goes down each anchor's rows, opens a window for each positive that it meets, and gives
negatives to the open ones; it holds no more than the windows of one anchor.

A block's best are enough: what is among the first of all rows is among the first of its block. So
no row is dropped that could be a result, and the shuffle carries a few rows for each anchor and block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealloom.llm.scratch import written

ROWS = 4096  # rows of a block
ANCHORS = 512  # anchors of a block
EXACT = 2.0**53  # integers up to here are exact in double precision
_FOUND = "anchor long, anchor_id long, score long, id long"


def _quantised(column: pa.Array) -> np.ndarray:
    """floor(256 x) of each component, one row for each vector of a block (all of one length)."""
    return np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**63 and max(np.abs(a).max(), np.abs(b).max()) < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object)
    found = whole(a) @ whole(b).T
    if max(abs(v) for v in found.reshape(-1)) >= 2**63:
        raise OverflowError("an inner product is beyond a long")
    return found.astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by smaller id."""
    if len(score) > 4 * n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:n]]


def _best_of_block(n_positives: int, n_negatives: int, floor: int | None):
    """floor None: each anchor's first rows of its label. Else: for each of its positives, the first rows of other labels from floor per cent of the positive's score up to all of it."""

    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if anchors.num_rows and rows.num_rows:
            scores = _products(_quantised(anchors.column("vector").combine_chunks()), _quantised(rows.column("vector").combine_chunks()))
            ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
            numbers, names, wanted = (anchors.column(c).to_numpy() for c in ("anchor", "id", "label"))
            positives = anchors.column("positives").to_pylist() if floor is not None else None
            for i in range(len(numbers)):
                if floor is None:
                    some = np.flatnonzero((labels == wanted[i]) & (ids != names[i]))
                    some = some[_first(scores[i][some], ids[some], n_positives)]
                else:
                    other = np.flatnonzero((labels != wanted[i]) & (scores[i] <= max(positives[i])))
                    score, taken = scores[i][other], [other[:0]]
                    for p in set(positives[i]):
                        inside = np.flatnonzero((score <= p) & (score >= -(-floor * p // 100)))
                        taken.append(other[inside[_first(score[inside], ids[other[inside]], n_negatives)]])
                    some = np.unique(np.concatenate(taken))
                for to, values in zip(out, (np.full(len(some), numbers[i]), np.full(len(some), names[i]), scores[i][some], ids[some]), strict=True):
                    to.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["anchor", "anchor_id", "score", "id"])

    return run


_KEY = struct.Struct(">QQBQ")
_TOP = 1 << 63


def packed_key(anchor: int, score: int, negative: bool, row: int) -> bytes:
    """Bytes that sort by anchor, then by falling score, positives before negatives of the same score, then by id."""
    return _KEY.pack(anchor + _TOP, _TOP - 1 - score, negative, row + _TOP)


def unpacked_key(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, row = _KEY.unpack(key)
    return anchor - _TOP, _TOP - 1 - score, bool(negative), row - _TOP


def emitted(keys: Iterator[tuple[bytes, int]], n_negatives: int, floor: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Anchor's id, positive, rank, negative and both scores, from (key, anchor's id) in order of the keys; windows holds (positive, score, given) of the anchor at hand."""
    now, windows = None, []
    for key, anchor_id in keys:
        anchor, score, negative, row = unpacked_key(key)
        if anchor != now:
            now, windows = anchor, []
        if not negative:
            windows.append([row, score, 0])
            continue
        windows = [w for w in windows if w[2] < n_negatives and 100 * score >= floor * w[1]]
        for w in windows:
            w[2] += 1
            yield anchor_id, w[0], w[2], row, w[1], score


def hard_negatives(vectors: DataFrame, is_anchor: str = "id % 100 = 0", n_positives: int = 5, n_negatives: int = 5, floor: int = 80, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", rows_at_once: int = ROWS, anchors_at_once: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    is_anchor is a condition on id. Rows without an id or a label, and vectors that are null, empty or
    hold a null or a non-finite component take no part; vectors meet those of the same length only.
    Rows that repeat an id, a label and a vector count once; an id with several of them is several
    rows, whose results as an anchor stand side by side under its id, and none of them is its own
    positive. An inner product beyond a long is an error. Empty tables give empty results.
    """
    good = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vector = F.col(vector_column)
    if vectors.schema[vector_column].dataType.simpleString() not in ("array<float>", "array<double>"):
        vector = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), vector.alias("vector"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(good).distinct()
    rows = written(rows.withColumn("dim", F.size("vector")))
    # The number tells anchors apart that share an id.
    anchors = written(rows.filter(is_anchor).withColumn("anchor", F.monotonically_increasing_id()))
    n, m = (max(1, -(-x.count() // most)) for x, most in ((rows, rows_at_once), (anchors, anchors_at_once)))
    block = lambda count: F.pmod(F.xxhash64("id", "label", "vector"), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    by = ["dim", "part", "anchor_part"]

    def met(asking: DataFrame, floor: int | None) -> DataFrame:
        asking = asking.withColumns({"anchor_part": block(m), "part": all_of(n)})
        dealt = rows.withColumns({"part": block(n), "anchor_part": all_of(m)})
        return asking.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(_best_of_block(n_positives, n_negatives, floor), _FOUND)

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    positives = written(met(anchors, None).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= n_positives).drop("r"))
    scores = positives.groupBy("anchor").agg(F.collect_list("score").alias("positives"))
    negatives = met(anchors.join(scores, "anchor"), floor)
    both = positives.withColumn("negative", F.lit(False)).unionByName(negatives.withColumn("negative", F.lit(True)))
    keys = both.rdd.map(lambda r: (packed_key(r.anchor, r.score, r.negative, r.id), r.anchor_id))
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8])).mapPartitions(lambda it: emitted(it, n_negatives, floor))
    return both.sparkSession.createDataFrame(found, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", verifySchema=False)

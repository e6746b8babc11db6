"""Operator 12: resampling of documents by importance towards a target distribution.

Features are all runs of one to three words, counted in BUCKETS buckets by the CRC-32 of their bytes.
One pass counts the buckets over all documents and the target (each task sends one small row for a
bucket it has), a second sums the gains of each document's features. Documents are drawn without
replacement by adding a Gumbel term, made from a hash of the id, to the weight and taking the highest.
The draw ranks ranges of scores, so no task meets all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.llm.annotate import annotate, small_batches
from dealloom.llm.crc_spans import crc32
from dealloom.llm.scratch import written
from dealloom.llm.words import LOWER, blocks, utf8
from dealloom.operators.ranks import ranked

BUCKETS = 10_000
WIDEST = 3  # words of a feature
LEAST_WORDS = 20  # words of a document that can be drawn
STRETCH = 1 << 17  # words whose features are in memory at a time

_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, each with one space behind it; their starts, their ends, and the word range of each text."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    apart = np.zeros(len(data) + n, np.uint8)  # a byte that is no word behind each text
    apart[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = LOWER[data]
    inside = _WORD[apart]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    behind = np.zeros(len(inside), bool)
    behind[1:] = inside[:-1] & ~inside[1:]
    of = np.searchsorted(np.flatnonzero(first), offsets + np.arange(n + 1))
    keep = inside | behind
    out = np.where(inside[keep], apart[keep], np.uint8(0x20))
    return out, np.flatnonzero(first[keep]), np.flatnonzero(behind[keep]), of


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, widest: int = WIDEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, and text and bucket of each feature, for stretches of words, widths, and starts that are a width apart (such spans don't overlap)."""
    joined, start, end, of = _joined(data, offsets)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    for lo in range(0, len(start), STRETCH):
        for width in range(1, widest + 1):
            for phase in range(width):
                at = np.arange(lo + phase, min(lo + STRETCH, len(start) - width + 1), width)
                if not len(at):
                    continue
                value = crc32(joined, start[at], end[at + width - 1]) % np.uint32(buckets)
                one = text[at] == text[at + width - 1]
                yield width, text[at][one], value[one]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for lo, hi in blocks(data, offsets):
                for _, _, value in features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], buckets):
                    total += np.bincount(value, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    counted = small_batches(texts).select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: thousandths of the log of its smoothed share in the target over that in the documents."""
    all_of, wanted = float(counts.sum()) + len(counts), float(target.sum()) + len(counts)
    return np.array([math.floor(1000 * math.log((t + 1) * all_of / ((s + 1) * wanted))) for s, t in zip(counts.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, keep: Sequence[str], gain: np.ndarray, text: str = "text") -> DataFrame:
    """row (columns in keep), n_words, n_features and weight of each document; none of either for a null text."""

    def compute():
        def of(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
            data, offsets = utf8(texts)
            for lo, hi in blocks(data, offsets):
                n_words, n_features, weight = (np.zeros(hi - lo, np.int64) for _ in range(3))
                sums = np.zeros(hi - lo)
                for width, doc, value in features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], len(gain)):
                    n = np.bincount(doc, minlength=hi - lo)
                    n_features += n
                    n_words += n if width == 1 else 0
                    sums += np.bincount(doc, gain[value], hi - lo)
                weight += sums.astype(np.int64)
                yield lo, hi - lo, [pa.array(x) for x in (n_words, n_features, weight)]

        return of

    return annotate(docs, keep, compute, "n_words long, n_features long, weight long", text)


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel variate from a hash of the seed and the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, keep: Sequence[str], percent: int = 5, seed: int = 42, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """row (columns in keep and the key), n_words, n_features, weight, score and rank (null if not drawn) of each document.

    Of the documents with least_words words or more, percent in a hundred (rounded down) are drawn;
    ties go to the smaller key, those without a key come last. Null and empty texts have no features
    and a weight of 0. Repeated rows have equal scores and are drawn each by itself. Empty tables
    give an empty result, or weights against an empty target.
    """
    keep = list(dict.fromkeys([*keep, key]))
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    # Written, as the ranks sample the rows first and read them after.
    found = written(weights(docs, keep, gain, text).withColumn("score", F.col("weight") + gumbel(F.col(f"row.`{key}`"), seed)))
    n = found.filter(F.col("n_words") >= least_words).count()
    able = ranked(found.filter(F.col("n_words") >= least_words), [F.desc("score"), F.col(f"row.`{key}`").asc_nulls_last()])
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    return able.withColumn("rank", drawn).unionByName(found.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))

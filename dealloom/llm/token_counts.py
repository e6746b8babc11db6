"""Operator 4: token counts by a two-tier lookup of pre-token lengths, without any shuffle.

Pieces of this kind of vocabulary hold the space mark at their start only, and no line feed, so a
text falls into pre-tokens that are encoded independently: runs of spaces with the characters after
them, and line feeds with the characters after them. Lengths of frequent pre-tokens come from a
broadcast table; others are encoded once and kept in a bounded cache of the worker. The table's entries
are chosen from bounded summaries that tasks make of a sample; pre-tokens are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealloom.llm.annotate import annotate
from dealloom.llm.words import blocks

FREQUENT = 50_000  # entries of the broadcast table
SAMPLE_ROWS = 3_000  # documents that choose its entries; counts do not depend on them
SUMMARY = 5_000  # most frequent pre-tokens of the sampled documents of one task
CACHE = 200_000  # entries of a worker's cache
LONGEST = 48  # characters of the longest pre-token that is kept
MARK = "▁"
PRETOKEN = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|\n[^ {MARK}\n]*")


def load(path: str):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("\n" in p or MARK in p.lstrip(MARK) for p in pieces) or model.encode(" ") == model.encode(""):
        raise ValueError("pre-tokens of this model are not independent")
    return model


def length(model, pretoken: str) -> int:
    """Tokens of one pre-token. The model puts a mark before each text, which here stands for the first one."""
    if pretoken[0] == "\n":
        return len(model.encode(pretoken)) - 1
    return len(model.encode(pretoken[1:])) if len(pretoken) > 1 else 1


class Lengths(dict):
    """Frequent lengths, and those found since."""

    def __init__(self, model, frequent: dict[str, int]):
        super().__init__(frequent)
        self.model, self.room = model, CACHE

    def __missing__(self, pretoken: str) -> int:
        n = length(self.model, pretoken)
        if self.room and len(pretoken) <= LONGEST:
            self.room -= 1
            self[pretoken] = n
        return n


def count(lengths: Lengths, text: str | None) -> int:
    return sum(map(lengths.__getitem__, PRETOKEN.findall(" " + text))) if text else 0


def _frequent(sample: DataFrame, model) -> tuple[str, bytes]:
    """The most frequent pre-tokens of some texts, and their lengths, as one string and one byte each."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(x for x in PRETOKEN.findall(" " + (text or "")) if len(x) <= LONGEST)
        best = found.most_common(SUMMARY)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([[x for x, _ in best]], pa.list_(pa.string())), pa.array([[n for _, n in best]], pa.list_(pa.int64()))], ["pretokens", "counts"])

    total: Counter = Counter()
    for r in sample.mapInArrow(part, "pretokens array<string>, counts array<long>").collect():
        for x, n in zip(r["pretokens"], r["counts"], strict=True):
            total[x] += n
    best = sorted(x for x, _ in sorted(total.items(), key=lambda i: (-i[1], i[0]))[:FREQUENT])
    lengths = [length(model, x) for x in best]
    kept = [(x, n) for x, n in zip(best, lengths, strict=True) if n < 256]
    return "\0".join(x for x, _ in kept), bytes(n for _, n in kept)


def token_counts(docs: DataFrame, path: str, keep: list[str], limit: int = 4096) -> DataFrame:
    """row (columns in keep), n_bytes, n_tokens and over_limit of each whole text.

    A null or empty text has no bytes and no tokens. Texts of any length are counted whole. Rows are
    independent, so repeated rows and rows without an id get the same counts.
    """
    sample = docs.select(F.col("text").cast("string").alias("text")).sample(min(1.0, SAMPLE_ROWS / max(1, docs.count())), 7).filter("text IS NOT NULL AND instr(text, '\\0') = 0")
    table = docs.sparkSession.sparkContext.broadcast(_frequent(sample, load(path)))

    def compute():
        names, sizes = table.value
        lengths = Lengths(load(path), dict(zip(names.split("\0"), sizes, strict=True)) if names else {})

        def of(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
            texts = texts.fill_null("")
            at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for lo, hi in blocks(None, at):
                n = [count(lengths, x) for x in texts.slice(lo, hi - lo).to_pylist()]
                yield lo, hi - lo, [pa.array(np.diff(at[lo : hi + 1])), pa.array(n, pa.int64())]

        return of

    return annotate(docs, keep, compute, "n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

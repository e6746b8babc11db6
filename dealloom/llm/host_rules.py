"""Operator 5: quality rules per document, and verdicts on hosts from shrunk failure rates.

Each document gets rule counts from its whole text. Failures are summed by host (map-side first, so
a host with a third of all rows costs one small row per task). The rates of all hosts give a beta
prior by the method of moments; a host's rate is the mean of its posterior. Documents of a host
whose shrunk rate is above host_limit go, as do documents that fail a rule themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealloom.llm.annotate import annotate
from dealloom.llm.scratch import written
from dealloom.llm.words import SPACE, shingles, utf8, words

MIN_WORDS = 50
REPEAT_PERCENT = 50  # words in repeated 3-word windows
SYMBOL_PERCENT = 10  # symbols among the characters of words
DUP_LINE_PERCENT = 30  # repeated lines among lines with a word
HOST_LIMIT = 0.5  # shrunk failure rate above which a whole host goes
BROADCAST_HOSTS = 100_000  # hosts are broadcast up to this count, and shuffled beyond it
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeats(value: np.ndarray, width: int = 3) -> int:
    """Words in windows that are found twice or more."""
    if len(value) <= width:
        return 0
    _, back, n = np.unique(shingles(value, width), return_inverse=True, return_counts=True)
    twice = n[back] > 1
    covered = np.zeros(len(value), bool)
    for k in range(width):
        covered[k : len(value) - width + 1 + k] |= twice
    return int(covered.sum())


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def _counts():
    def of(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
        data, offsets = utf8(texts)
        for lo, at, start, end, value in words(data, offsets):
            n = len(at) - 1
            piece = data[offsets[lo] : offsets[lo + n]]
            ends = offsets[lo : lo + n + 1] - offsets[lo]
            total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[ends])  # noqa: B023, E731
            chars = total(~SPACE[piece] & ((piece & 0xC0) != 0x80))
            lines = [_lines(piece[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
            repeat = [_repeats(value[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield lo, n, [pa.array(np.asarray(x, np.int64)) for x in (np.diff(at), chars, total(_SYMBOL[piece]), [x[1] for x in lines], repeat, [x[0] for x in lines])]

    return of


def rule_counts(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """row (columns in keep) and the rule counts of each text; a null text counts as an empty one."""
    out = annotate(docs, keep, _counts, FIELDS)
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    own = (F.col("n_symbols") * 100 > F.col("word_chars") * SYMBOL_PERCENT) | (F.col("n_dup_lines") * 100 > F.col("n_lines") * DUP_LINE_PERCENT)
    return out.withColumns({"base_failed": base, "failed": base | own})


def host_rates(counts: DataFrame, host: str) -> DataFrame:
    """host, n_docs, n_failed and the shrunk rate; a null host is left out."""
    hosts = counts.select(F.col(f"row.`{host}`").alias("host"), "failed").filter("host IS NOT NULL")
    hosts = written(hosts.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")))
    p = F.col("n_failed") / F.col("n_docs")
    # The spread of the rates less what chance alone gives hosts of these sizes.
    m = hosts.agg(F.sum("n_failed") / F.sum("n_docs"), F.var_samp(p), F.avg(F.lit(1) / F.col("n_docs")), F.count("*")).first()
    mean, spread, inverse, n = m[0] or 0.0, m[1] or 0.0, m[2] or 0.0, m[3]
    between = spread - mean * (1 - mean) * inverse
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if n > 1 and between > 0 else 1e6 if n > 1 else 1.0
    return hosts.withColumn("rate", (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength))


def host_verdicts(docs: DataFrame, keep: Sequence[str], host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """row, the rule counts, base_failed, host_rate and kept for each document.

    A document without a host has no host rate and stands on its own rules. Empty tables give empty
    results; repeated rows are judged alike, each by itself.
    """
    keep = list(dict.fromkeys([*keep, host]))
    rates = host_rates(rule_counts(docs, [host]), host).select("host", F.col("rate").alias("host_rate"))
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_HOSTS else rates
    out = rule_counts(docs, keep).withColumn("host", F.col(f"row.`{host}`")).join(rates, "host", "left")
    kept = ~F.col("failed") & (F.coalesce("host_rate", F.lit(0.0)) <= host_limit)
    return out.withColumn("kept", kept)

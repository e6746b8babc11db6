"""Operator 3: quality scores from a generalised additive model with pairwise interactions.

Each text gives a few numbers; each number falls in a quantile bin. Boosting goes round the features
in turn and adds a small tree of at most four leaves to the feature's lookup table, then does the
same for the pairs of features with the largest gains, on coarser bins. A score is the sum of looked
up values, through the logistic function. Only labels are needed for training, of which a bounded
sample is enough; the features of every text are taken from the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.llm.annotate import annotate
from dealloom.llm.language_id import drawn
from dealloom.llm.words import shingles, utf8, words

SAMPLE = 20_000  # labelled rows that the model is fitted on
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 80, 30, 8
RATE, LEAST, RIDGE = 0.15, 20, 2.0  # learning rate, rows in a leaf, ridge on leaf values
CUT = 0.3

FEATURES = (
    "log_words", "word_length", "long_words", "symbols", "upper", "digits", "bangs", "punctuation", "not_ascii", "bars",
    "distinct_words", "same_as_before", "repeated_windows", "top_word", "distinct_lines", "words_in_line", "short_words", "entropy",
)
_KINDS = {"symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "bangs": b"!?", "punctuation": b".,;:!?", "bars": b"|", "not_ascii": bytes(range(128, 256))}
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}


def _of_text(piece: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray, lines: list[bytes]) -> list[float]:
    n = len(value)
    if not n:
        return [0.0] * len(FEATURES)
    size = end - start
    share = {k: m[piece].sum() / max(1, len(piece)) for k, m in _MASKS.items()}
    _, often = np.unique(value, return_counts=True)
    runs = shingles(value, 3)
    _, again = np.unique(runs, return_counts=True)
    p = often / n
    return [
        np.log1p(n), size.mean(), (size > 15).mean(), share["symbols"], share["upper"], share["digits"], share["bangs"], share["punctuation"], share["not_ascii"], share["bars"],
        len(often) / n**0.8, (value[1:] == value[:-1]).mean() if n > 1 else 0.0, again[again > 1].sum() / len(runs), often.max() / n, len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), (size < 4).mean(), -(p * np.log(p)).sum() / np.log(n + 1),
    ]


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First text, and a row of FEATURES for each text of a block; a text without words has zeros."""
    data, offsets = utf8(texts)
    for lo, at, start, end, value in words(data, offsets):
        rows = []
        for i in range(len(at) - 1):
            piece = data[offsets[lo + i] : offsets[lo + i + 1]]
            lines = [x for x in piece.tobytes().split(b"\n") if x.strip()]
            own = slice(at[i], at[i + 1])
            rows.append(_of_text(piece, start[own], end[own], value[own], lines))
        yield lo, np.array(rows, np.float64).reshape(-1, len(FEATURES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram in two."""
    gl, hl, nl = (np.cumsum(x)[:-1] for x in (g, h, n))
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(nl < LEAST) | (nr < LEAST)] = 0
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Value of each bin by a tree of depth two."""
    out = np.zeros(len(g))

    def grow(lo: int, hi: int, depth: int) -> None:
        gain, cut = _best_cut(g[lo:hi], h[lo:hi], n[lo:hi]) if depth else (0.0, 0)
        if gain > 1e-9:
            grow(lo, lo + cut, depth - 1)
            grow(lo + cut, hi, depth - 1)
        else:
            out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)

    grow(0, len(g), 2)
    return out


def _tree_of_two(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree that cuts one feature, then each side at the other."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        for cut in range(1, len(a)):
            gain, value = -(a.sum() ** 2) / (b.sum() + RIDGE), np.zeros_like(a)
            for side in (slice(0, cut), slice(cut, len(a))):
                s, t, m = a[side].sum(0), b[side].sum(0), c[side].sum(0)
                more, at = _best_cut(s, t, m)
                gain += more + s.sum() ** 2 / (t.sum() + RIDGE)
                for part in (slice(0, at), slice(at, len(s))) if more > 1e-9 else (slice(0, len(s)),):
                    value[side, part] = -s[part].sum() / (t[part].sum() + RIDGE)
            if gain > best[0]:
                best = (float(gain), value.T if turned else value)
    return best


class QualityModel:
    """edges and coarse hold bin borders, tables the looked up values, pairs the interactions."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(f, np.linspace(0, 1, BINS + 1)[1:-1])) for f in x.T] if len(x) else [np.zeros(0)] * len(FEATURES)
        self.coarse = [np.unique(np.quantile(f, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for f in x.T] if len(x) else [np.zeros(0)] * len(FEATURES)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        mean = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(mean / (1 - mean)))
        if len(x):
            self._fit(x, y)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        bins, coarse = self._binned(x, self.edges), self._binned(x, self.coarse)
        z = np.full(len(y), self.base)

        def sums(cell: np.ndarray, n: int) -> list[np.ndarray]:
            p = sigmoid(z)
            return [np.bincount(cell, w, n) for w in (p - y, p * (1 - p), None)]

        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                step = RATE * _tree(*sums(bins[f], len(table)))
                table += step
                z += step[bins[f]]
        grids = {(i, j): (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1) for i, j in combinations(range(len(FEATURES)), 2)}
        cell = lambda i, j: coarse[i] * grids[i, j][1] + coarse[j]
        gain = {k: _tree_of_two(*(s.reshape(g) for s in sums(cell(*k), g[0] * g[1])))[0] for k, g in grids.items()}
        chosen = sorted(gain, key=lambda k: (-gain[k], k))[:PAIRS]
        tables = {k: np.zeros(grids[k]) for k in chosen}
        for _ in range(PAIR_ROUNDS):
            for k in chosen:
                at = cell(*k)
                step = RATE * _tree_of_two(*(s.reshape(grids[k]) for s in sums(at, tables[k].size)))[1]
                tables[k] += step
                z += step.reshape(-1)[at]
        self.pairs = [(i, j, t) for (i, j), t in tables.items()]

    @staticmethod
    def _binned(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, f, "right") for e, f in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, coarse = self._binned(x, self.edges), self._binned(x, self.coarse)
        z = np.full(len(x), self.base)
        for b, table in zip(bins, self.tables, strict=True):
            z += table[b]
        for i, j, table in self.pairs:
            z += table[coarse[i], coarse[j]]
        return sigmoid(z)


def _measured():
    def of(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
        for lo, x in features(texts):
            yield lo, len(x), [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))]

    return of


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> QualityModel:
    """Learns labels.quality from the labelled documents where learn (on doc_id) holds.

    Labels other than 0 and 1 are not used. A document with both labels counts once with each; of rows
    that repeat a doc_id one text counts, the first by a hash, so the driver gets a row for each label
    that is drawn. Without labels every text gets the score 0.5. Equal values of a feature fall in one bin.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1) AND doc_id IS NOT NULL")
    marks = marks.filter(F.lit(True) if learn is None else learn)
    n = marks.agg(F.approx_count_distinct(F.xxhash64("doc_id", "quality"))).first()[0]
    # A label is drawn by its id's hash; equal labels of one id count once. About SAMPLE rows are broadcast.
    marks = marks.filter(drawn(F.xxhash64("doc_id", F.lit(3)), min(1.0, SAMPLE / max(1, n)))).distinct()
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")
    some = some.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text", F.lit(5))).alias("text"))
    rows = annotate(some, ["doc_id", "quality"], _measured, "x array<double>").select("row.doc_id", "row.quality", "x").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    return QualityModel(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in rows], np.float64))


def scores(docs: DataFrame, keep: list[str], model: QualityModel) -> DataFrame:
    """row, score and predicted of each whole text. Only the text is an input; null and empty texts have zeros for features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        known = shared.value

        def of(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
            for lo, x in features(texts):
                yield lo, len(x), [pa.array(known.score(x))]

        return of

    return annotate(docs, keep, compute, "score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))

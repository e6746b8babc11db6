"""Operator 2: language identification by sparse multinomial logistic regression on character n-grams.

Features are hashed counts of 1- to 3-grams of letters and word edges, weighted by 1 + log(count) and
inverse document frequency, with unit length. The document frequencies come from all training texts;
the weights are learned from about SAMPLE distinct texts per language, drawn by hash, by
follow-the-regularised-leader with an elastic net, which leaves most weights at zero; a temperature is
then fitted on texts kept aside. The driver holds the sample's sparse features and a column of weights
for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.llm.annotate import annotate
from dealloom.llm.words import blocks

BITS = 13  # hashed features: 2 ** BITS
SAMPLE = 600  # distinct training texts per language for the weights and the temperature
LANGUAGES = 1000  # values of lang that can be learned; the model has a column of weights for each
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
EPOCHS = 3
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_HASH = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def held_out(doc_id: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a document's id falls in the fold that is never learned from; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def drawn(key: Column, share: Column | float) -> Column:
    """Whether a row is in a sample of this share: its 64-bit key lies in the share's part of all keys."""
    share = F.lit(share) if isinstance(share, float) else share
    return F.shiftrightunsigned(key, 1) <= F.least(F.lit(float(1 << 63)), share * float(1 << 63)).cast("long")


def counts(text: str) -> np.ndarray:
    """How often each hashed feature is found in the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = points > 0x40
    letters &= (points < 0x5B) | (points > 0x60)
    letters &= (points < 0x7B) | (points > 0xA0)
    x = np.where(letters, points, np.uint32(32))
    edge = np.concatenate([[np.uint32(32)], x, [np.uint32(32)]])
    keep = (edge[1:] != 32) | (edge[:-1] != 32)
    x = edge[np.concatenate([[True], keep])]  # runs of other characters count as one
    total = np.zeros(1 << BITS, np.int64)
    code = np.zeros(len(x), np.uint32)
    shift = np.uint32(32 - BITS)
    for n in range(3):
        if len(x) <= n:
            break
        code = (code[: len(x) - n] + x[n:] + np.uint32(n + 1)) * _HASH[n]
        code ^= code >> np.uint32(15)
        total += np.bincount((code * _HASH[0]) >> shift, minlength=1 << BITS)
    return total


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return (x / np.maximum(norm, 1e-12)).astype(np.float32)


class Sparse:
    """Rows of weighted features, dense only where they are read; the last feature is a constant."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.rows, self.shape = rows, (len(rows), (1 << BITS) + 1)

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(part), self.shape[1]), np.float32)
        out[:, -1] = 1
        for row, i in zip(out, part, strict=True):
            row[self.rows[i][0]] = self.rows[i][1]
        return out


def train_ftrl(x: np.ndarray | Sparse, y: np.ndarray, classes: int, seed: int = 0) -> np.ndarray:
    """Weights (features, classes) after EPOCHS passes in small batches; the last feature is a constant."""
    z, n = np.zeros((x.shape[1], classes)), np.zeros((x.shape[1], classes))

    def weights() -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 16):
            part = order[k : k + 16]
            w = weights()
            p = softmax(x[part] @ w)
            p[np.arange(len(part)), y[part]] -= 1
            g = x[part].T @ p / len(part)
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
            z += g - sigma * w
            n += g * g
    return weights()


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, on a grid of powers."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 241))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights, heat

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability; a text that is null or has no letter is unknown, with score 0."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        for k in range(0, len(known), 64):
            part = known[k : k + 64]
            x = weighted(np.stack([counts(texts[i]) for i in part]), self.idf)
            p = softmax((x @ self.weights[:-1] + self.weights[-1]) / self.heat)
            for i, best, row in zip(part, p.argmax(axis=1), p, strict=True):
                names[i], scores[i] = self.languages[best], row[best]
        return names, scores


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, and texts with each feature, of one task."""
    total, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in _pieces(batch.column("text")):
            total += counts(text) > 0
            n += 1
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array([n, *total[some].tolist()], pa.int64())], ["feature", "n"])


def _pieces(texts: pa.Array) -> Iterator[str]:
    for k in range(0, len(texts), 256):
        yield from texts.slice(k, 256).to_pylist()


def train(docs: DataFrame, learn: Column | None = None) -> LanguageModel:
    """Learns from rows of docs (doc_id, text, lang) where learn holds, and text and lang are not null.

    More than LANGUAGES values of lang are an error, as such a column is no language. Texts are drawn
    at a rate from the number of distinct texts, so copies neither crowd out a language nor thin it.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (F.lit(True) if learn is None else learn).alias("learn"))
    rows = rows.filter("learn AND text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("text", F.lit(7)).alias("draw"))
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(size) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not size:
        return LanguageModel([], np.ones(1 << BITS), np.zeros(((1 << BITS) + 1, 1)), 1.0)
    parts = rows.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    seen = {r["feature"]: r["n"] for r in parts}
    idf = np.log((1 + seen.pop(-1)) / (1.0 + np.array([seen.get(i, 0) for i in range(1 << BITS)]))) + 1
    # A text is drawn by its own hash, at its language's rate; equal texts count once, however many there are.
    rate = F.create_map(*[x for lang, n in size.items() for x in (F.lit(lang), F.lit(min(1.0, SAMPLE / max(1, n))))])
    some = rows.filter(drawn(F.col("draw"), rate[F.col("lang")])).groupBy("lang", "draw").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in _pieces(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array([c.astype("<u4")[np.flatnonzero(c)].tobytes() for c in found], pa.binary()), pa.array([np.flatnonzero(c).astype("<u2").tobytes() for c in found], pa.binary())], ["lang", "draw", "n", "at"])

    sample = some.select("lang", "draw", "text").mapInArrow(features, "lang string, draw long, n binary, at binary").collect()
    sample.sort(key=lambda r: (r["lang"], r["draw"]))
    if not sample:
        return LanguageModel([], idf, np.zeros(((1 << BITS) + 1, 1)), 1.0)
    languages = sorted({r["lang"] for r in sample})
    each = []
    for r in sample:
        at = np.frombuffer(r["at"], "<u2")
        each.append((at, weighted(np.frombuffer(r["n"], "<u4"), idf[at])))
    y = np.array([languages.index(r["lang"]) for r in sample])
    aside = np.arange(len(each)) % 5 == 4
    weights = train_ftrl(Sparse([x for x, a in zip(each, aside, strict=True) if not a]), y[~aside], len(languages))
    kept = Sparse([x for x, a in zip(each, aside, strict=True) if a])
    logits = [kept[np.arange(k, min(k + 64, len(kept)))] @ weights for k in range(0, len(kept), 64)]
    heat = temperature(np.concatenate(logits), y[aside]) if logits else 1.0
    return LanguageModel(languages, idf.astype(np.float32), weights.astype(np.float32), heat)


def predictions(docs: DataFrame, keep: list[str], model: LanguageModel) -> DataFrame:
    """row, lang_pred and score of each whole text.

    A text that is null, empty or without a letter is "und" with score 0; so is every text if there
    was nothing to learn from. Only the text is an input, so repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        known = shared.value

        def of(texts: pa.Array) -> Iterator[tuple[int, int, list]]:
            at = np.arange(len(texts) + 1)
            for lo, hi in blocks(None, at, 256):
                names, scores = known.predict(texts.slice(lo, hi - lo).to_pylist())
                yield lo, hi - lo, [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return of

    return annotate(docs, keep, compute, "lang_pred string, score double")

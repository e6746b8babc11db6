"""Operator 11: benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words, words 64-bit hashes, and each run of KGRAM words one hash. A window of SPAN words
keeps the smallest of its k-gram hashes, so two texts that share SPAN words in a row keep the same hash
for them and can't miss each other. The prints of all benchmark windows go to every task, in parts of at
most PRINTS, one pass over the documents for each part; a document's windows meet them there, and no
document is shuffled. A hit is extended to its whole window, whose words are compared as text, so a
chance equality of hashes changes nothing. Items of fewer words are one window, found by a hash of all of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.llm.scratch import written

SPAN = 10  # words of a window
KGRAM = 5  # words of a hash, of which a window holds SPAN - KGRAM + 1
PRINTS = 1_000_000  # hashes of benchmark windows that are broadcast at a time, of 8 bytes each
WINDOWS = 200_000  # benchmark windows whose words are broadcast; more are joined by a shuffle
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Of a text of ASCII characters alone, lower() changes A-Z only.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _gram(at: Column, n: int) -> Column:
    """Hash of n words from a position on."""
    return F.xxhash64(F.lit(n), *[F.get("h", at + k) for k in range(n)])


def _print(at: Column, length: int, span: int, kgram: int) -> Column:
    """Hash by which a window of length words is found: the smallest of its k-grams, or the whole of a shorter one. Null where the text ends before."""
    found = F.least(*[_gram(at + k, kgram) for k in range(span - kgram + 1)]) if length == span > kgram else _gram(at, length)
    return F.when((at >= 0) & (at + length <= F.size("h")), found)


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))


def _words_at(at: Column, length: Column | int) -> Column:
    return F.array_join(F.slice("w", at + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, span: int = SPAN, kgram: int = KGRAM, item: str = "item_id", text: str = "text") -> DataFrame:
    """length, print, window (its words) and items (sorted ids as strings) of each distinct window of the benchmark.

    Items without an id or without words have none; rows that repeat an id are one item. A window's
    ids are gathered in one row, as they are a part of the result of each document that holds it.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).filter("item IS NOT NULL AND size(w) > 0").distinct()
    items = _hashed(items).withColumn("length", F.least(F.size("w"), F.lit(span)))
    at = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))))
    prints = [F.when(F.col("length") == n, _print(F.col("at"), n, span, kgram)) for n in range(1, span + 1)]
    at = at.select("length", F.coalesce(*prints).alias("print"), _words_at(F.col("at"), F.col("length")).alias("window"), "item")
    return at.groupBy("length", "print", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str], span: int = SPAN, kgram: int = KGRAM, text: str = "text", item: str = "item_id", prints: int = PRINTS, windows: int = WINDOWS) -> DataFrame:
    """row (columns in keep), n_words, n_hit, matches (start and length in words of each window found) and items of each document.

    A word is hit inside any occurrence of a benchmark window. Null and empty texts have no words
    and are not hit, no more than any text if the benchmark is empty. Repeated rows are judged each
    by itself; equal texts alike. A window's matches stay with their row, so no group grows with the
    number of documents. Empty documents give an empty result.
    """
    if not 0 < kgram <= span:
        raise ValueError("a k-gram has at least one word and at most those of a window")
    known = written(benchmark_windows(benchmark, span, kgram, item, text))
    # At most span rows.
    lengths = sorted({span, *(r.length for r in known.select("length").distinct().collect())}, reverse=True)
    hashes = known.select("print").distinct()
    parts = max(1, -(-hashes.count() // prints))
    texts = known.select("window", "items")
    texts = F.broadcast(texts) if known.count() <= windows else texts
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), words(F.col(text)).alias("w"))
    # Several passes have to agree on the ids.
    rows = _hashed(written(rows) if parts > 1 else rows)
    # Place -1 is the document itself, so that it stays without any hit.
    at = rows.withColumn("at", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("h") - min(lengths), F.lit(-1)))))
    each = [F.struct(F.lit(n).alias("length"), _print(F.col("at"), n, span, kgram).alias("print")) for n in lengths]
    at = at.select("id", "row", "w", "at", F.explode(F.array(*each)).alias("x")) if len(each) > 1 else at.select("id", "row", "w", "at", each[0].alias("x"))
    own = (F.col("at") < 0) & (F.col("x.length") == span)
    found = []
    for part in range(parts):
        mine = hashes.filter(F.pmod("print", F.lit(parts)) == part) if parts > 1 else hashes
        hit = at.join(F.broadcast(mine.withColumn("known", F.lit(True))), F.col("x.print") == F.col("print"), "left")
        hit = hit.filter(F.col("known") | own) if part == 0 else hit.filter("known")
        match = F.when(F.col("at") >= 0, F.struct(F.col("at").alias("start"), F.col("x.length").alias("length")))
        hit = hit.select("id", F.when(own, F.col("row")).alias("row"), F.when(own, F.size("w")).alias("n_words"), match.alias("match"), F.when(match.isNotNull(), _words_at(F.col("at"), F.col("x.length"))).alias("window"))
        found.append(hit.join(texts, "window", "left").filter("match IS NULL OR items IS NOT NULL"))
    found = reduce(DataFrame.unionByName, found)
    out = found.groupBy("id").agg(F.first("row", ignorenulls=True).alias("row"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_list("match")).alias("matches"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    end = lambda m: m["start"] + m["length"]
    add = lambda a, m: F.struct(F.greatest(a["end"], end(m)).alias("end"), (a["n"] + F.greatest(F.lit(0), end(m) - F.greatest(a["end"], m["start"]))).alias("n"))
    n_hit = F.aggregate("matches", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add, lambda a: a["n"])
    return out.select("row", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), "matches", "items")

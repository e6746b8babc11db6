import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_host_rules import plain
from tests.llm.test_jaccard_join import brute

P = pytest.importorskip("public_tokenizers")


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    (_, language), (_, quality), (_, near), (_, pack) = corpus_pipeline.STAGES

    known = language(spark, docs, sf)
    rows = known.collect()
    assert known.columns == columns and {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)} >= {r.doc_id for r in rows}
    assert len(rows) > 0.95 * docs.count()

    docs = spark.createDataFrame(rows, docs.schema)
    good = quality(spark, docs, sf).collect()
    for r in good:
        n, chars, symbols, dup, repeat, lines = plain(r.text)
        assert n >= 50 and 100 * repeat <= 50 * n and 100 * symbols <= 10 * chars and 100 * dup <= 30 * lines
    assert len(good) > 0.6 * len(rows)

    docs = spark.createDataFrame(good, docs.schema)
    unique = near(spark, docs, sf).collect()
    assert {r.doc_id for r in unique} == {c for _, _, c in brute([(r.doc_id, r.text) for r in good], percent=80, width=5)}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = pack(spark, spark.createDataFrame(unique, docs.schema), sf).collect()
    want = set()
    for r in unique:
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 0]
        want |= {(r.doc_id, k // 2048, len(ids[k : k + 2048]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[k : k + 2048]))) for k in range(0, len(ids), 2048)}
    assert {(p.doc_id, p.piece, p.length, p.ids_crc32) for p in pieces} == want
    fill = {}
    for p in pieces:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * sum(fill.values()) / 2048 + 1


def test_repeated_and_empty_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(5, "a b c d", "en", "s", 1), (5, "a b c d", "en", "s", 1), (None, "a b c d", "en", "s", 1), (7, "a b c d", "en", "s", 1), (8, "q r s", "en", "s", 1)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), "")
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 5, 8]
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_odd_documents_and_clashing_columns(spark):
    """Null, empty and very long texts, ties, and columns named like those of the operators."""
    words = " ".join(f"word{i % 400} and the other text {i % 61}" for i in range(400))
    long = " ".join(f"the long text goes on with number{i} here" for i in range(60000))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, host int, found string, kept string, n int, failed string, score double, piece string"
    more = ("r", 1, "f", "k", 2, "x", 0.5, "p")
    rows = [(i, t, "en", s, 1, *more) for i, (t, s) in enumerate([(None, "a"), ("", "a"), (words, None), (words, "a"), (words + " end", "b"), (long, "b"), ("123 456", "b")])]
    docs = spark.createDataFrame(rows, schema)
    learned = spark.createDataFrame([(100 + i, f"{words} {i}", "en", "c", 1, *more) for i in range(30)], schema)
    known = corpus_pipeline.language(spark, docs.unionByName(learned), "")
    assert known.columns == docs.columns and not {0, 1, 6} & {r.doc_id for r in known.collect()}
    good = corpus_pipeline.quality(spark, docs, "")
    assert good.columns == docs.columns and not {0, 1, 6} & {r.doc_id for r in good.collect()}
    unique = corpus_pipeline.near_duplicates(spark, docs, "")
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == [0, 1, 2, 5, 6]
    pieces = corpus_pipeline.packing(spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == set(range(7)) and max(p.length for p in pieces) == 2048
    assert sum(p.length for p in pieces if p.doc_id in (0, 1)) == 2


def test_language_stage_without_any_language(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, None, None, "s", 0), (3, "more words", None, "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 2, 3]
    named = docs.withColumn("lang", F.when(F.col("text").isNull(), "en"))
    assert corpus_pipeline.language(spark, named, "").count() == 3

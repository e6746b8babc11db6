"""A corpus pipeline over documents: language, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The first three
return the columns of documents; the last returns the places of pieces in training sequences. An
empty table gives an empty one. Columns that documents may have besides, of any name, are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealloom.llm.host_rules import host_verdicts
from dealloom.llm.jaccard_join import BROADCAST_IDS, JaccardJoin
from dealloom.llm.language_id import UNKNOWN, predictions, train
from dealloom.llm.packing import packed
from dealloom.llm.scratch import written

LEAST_SURE = 0.5  # calibrated probability below which a document's language is in doubt
WIDTH, PERCENT = 5, 80  # words of a shingle, and the similarity of near-duplicates in per cent
SEQUENCE = 2048


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter (null and empty texts too), or with a score below LEAST_SURE, go.

    Equal texts have equal scores, so repeated rows stay or go together. Where no document has both a
    text and a language there is nothing to tell languages by, and all documents stay.
    """
    model = train(docs)
    if not model.languages:
        return docs
    out = predictions(docs, docs.columns, model)
    return out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SURE)).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host does; one without a host stands by itself. Repeated rows are judged alike."""
    return host_verdicts(docs, docs.columns).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, which names the group.

    Texts without words are near nothing. Rows that repeat a doc_id are one document, of which one
    row stays; rows without a doc_id stay.
    """
    found = JaccardJoin(docs, WIDTH, PERCENT).components()
    gone = written(found.filter("doc_id <> component_id").select("doc_id").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = written(found.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most SEQUENCE tokens."""
    out = packed(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], SEQUENCE)
    return out.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language), ("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("best_fit_packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dealloom.llm import quality_gam
from dealloom.llm.language_id import held_out
from dealloom.llm.quality_gam import FEATURES, QualityModel, features, scores, train

DIR = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    one = label == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = train(docs, labels, ~held_out("doc_id", 5, 0))
    asked = docs.join(labels.select("doc_id", "quality").filter(held_out("doc_id", 5, 0)), "doc_id")
    rows = scores(asked, ["doc_id", "quality"], model).collect()
    y, p = np.array([r.row.quality for r in rows]), np.array([r.score for r in rows])
    assert len(rows) > 500 and auc(p, y) > 0.95
    assert np.mean([r.predicted == r.row.quality for r in rows]) > 0.93
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((QualityModel(x, y).score(x) > 0.5) == y).mean() > 0.95


def test_odd_rows(spark):
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "a b", "s"), (3, "a b", "s"), (None, "w " * 40000, "s")], schema)
    labels = spark.createDataFrame([(3, 1), (2, None), (None, 0), (1, 7)], "doc_id long, quality int")
    for m in (train(docs, labels), train(docs, labels.limit(0))):
        rows = scores(docs, ["doc_id", "score"], m).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert scores(docs.limit(0), ["doc_id"], train(docs, labels.limit(0))).count() == 0
    assert np.isfinite(next(features(pa.array(["", "one", " \n", "x" * 50000])))[1]).all()


def test_scores_against_brute_force(spark):
    """Each score is the base and the looked up values of the text's features, one by one."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = train(docs, labels, ~held_out("doc_id", 5, 0))
    rows = scores(docs, ["doc_id", "text"], model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ((_, x),) = features(pa.array([r.row.text]))
        at = lambda edges, v: sum(e <= v for e in edges)
        z = model.base + sum(t[at(e, v)] for t, e, v in zip(model.tables, model.edges, x[0]))
        z += sum(t[at(model.coarse[i], x[0][i]), at(model.coarse[j], x[0][j])] for i, j, t in model.pairs)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.3)


def test_features_against_plain_ones():
    text = "Aa bb,  aa bb cc! \n\nbb 12 ### aa bb cc\naa bb cc"
    x = dict(zip(FEATURES, next(features(pa.array([text])))[1][0]))
    words = text.split()
    lines = [t for t in text.split("\n") if t.strip()]
    assert np.isclose(x["log_words"], np.log1p(len(words))) and np.isclose(x["word_length"], np.mean([len(w) for w in words]))
    assert np.isclose(x["symbols"], text.count("#") / len(text)) and np.isclose(x["words_in_line"], len(words) / len(lines))
    assert np.isclose(x["top_word"], max(words.count(w) for w in words) / len(words)) and np.isclose(x["distinct_lines"], len(set(lines)) / len(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    assert np.isclose(x["repeated_windows"], sum(windows.count(w) > 1 for w in windows) / len(windows))


def test_contradicting_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i % 5} text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i in range(40) for q in (0, 1, 1)], "doc_id long, quality int")
    assert all(abs(r.score - 0.5) < 0.05 for r in scores(docs, ["doc_id"], train(docs, labels)).collect())


def test_one_row_comes_to_the_driver_for_each_label(spark, monkeypatch):
    """A label whose doc_id most rows have, and many repeated labels."""
    docs = spark.range(60_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("the same words again "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.range(100, 140).select(F.col("id").alias("doc_id"), F.concat(F.lit("other words "), F.col("id").cast("string")).alias("text")))
    labels = spark.createDataFrame([(7, 1)] * 5000 + [(i, i % 2) for i in range(100, 140)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_gam, "QualityModel", lambda x, y: seen.append((x, y)))
    train(docs, labels)
    ((x, y),) = seen
    assert len(x) == 41 and y.sum() == 21
    # The rate comes from distinct labels, so repeated ones don't thin the sample.
    monkeypatch.setattr(quality_gam, "SAMPLE", 41)
    train(docs, labels)
    assert len(seen[1][0]) > 30

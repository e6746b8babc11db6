import numpy as np
import pytest
from pyspark.sql import functions as F

from dealloom.llm.language_id import counts, held_out, predictions, softmax, temperature, train, train_ftrl

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet(DOCS)
    model = train(docs, ~held_out())
    rows = predictions(docs, ["doc_id", "lang"], model).withColumn("held_out", held_out("row.doc_id")).collect()
    out = [r for r in rows if r.held_out and r.row.lang]
    assert len(rows) == docs.count() and len(out) > 150
    assert np.mean([r.lang_pred == r.row.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    loss = np.mean([r.score - (r.lang_pred == r.row.lang) for r in out])
    assert abs(loss) < 0.1
    assert (model.weights == 0).mean() > 0.3  # the elastic net leaves zeros


def test_labels_and_ids_are_no_inputs(spark):
    docs = spark.read.parquet(DOCS)
    model = train(docs, ~held_out())
    some = docs.limit(50)
    moved = some.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "doc_id": F.col("doc_id") + 1000})
    one = [(r.lang_pred, r.score) for r in predictions(some, ["doc_id"], model).collect()]
    assert one == [(r.lang_pred, r.score) for r in predictions(moved, ["doc_id"], model).collect()]


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred int"
    rows = [(1, "the cat and the dog", "en", 1), (2, "der Hund und die Katze", "de", 1), (3, None, "en", 1), (4, "", "de", 1), (5, "123 !!", "de", 1), (None, "the dog", None, 1), (6, "the and " * 50000, "en", 1), (2, "der Hund und die Katze", "de", 1)]
    docs = spark.createDataFrame(rows, schema)
    out = {r.row.doc_id: r for r in predictions(docs, ["doc_id", "lang_pred"], train(docs)).collect()}
    assert [out[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and out[3].score == 0
    assert out[None].lang_pred in ("en", "de") and out[6].lang_pred in ("en", "de") and out[1].row.lang_pred == 1
    # Numerals are no letters; one letter of any script is enough.
    numerals = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(["\u00bd \u00be", "\u00b2\u00b3 \u2460", "\u2167", "\u3007", "_ 1", "\u4e2d", "\u01c5", "\u00aa"])], schema)
    assert [r.lang_pred == "und" for r in predictions(numerals, ["doc_id"], train(docs)).orderBy("row.doc_id").collect()] == [True] * 5 + [False] * 3
    empty = spark.createDataFrame([], schema)
    assert predictions(empty, ["doc_id"], train(empty)).count() == 0
    assert {r.lang_pred for r in predictions(docs, ["doc_id"], train(empty)).collect()} == {"und"}


def test_parts():
    assert counts("").sum() <= 2 and counts("aaa").sum() == counts("AAA!?").sum()
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 300)
    x = np.hstack([np.eye(6, dtype=np.float32)[y * 2 + rng.integers(0, 2, 300)], np.ones((300, 1), np.float32)])
    assert ((x @ train_ftrl(x, y, 3)).argmax(1) == y).all()
    logits = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert abs(temperature(logits * 5, y) - 5) < 1


def plain_prediction(model, text):
    """A prediction feature by feature, from the text's own characters."""
    import math

    total = counts(text)
    x = {i: math.log1p(n) * model.idf[i] for i, n in enumerate(total) if n}
    norm = math.sqrt(sum(v * v for v in x.values()))
    z = [sum(v / norm * float(model.weights[i, k]) for i, v in x.items()) + float(model.weights[-1, k]) for k in range(len(model.languages))]
    e = [math.exp((v - max(z)) / model.heat) for v in z]
    best = max(range(len(z)), key=z.__getitem__)
    return model.languages[best], e[best] / sum(e)


def test_predictions_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs, ~held_out())
    for r in predictions(docs, ["doc_id", "text"], model).collect():
        lang, score = plain_prediction(model, r.row.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    from dealloom.llm import language_id

    monkeypatch.setattr(language_id, "SAMPLE", 30)
    seen = []
    monkeypatch.setattr(language_id, "train_ftrl", lambda x, y, n: seen.append(np.bincount(y, minlength=n).tolist()) or train_ftrl(x, y, n))
    # Nearly all rows of one language are copies of one text; it still has its sample.
    rows = [(None, "the same text for all", "en")] * 30_000 + [(None, f"an english text number {i} with the words of it", "en") for i in range(300)] + [(None, f"un texte {i} ici dans les mots", "fr") for i in range(2000)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"] and all(12 <= n <= 40 for n in seen[0])
    asked = spark.createDataFrame([(1, "this is an english text with words"), (2, "voici un texte dans les mots"), (3, "number the words of an english text")], "doc_id long, text string")
    assert [r.lang_pred for r in predictions(asked, ["doc_id"], model).orderBy("row.doc_id").collect()] == ["en", "fr", "en"]
    with pytest.raises(ValueError):
        train(spark.range(1500).selectExpr("id AS doc_id", "'text' AS text", "CAST(id AS STRING) AS lang"))


def test_large_tables_still_give_a_sample(spark):
    from dealloom.llm.language_id import drawn

    keys = spark.range(200000).select(F.xxhash64("id").alias("k"))
    assert 150 < keys.filter(drawn(F.col("k"), 0.001)).count() < 250
    assert keys.filter(drawn(F.col("k"), 1.0)).count() == 200000
    assert spark.range(1).select(drawn(F.lit(5000), 600 / 10**14).alias("x")).first().x  # a share of 6e-12 is not nothing

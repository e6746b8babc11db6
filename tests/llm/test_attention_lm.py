import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealloom.llm import attention_lm as lm
from dealloom.llm.language_id import held_out
from dealloom.llm.word_bpe import WordBpe

P = pytest.importorskip("public_tokenizers")
WORDS = P.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def check(rows, got):
    counts = Counter(t for _, x, learn in rows if learn for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    for i, text, _ in rows:
        ts, r = tokens(text), got[i]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score <= 0 and math.isfinite(r.score)


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP_WORDS", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "Ünseen ÄÖ word"), (-5, "the " * 20000)], "doc_id long, text string")
    docs = docs.unionByName(odd).withColumn("n_tokens", F.lit("x"))
    learn = ~held_out("doc_id", 5, 1)
    rows = docs.select("doc_id", "text", learn).collect()
    out = lm.scores(docs, WORDS, ["doc_id", "n_tokens"], learn).collect()
    check(rows, {r.row.doc_id: r for r in out})
    # On texts that were not learned from, the model does better than chance over its subword ids by far.
    new = [r for r in out if r.row.doc_id >= 0 and not next(x[2] for x in rows if x[0] == r.row.doc_id)]
    assert sum(r.score for r in new) > -7 * sum(r.n_tokens for r in new)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (1, "a b")], "doc_id long, text string")
    out = lm.scores(docs, WORDS, ["doc_id"], F.lit(False)).collect()
    assert sorted((r.row.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in out) == [(1, 3, 0, 0), (1, 3, 0, 0), (2, 1, 0, 0)]
    assert lm.scores(docs.limit(0), WORDS, ["doc_id"], F.lit(True)).count() == 0


def plain_score(model, vocabulary, ids):
    """The score by its definition: window by window and place by place, over all ids."""
    w = {n: x.astype(np.float64) for n, x in model.w.items()}
    number = [vocabulary.number[-1]] * 2 + [vocabulary.number[i] for i in ids]
    total, at, first = 0.0, 0, True
    while first or at + lm.CONTEXT < len(ids):
        for i in range(0 if first else lm.CONTEXT, min(lm.WINDOW, len(ids) - at)):
            e = [w["one"][number[at + j + 1]] + w["two"][number[at + j]] for j in range(i + 1)]
            a = np.array([e[i] @ w["q"] @ (x @ w["k"]) / math.sqrt(lm.WIDTH) + w["far"][i - j] for j, x in enumerate(e)])
            a = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
            h = e[i] + sum(p * (x @ w["v"]) for p, x in zip(a, e)) @ w["o"]
            g = h + np.maximum(h @ w["in"] + w["in0"], 0) @ w["out"]
            top = lm.log_softmax(g @ w["top"] + w["top0"])
            p = np.concatenate([top[c] + lm.log_softmax(g @ w["sub"][c] + w["sub0"][c]) for c in range(lm.CLASSES)])
            assert abs(np.exp(p).sum() - 1) < 1e-9
            total += p[vocabulary.number[ids[at + i]]] / math.log(10) + vocabulary.share[ids[at + i]]
        first, at = False, at + lm.WINDOW - lm.CONTEXT
    return total


def some_vocabulary(seed=2):
    return lm.Vocabulary(np.random.default_rng(seed).integers(0, 50, len(WordBpe(WORDS).names) + 1))


def test_gradients():
    rng = np.random.default_rng(1)
    net = lm.Attention(some_vocabulary().mass, seed=3)
    windows = rng.integers(0, 60, (3, lm.WINDOW + 2))
    windows[1, 30:] = -1
    weight = np.array([1.0, 2.0, 0.5])
    net.w = {n: x.astype(np.float64) for n, x in net.w.items()}
    loss, g = net.gradients(windows, weight)
    assert np.isfinite(loss) and set(g) == set(net.w)
    for name, x in net.w.items():
        at = tuple(int(rng.integers(s)) for s in x.shape)
        at = {"one": (int(windows[0, 1]), 2), "two": (int(windows[0, 0]), 2), "sub": (0, 3, 5), "sub0": (1, 4), "far": (2,)}.get(name, at)
        old, h = x[at], 1e-5
        x[at] = old + h
        up = net.gradients(windows, weight)[0]
        x[at] = old - h
        down = net.gradients(windows, weight)[0]
        x[at] = old
        assert abs((up - down) / (2 * h) - g[name][at]) < 1e-6 + 1e-3 * abs(g[name][at]), name


def test_gradients_of_a_batch_are_those_of_its_parts():
    """Batches of several cache-sized parts, with rows of no target, and memory that is kept between batches."""
    rng = np.random.default_rng(6)
    net = lm.Attention(some_vocabulary().mass, seed=3)
    net.w = {n: x.astype(np.float64) for n, x in net.w.items()}
    windows = rng.integers(0, lm.START, (2 * lm.NEAR + 9, lm.WINDOW + 2))
    windows[5, 20:] = windows[lm.NEAR + 1, 3:] = -1
    weight = rng.uniform(1, 3, len(windows))
    loss, whole = net.gradients(windows, weight)
    parts = [net.gradients(windows[b : b + 11], weight[b : b + 11]) for b in range(0, len(windows), 11)]
    share = np.array([((windows[b : b + 11, 2:] >= 0).sum(1) * weight[b : b + 11]).sum() for b in range(0, len(windows), 11)])
    share /= share.sum()
    assert abs(loss - sum(s * x for s, (x, _) in zip(share, parts, strict=True))) < 1e-9
    for name, x in whole.items():
        assert np.allclose(x, sum(s * g[name] for s, (_, g) in zip(share, parts, strict=True)), atol=1e-10), name


def test_texts_are_split_into_ids_once(spark, monkeypatch):
    """Texts are read to count their words and to split them into ids; learning and scoring read the ids."""
    read = []
    monkeypatch.setattr(lm, "written", lambda df, *by, f=lm.written, **how: (read.append([x for x in df.inputFiles() if "testdata" in x]), f(df, *by, **how))[1])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    out = lm.scores(docs, WORDS, ["doc_id"], ~held_out("doc_id", 5, 1))
    assert out.count() == 60 and not [x for x in out.inputFiles() if "testdata" in x]
    assert sum(map(bool, read)) == 2, read


def test_numbers_come_back():
    rows, sizes = np.arange(-1, 8), np.array([3, 0, 1, 5])
    back, n = lm.numbers_of(lm.binaries(rows, sizes).slice(1))
    assert back.tolist() == rows[3:].tolist() and n.tolist() == [0, 1, 5]


def test_scores_equal_the_definition():
    rng = np.random.default_rng(4)
    vocabulary = some_vocabulary()
    net = lm.Attention(vocabulary.mass, seed=5)
    net.flat += rng.normal(size=len(net.flat)).astype(np.float32) * 0.05
    texts = [rng.integers(0, len(vocabulary.share), n) for n in (1, 2, 9, 39, 40, 41, 69, 70, 71, 100, 230)]
    got = lm.Scorer(net, vocabulary).log_probabilities(np.concatenate(texts), np.array([len(t) for t in texts]))
    want = [plain_score(net, vocabulary, t.tolist()) for t in texts]
    assert np.allclose(got, want, rtol=1e-4)


def test_large_weights_stay_finite():
    vocabulary = some_vocabulary()
    net = lm.Attention(vocabulary.mass, seed=5)
    net.flat *= 12
    ids = np.random.default_rng(4).integers(0, 49000, 300)
    got = lm.Scorer(net, vocabulary).log_probabilities(ids, np.array([200, 100]))
    assert np.isfinite(got).all()
    assert np.allclose(got, [plain_score(net, vocabulary, x.tolist()) for x in (ids[:200], ids[200:])], rtol=1e-3)


def test_lexicon(monkeypatch):
    """Ids and shares of words do not depend on what the lexicon kept before."""
    monkeypatch.setattr(lm, "CACHE", 5)
    bpe = WordBpe(WORDS)
    words = [b"the", b"cat"]
    ids = bpe.encode_raw(words)
    book = lm.Lexicon(bpe, list(words), np.array([-1.0, -2.0]), np.frombuffer(b"".join(ids), "<i4"), np.array([len(i) // 4 for i in ids]))
    for text in ("The cat sat, on the MAT.", "one two three four five six seven", "", "the Ünion the", "cat <|endoftext|> x" * 3):
        numbers, n = book.numbers([text.encode(), b"cat"])
        row, size = book.ids_of(numbers)
        raw = [*text.encode().lower().split(), b"cat"]
        assert n.tolist() == [len(raw) - 1, 1] and [book.words[i] for i in numbers] == raw
        assert row.tobytes() == b"".join(bpe.encode_raw(raw)) and size.tolist() == [len(x) // 4 for x in bpe.encode_raw(raw)]
        assert [None if np.isnan(s) else s for s in book.share[numbers]] == [{b"the": -1.0, b"cat": -2.0}.get(w) for w in raw]


def test_weights_do_not_depend_on_partitions_and_copies_are_dealt_out(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["sun", "moon", "star", "sky"], 300)) for _ in range(40)] + ["same text of all copies"] * 200
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    vocabulary = some_vocabulary()
    one = lm.train(docs.repartition(1), WORDS, vocabulary).flat
    two = lm.train(docs.repartition(7), WORDS, vocabulary).flat
    assert np.abs(one - two).max() < 1e-5 and np.abs(one - lm.Attention(vocabulary.mass).flat).max() > 0.01
    found = list(lm.training_windows([b"", b"a b", b"word " * 5000]))
    assert len(found) == 2 + -(-25000 // lm.STRETCH) and found[0] == (True, [], True) or found[0][1] == []


def test_every_id_of_a_text_is_a_target_once():
    bpe = WordBpe(WORDS)
    end = len(bpe.names)
    texts = [b"", b" ", b"A b", b"one two three four " * 2000, b"x" * 9000 + b" tail of the text", b"a\tlong " + b"y" * 4090 + b"\nline " * 900, "Ünion süß ".encode() * 1500]
    found = list(lm.training_windows(texts))
    rows = [(first, np.frombuffer(b"".join(bpe.encode_raw(words)), "<i4"), last) for first, words, last in found]
    windows = list(lm.cut_windows(rows, end))
    got, at = [], -1
    for w in windows:
        if w[0] == w[1] == end + 1:
            got.append([])
            at += 1
        assert 2 < len(w) <= lm.WINDOW + 2
        before = ([end + 1] * 2 + got[at])[-2:]
        assert w[:2].tolist() == before
        got[at] += w[2:].tolist()
    assert got == [np.frombuffer(b"".join(bpe.encode_raw(t.lower().split())), "<i4").tolist() + [end] for t in texts]


def test_windows_of_many_texts_are_those_of_each():
    bpe = WordBpe(WORDS)
    vocabulary = some_vocabulary()
    end = len(bpe.names)
    texts = [b"", b" ", b"A b", b"one two three four " * 2000, b"", b"x" * 9000 + b" tail", "Ünion süß ".encode() * 1500, b"a " * 39, b"a " * 40]
    lexicon = lm.Lexicon(bpe, [], np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64))
    ids, sizes = lm.ids_with_ends(lexicon, *lexicon.numbers(texts), end)
    got = np.concatenate(list(lm.windows_in(vocabulary.number[ids], sizes, 7))).tolist()
    rows = [(first, np.frombuffer(b"".join(bpe.encode_raw(words)), "<i4"), last) for first, words, last in lm.training_windows(texts)]
    assert got == [vocabulary.number[w].tolist() + [-1] * (lm.WINDOW + 2 - len(w)) for w in lm.cut_windows(rows, end)]


def test_a_task_that_learns_has_one_python_worker(spark, monkeypatch):
    """Two Python operators in one stage hold two workers for each core of an executor; a window takes two bytes for each number."""
    plans, tables = [], []
    frame = type(spark.range(0))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), collect(df))[1])
    monkeypatch.setattr(lm, "written", lambda df, *by, f=lm.written: (tables.append(f(df, *by)), tables[-1])[1])
    monkeypatch.setattr(lm, "discard", lambda *tables: None, raising=False)
    docs = spark.createDataFrame([(f"text {i} of many " * 20,) for i in range(50)], "text string")
    lm.train(docs, WORDS, some_vocabulary())
    assert len(plans) == lm.ROUNDS and {len(r["window"]) for r in tables[0].select("window").limit(3).toArrow().to_pylist()} == {2 * (lm.WINDOW + 2)}
    for plan in plans:
        operators = re.findall(r"(Exchange|FlatMapGroupsInArrow|MapInArrow)", plan)
        assert "MapInArrow" in operators
        assert not any(a.endswith("InArrow") and b.endswith("InArrow") for a, b in zip(operators, operators[1:], strict=False)), plan

import re
from collections import Counter

from dealloom.llm.host_rules import host_rates, host_verdicts, rule_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(lines)


TEXTS = [None, "", " \n\t ", "a b c a b c a", "x" * 9000, "äö ü\näö ü\n äö ü\n\n", "a#b $ <p> | & % *", "a\x0bb\x0cc\rd e\x1cf", "\n".join(["same line here"] * 40), " ".join(f"w{i}" for i in range(80)), "b b b b", "ok " * 70]


def test_counts_equal_a_plain_version(spark):
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, source string, n_words int")
    got = {r.row.doc_id: tuple(r[1:7]) for r in rule_counts(docs, ["doc_id", "n_words"]).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS * 2)}


def test_verdicts(spark):
    good, bad = " ".join(f"w{i}" for i in range(90)), "short"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(60)] + [(100 + i, bad, "awful") for i in range(60)] + [(199, good, "awful"), (200, good, None), (201, bad, None), (None, good, "fine"), (300, good, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.row.doc_id: r.kept for r in host_verdicts(docs, ["doc_id"]).collect()}
    assert kept == {i: t == good and s != "awful" for i, t, s in rows}
    rates = {r.host: r.rate for r in host_rates(rule_counts(docs, ["source"]), "source").collect()}
    assert 0.05 < rates["fine"] < 0.2 and rates["awful"] > 0.9 and rates["fine"] > 0.1 - 0.02 and rates["one"] > 0
    assert host_verdicts(docs.limit(0), ["doc_id"]).count() == 0


def test_shuffled_hosts_give_the_same(spark, monkeypatch):
    from dealloom.llm import host_rules

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {(r.row.doc_id, r.kept) for r in host_verdicts(docs, ["doc_id"]).collect()}
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", 0)
    assert one == {(r.row.doc_id, r.kept) for r in host_verdicts(docs, ["doc_id"]).collect()}


def test_words_that_a_weak_hash_confuses_do_not_repeat(spark):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"p q {a} z p q {b}", "s"), (2, f"p q {a} z p q {a}", "s")], "doc_id long, text string, source string")
    assert {r.row.doc_id: r.n_repeat_words for r in host_verdicts(docs, ["doc_id"]).collect()} == {1: 0, 2: 6}

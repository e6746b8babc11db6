import itertools
import re

import numpy as np
import pytest

from dealloom.llm import partenum
from dealloom.llm.jaccard_join import JaccardJoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, percent=90, width=3):
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {(i, len(s), find(i)) for i, s in sets.items()}


def family(seed, base, edits, n):
    rng = np.random.default_rng(seed)
    words = [f"w{rng.integers(9999)}" for _ in range(base)]
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.integers(0, edits + 1)):
            copy[rng.integers(base)] = f"x{rng.integers(9999)}"
        yield " ".join(copy)


def test_equals_brute_force(spark):
    texts = [None, "", " \t\n", "one", "One two", "one two", "ONE  two three", "äöü ÄÖÜ x y", "äöü ÄÖÜ x y"]
    for seed, (base, edits, n) in enumerate([(6, 1, 8), (12, 1, 20), (40, 3, 40), (150, 6, 60), (900, 25, 12)]):
        texts += family(seed, base, edits, n)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, sign string, n int")
    got = {tuple(r) for r in JaccardJoin(docs).components().collect()}
    assert got == brute(rows)


def test_links_between_classes(spark):
    rows = list(enumerate(family(7, 60, 4, 50)))
    sets = {i: shingle_set(t) for i, t in rows}
    names = {}
    for i, s in sets.items():
        names.setdefault(s, i)
    want = {(a, b) for (s, a), (t, b) in itertools.combinations(names.items(), 2) if 100 * len(s & t) >= 90 * len(s | t)}
    join = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in join.links().collect()} == want


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert JaccardJoin(spark.createDataFrame([], schema)).components().count() == 0
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "q r s t"), (2, "a b c d"), (9, "a b c d")]
    got = sorted(map(tuple, JaccardJoin(spark.createDataFrame(rows, schema)).components().collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 2), (5, 2, 2), (9, 2, 2), (2, 2, 2), (9, 2, 2)], key=str)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(5, 400))
        one = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        two = np.unique(np.concatenate([one[int(rng.integers(0, n // 8 + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, n // 10 + 1)), dtype=np.uint64)]))
        one = np.unique(one)
        same = len(np.intersect1d(one, two))
        if len(two) and 100 * same >= percent * (len(one) + len(two) - same) and set(one) != set(two):
            assert set(partenum.signatures(one, percent)) & set(partenum.signatures(two, percent))


def test_shuffled_ids_give_the_same(spark, monkeypatch):
    from dealloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)  # several blocks for each signature
    rows = list(enumerate(family(3, 60, 6, 60)))
    got = {tuple(r) for r in JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string")).components().collect()}
    assert got == brute(rows)


def test_texts_that_a_weak_hash_joins(spark):
    """No shingle is shared; the words differ, though polynomial hashes modulo a power of two take them for equal."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x y {a}"), (2, f"x y {b}"), (3, f"x y {a}")]
    assert {tuple(r) for r in JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string")).components().collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(600_000))
    rows = [(1, long), (2, long + " more"), (3, "short text here")]
    got = {tuple(r) for r in JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string")).components().collect()}
    assert got == {(1, 599_998, 1), (2, 599_999, 1), (3, 1, 3)}


def test_five_words_at_80_per_cent(spark):
    rows = list(enumerate([*family(5, 120, 9, 50), *family(6, 8, 2, 20)]))
    got = {tuple(r) for r in JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).components().collect()}
    assert got == brute(rows, 80, 5)


@pytest.mark.parametrize("percent", [80, 90])
def test_small_and_sparse_sets_share_a_signature(percent):
    """Few features leave many parts empty; every allowed number of differences is tried."""
    rng = np.random.default_rng(9)
    for n in [*range(1, 40), 60, 100]:
        for _ in range(60):
            base = rng.integers(0, 1 << 63, 3 * n + 4, dtype=np.uint64)
            one, two = base[:n], np.concatenate([base[int(rng.integers(0, max(1, n // 4))) : n], base[n : n + int(rng.integers(0, n // 4 + 1))]])
            one, two = np.unique(one), np.unique(two)
            same = len(np.intersect1d(one, two))
            if len(two) and 100 * same >= percent * (len(one) + len(two) - same) and set(one) != set(two):
                assert set(partenum.signatures(one, percent)) & set(partenum.signatures(two, percent)), (n, len(one), len(two), same)


def test_sets_without_common_features_share_few_signatures():
    rng = np.random.default_rng(10)
    signs = [partenum.signatures(np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64)), 80) for _ in range(300)]
    _, n = np.unique(np.concatenate([np.unique(s) for s in signs]), return_counts=True)
    assert (n * (n - 1) // 2).sum() < 0.02 * 300 * 299 / 2

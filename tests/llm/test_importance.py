import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from dealloom.llm import crc_spans, importance, queries
from dealloom.llm.importance import resampled

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, items, percent=5):
    s, t = Counter(), Counter()
    found = [(i, *buckets(x)) for i, x in docs]
    for _, _, f in found:
        s.update(f)
    for x in items:
        t.update(buckets(x)[1])
    a, b = s.total() + 10000, t.total() + 10000
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * a / ((s[k] + 1) * b)))
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(spark, docs, items, **other):
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, row int, weight int, rank int")
    out = resampled(d, spark.createDataFrame([(t,) for t in items], "text string"), ["row", "rank"], **other)
    return sorted([(r.row.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()], key=str)


DOCS = [(i, f"Alpha beta {i % 7} gamma, " * (i % 13) + "delta É é Straße 東京 " * (i % 5)) for i in range(200)]
DOCS += [(5, DOCS[5][1])] * 40 + [(None, "x y z " * 10), (300, None), (301, ""), (302, " .\x00;"), (303, "one"), (304, "ab" * 400 + " c " * 30), (305, "q" * 70_000), (306, " ".join(f"w{k % 5000}" for k in range(150_000)))]
ITEMS = ["gamma delta É", None, "", "alpha beta 3 gamma", "東京 delta " * 5]


@pytest.mark.parametrize("percent", [0, 5, 40, 100])
def test_against_brute_force(spark, percent):
    assert got(spark, DOCS, ITEMS, percent=percent) == brute(DOCS, ITEMS, percent)


def test_empty_tables_and_targets(spark):
    assert got(spark, [], ITEMS) == []
    assert got(spark, DOCS[:50], []) == brute(DOCS[:50], [])
    assert got(spark, [(1, None), (2, "")], [None]) == brute([(1, None), (2, "")], [])


def test_stretches_do_not_change_features(spark, monkeypatch):
    monkeypatch.setattr(importance, "STRETCH", 7)
    assert got(spark, DOCS[:60], ITEMS, percent=50) == brute(DOCS[:60], ITEMS, 50)


def test_crc_of_spans():
    rng = np.random.default_rng(0)
    sizes = np.concatenate([rng.integers(1, 30, 200), [1, 255, 256, 257, 511, 512, 513, 5000]])
    gaps = rng.integers(0, 3, len(sizes))
    start = np.cumsum(sizes + gaps) - sizes
    data = rng.integers(0, 256, start[-1] + sizes[-1], dtype=np.uint8)
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, sizes, strict=True)]
    assert crc_spans.crc32(data, start, start + sizes).tolist() == want
    assert crc_spans.crc32(data, start[:0], start[:0]).tolist() == []


def test_plan_has_no_window_over_all_documents(spark):
    plan = queries.queries()["op12_importance_resampling"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window [row_number" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for p in Path(f"/root/testdata/sf{sf}").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cursor = con.execute(queries.oracle_sql()["op12_importance_resampling"])
    out = queries.queries()["op12_importance_resampling"](spark, f"/root/testdata/sf{sf}")
    assert [c[0] for c in cursor.description] == out.columns
    assert sorted(cursor.fetchall(), key=str) == sorted((tuple(r) for r in out.collect()), key=str)

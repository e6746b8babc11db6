import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from dealloom.llm import queries
from dealloom.llm.hard_negatives import emitted, hard_negatives, packed_key, unpacked_key

SCHEMA = "vec_id long, embedding array<double>, label int, score string, anchor long, dim int"


def brute(rows):
    good = {(i, l, tuple(v)) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in good]
    out = []
    for i, label, v in whole:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in whole if len(w) == len(v)]
        for s, j, _ in sorted((s, j, m) for s, j, m in scored if m == label and j != i)[:5]:
            some = [(-t, k) for t, k, m in sorted(scored) if m != label and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(some[:5])]
    return sorted(out)


def got(spark, rows, **other):
    return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA), **other).collect())


def cloud(n, seed=1, size=8, labels=4):
    rng = np.random.default_rng(seed)
    return [(i, v, int(rng.integers(labels))) for i, v in enumerate((rng.normal(size=(n, size)) + 0.7).tolist())]


@pytest.mark.parametrize("other", [{}, {"rows_at_once": 40, "anchors_at_once": 2}])
def test_against_brute_force(spark, other):
    rows = cloud(700)
    want = brute(rows)
    assert got(spark, rows, **other) == want and len(want) > 50


def test_ties_copies_and_odd_rows(spark):
    rows = [(i, [1.0, 0.5, 0.25], i % 3) for i in range(230)]  # all scores tie
    rows += [(300, None, 1), (400, [], 1), (500, [1.0, None, 1.0], 1), (600, [1.0, float("nan"), 1.0], 1), (601, [1.0, float("inf"), 1.0], 1), (700, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(800, [1.0, 1.0], 1), (801, [1.0, 1.0], 1), (802, [0.9, 1.0], 2), (900, [0.0, 0.0, 0.0], 0), (1000, [-1.0, -1.0, -1.0], 0), (1100, [2.0], 5)]
    rows += [(100, [1.0, 0.5, 0.25], 1)] * 5 + [(200, [0.5, 0.5, 0.5], 1), (205, [0.5, 0.5, 0.5], 1)]
    want = brute(rows)
    assert got(spark, rows, rows_at_once=50) == want and any(r[0] == 800 for r in want)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    for scale in (2.0**14, 2.0**20, 2.0**22):
        rows = [(i, v, i % 2) for i, v in enumerate(((1 + rng.random((120, 4)) / 100) * scale).tolist())]
        assert got(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="beyond a long"):
        got(spark, [(i, [1e300], i % 2) for i in range(4)])


def test_empty_and_no_anchor(spark):
    assert got(spark, []) == [] and got(spark, cloud(90)[1:]) == [] and got(spark, [(0, [1.0], 1)]) == []


def test_keys_sort_as_the_order_and_windows_are_closed():
    keys = [(a, s, n, i) for a in (-5, 0, 7) for s in (9, 0, -9) for n in (False, True) for i in (-1, 0, 3)]
    packed = [packed_key(*k) for k in keys]
    assert sorted(packed) == packed and [unpacked_key(k) for k in packed] == keys
    rows = [(packed_key(1, 100, False, 8), 10), (packed_key(1, 100, True, 2), 10), (packed_key(1, 90, False, 9), 10), (packed_key(1, 80, True, 3), 10), (packed_key(1, 75, True, 4), 10), (packed_key(2, 99, True, 5), 20)]
    assert list(emitted(iter(rows), 5, 80)) == [(10, 8, 1, 2, 100, 100), (10, 8, 2, 3, 100, 80), (10, 9, 1, 3, 90, 80), (10, 9, 2, 4, 90, 75)]


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for p in Path(f"/root/testdata/sf{sf}").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cursor = con.execute(queries.oracle_sql()["op13_hard_negatives"])
    out = queries.queries()["op13_hard_negatives"](spark, f"/root/testdata/sf{sf}")
    rows = sorted(cursor.fetchall())
    assert [c[0] for c in cursor.description] == out.columns and sorted(tuple(r) for r in out.collect()) == rows and rows

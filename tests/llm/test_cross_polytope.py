import math

import numpy as np
import pytest

from dealloom.llm import cross_polytope, queries
from dealloom.llm.cross_polytope import hadamard, search, turned

SCHEMA = "vec_id long, embedding array<float>, bucket string"


def exact(rows, k=20):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, qv in good:
        if q % 20 == 0:
            scored = [(-(np.float32(v).astype(float) * np.float32(qv).astype(float)).sum(), i) for i, v in good if i != q and len(v) == len(qv)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_rotation_is_orthonormal():
    eye = np.eye(8)
    assert np.allclose(hadamard(eye) @ hadamard(eye).T, eye)
    assert np.allclose(turned(eye, 3) @ turned(eye, 3).T, eye)


@pytest.mark.parametrize("n", [500, 2000])
def test_recall_on_unit_vectors(spark, n):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    want = exact(rows)
    got = {}
    for r in search(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want]) / 20 >= 0.9
    for g in got.values():
        order = [g[r] for r in sorted(g)]
        assert order == sorted(order, key=lambda x: (-x[1], x[0]))


def test_copies_norms_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    hot, base = [1.0, 2.0, 0.5, -1.0], rng.normal(size=(15, 4)) * 3
    rows = [(i, hot) for i in range(0, 120)] + [(200 + i, v) for i, v in enumerate(base.astype(np.float32).tolist())]
    rows += [(300, None), (320, []), (340, [0.0] * 4), (360, [1.0, None, 1.0, 1.0]), (380, [1.0, float("nan"), 0.0, 0.0]), (381, [1.0, float("inf"), 0.0, 0.0]), (None, hot), (400, [1.0, 1.0]), (401, [2.0, 1.0]), (20, hot)]
    want = exact(rows)
    got = {}
    for r in search(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (0, 20, 40, 100):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    assert set(got) <= set(want) and got[400] == [(401, 3.0)]
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 40])
def test_tiny_tables_are_whole(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(n, 64)).astype(np.float32).tolist())]
    want = exact(rows)
    got = {}
    for r in search(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, best in want.items():
        assert len(got.get(q, [])) == len(best)
        if n <= 21:
            assert got.get(q, []) == [i for i, _ in best]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_the_registered_query(spark, monkeypatch, sf):
    """Through the tables and probes: the fit covers every vector length, and no query takes the way of short ones."""
    fits, fitted = [], cross_polytope.fitted
    monkeypatch.setattr(cross_polytope, "fitted", lambda *a: fits.append(fitted(*a)) or fits[-1])
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = exact(rows), {}
    for r in queries.queries()["op9_cross_polytope_neighbours"](spark, f"/root/testdata/sf{sf}").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(fits[0]) == {64} and 0 < fits[0][64][1] < 128
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want]) / 20 >= 0.9


@pytest.mark.parametrize("norms", ["one", "log-normal"])
def test_recall_where_norms_differ(spark, norms):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.exp(rng.normal(size=(len(x), 1)) / 2) if norms == "log-normal" else np.where(np.arange(len(x)) == 7, 5, 1)[:, None]
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    want, got = exact(rows), {}
    for r in search(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(got[q]) == 20 for q in want)
    assert np.mean([len({i for i, _ in want[q]} & got[q]) for q in want]) / 20 >= 0.9


def test_buckets_grow_with_the_rows_and_probes_are_fitted(spark, monkeypatch):
    assert [cross_polytope.axes_of_second_turn(n, 64) for n in (1, 500_000, 1_100_000, 5_000_000, 10**12)] == [0, 0, 2, 8, 128]
    monkeypatch.setattr(cross_polytope, "ROWS", 1)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(100, 32)), 40, axis=0) + rng.normal(size=(4000, 32)) / 3
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    fits, fitted = [], cross_polytope.fitted
    monkeypatch.setattr(cross_polytope, "fitted", lambda *a: fits.append(fitted(*a)) or fits[-1])
    want, got = exact(rows), {}
    for r in search(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len({i for i, _ in want[q]} & got.get(q, set())) for q in want]) / 20 >= 0.9
    fine, probes = fits[0][32]
    assert fine >= 2 and probes <= 64 * fine


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    rows = [(0, [1.0, 0.0]), *((i, [1.0, float(-i if i % 2 else i)]) for i in range(1, 40))]
    got = [(r.vec_id, r.score) for r in search(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).filter("query_id = 0").orderBy("rank").collect()]
    assert got == [(i, 1.0) for i in range(1, 21)]


def test_probes_needed_counts_the_buckets_up_to_a_row():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 16))
    points, query = cross_polytope.lifted(x, np.full(50, 3.0)), cross_polytope.lifted(x[:1], None)
    for fine in (0, 4):
        need = cross_polytope.probes_needed(query[0], points, fine)
        for n in (1, 5, 20):
            seen = {(t, b) for t in range(cross_polytope.TABLES) for b in cross_polytope.nearest_buckets(query, t, fine, n)[0]}
            held = [any((t, cross_polytope.bucket_of(points[i : i + 1], t, fine)[0]) in seen for t in range(cross_polytope.TABLES)) for i in range(50)]
            assert held == (need <= n).tolist()

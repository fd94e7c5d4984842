from __future__ import annotations

import numpy as np
import pytest

from tidepanel.llm import ann


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, queries, k):
    """The k nearest of all usable rows for each usable query, one list for each vector of its id."""
    rows = sorted({(i, tuple(map(float, v))) for i, v in rows if usable(v) and i is not None})
    width = max(len(v) for _, v in rows)
    unit = lambda v: (u := np.pad(np.array(v), (0, width - len(v))) / np.abs(v).max()) / np.linalg.norm(u)
    ids, matrix = np.array([i for i, _ in rows]), np.array([unit(v) for _, v in rows])
    out = {}
    for q, v in sorted({(i, tuple(map(float, v))) for i, v in queries if usable(v) and i is not None}):
        score = matrix @ unit(v)
        order = [j for j in np.lexsort((ids, -score.round(12))) if ids[j] != q][:k]
        out.setdefault(q, []).append([(int(ids[j]), score[j]) for j in order])
    return out


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def recall(found, want):
    got = lists(found)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w[0]}) / max(1, len(w[0])) for q, w in want.items()])


def test_recall_on_unstructured_and_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    n = 3000
    loose = rng.normal(size=(n, 32))
    tight = np.repeat(rng.normal(size=(40, 32)), n // 40, axis=0) + 0.3 * rng.normal(size=(n, 32))
    for vectors in (loose, tight):
        rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
        queries = [r for r in rows if r[0] % 50 == 0]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = ann.nearest_neighbours(df, df.where("vec_id % 50 = 0")).cache()
        want = brute(rows, queries, 5)
        assert recall(found, want) >= 0.9
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        for q, got in lists(found).items():
            assert len(got) == 5 and [s for _, s in got] == sorted((s for _, s in got), reverse=True)
            assert all(s == pytest.approx(unit[q] @ unit[i], abs=1e-12) for i, s in got)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]
    rows += [(10 + i, [1.0, 0.0, 0.0]) for i in range(20)] + [(60, [2.0, 0.0]), (60, [2.0, 0.0]), (61, [1e300, 1e300]), (62, [1e-300, 0.0]), (None, [1.0, 0.0]), (50, [0.0, 3.0]), (50, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, vector string, rank int")
    queries = df.where("vec_id in (0, 1, 50, 60, 62)")
    got = lists(ann.nearest_neighbours(df, queries))
    want = brute(rows, [r for r in rows if r[0] in (0, 1, 50, 60, 62)], 5)
    assert set(got) == set(want) == {0, 50, 60, 62}
    for q in (0, 60, 62):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q][0]]
    assert np.allclose(sorted(s for _, s in got[50]), sorted(s for part in want[50] for _, s in part)) and len(got[50]) == 10


def test_few_rows_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 2.0]), (7, [2.0, 1.0]), (9, [-1.0, 0.0])], schema)
    assert [i for i, _ in lists(ann.nearest_neighbours(df, df.where("vec_id = 0")))[0]] == [7, 9]
    none = spark.createDataFrame([], schema)
    assert ann.nearest_neighbours(none, none).collect() == [] and ann.nearest_neighbours(df, none).collect() == [] and ann.nearest_neighbours(none, df).collect() == []


def test_full_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(i, (np.array([5.0, 0, 0, 0]) + 1e-3 * rng.normal(size=4)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, [r for r in rows if r[0] % 10 == 0], 5)
    assert recall(ann.nearest_neighbours(df, df.where("vec_id % 10 = 0")), want) == 1.0


def test_hashes():
    rng = np.random.default_rng(3)
    h = ann.hashing_for(100_000, 48)
    assert h.width == 64 and h.axes == (64, 4) and h.buckets == 1024
    x = rng.normal(size=(50, 64))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = h.probe(x, 2)
    assert (codes[:, 0] == h.bucket(x, 2)).all() and codes.shape == (50, h.probes) and all(len(set(c)) == h.probes for c in codes)
    total = [sum(p) for p in zip(*([loss[0][c] for c in ((codes[0] // 8) if k == 0 else (codes[0] % 8))] for k, loss in enumerate(h.losses(x[:1], 2))), strict=True)]
    every = np.sort((list(h.losses(x[:1], 2))[0][0][:, None] + list(h.losses(x[:1], 2))[1][0]).ravel())
    assert np.allclose(total, every[: h.probes])

from __future__ import annotations

import random

import numpy as np
import pytest

from tidepanel.llm import minhash_dedup as mh
from tidepanel.llm.components import connected_components


def brute(rows, num, den):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5)])
def test_groups_equal_brute_force(spark, monkeypatch, num, den):
    rng = random.Random(num)
    words = [f"W{i}" for i in range(3000)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE  two"), (1005, "two one")]
    for group in range(8):
        base = rng.choices(words, k=rng.choice([6, 30, 120, 900]))
        for copy in range(rng.choice([2, 5, 25])):
            text = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append((group * 100 + copy, " ".join(text)))
    rng.shuffle(rows)
    monkeypatch.setattr(mh, "BLOCK_DOCS", 4)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in mh.near_duplicate_groups(docs, num=num, den=den).collect())
    assert got == brute(rows, num, den)


def test_repeated_rows_and_empty_table(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(3, text), (3, text), (3, "other words stand here now"), (9, text)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in mh.near_duplicate_groups(docs).collect())
    assert got == [(3, 3, True)] * 3 + [(9, 3, False)]
    assert mh.near_duplicate_groups(docs.limit(0)).collect() == []


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 3, 100, 5000):
        values = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        sketch = mh.fast_similarity_sketch(values, 240)
        assert sketch.max() < np.iinfo(np.uint64).max
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = a.copy()
    b[:100] = rng.integers(0, 2**63, 100, dtype=np.uint64)
    same = (mh.fast_similarity_sketch(np.sort(a), 960) == mh.fast_similarity_sketch(np.sort(b), 960)).mean()
    assert abs(same - 900 / 1100) < 0.06


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(500, 499), (499, 500), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[500] == got[499] == 499

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tidepanel.llm import vector_codes as vc


def plain_lloyd(rows, parts=16, entries=64, rounds=2):
    """The contract by loops over Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, codes, strict=True) if k[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)]
    labels = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e in k), err, labels[label], sha) for (i, _, label), k, err in zip(kept, codes, errors, strict=True)]


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def run(spark, rows):
    got = vc.coded_vectors(spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(3)).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("coarse", [False, True])
def test_equals_plain_lloyd(spark, coarse):
    rng = np.random.default_rng(4)
    values = rng.integers(-2, 3, (300, 32)) / 256.0 if coarse else rng.normal(size=(300, 32)) / 5  # coarse: ties everywhere
    rows = [(int(i), v.astype(np.float32).tolist(), [None, 1, 2][k % 3]) for k, (i, v) in enumerate(zip(rng.permutation(300), values, strict=True))]
    assert run(spark, rows) == sorted(plain_lloyd(rows))


def test_odd_rows_few_rows_and_none(spark):
    rows = [(5, [0.25] * 16, 1), (5, [0.25] * 16, 1), (2, [-0.001] * 16, None), (9, [0.5] * 16, None), (1, None, 1), (3, [float("nan")] * 16, 1), (4, [None] + [1.0] * 15, 1), (6, [float("inf")] * 16, 2)]
    assert run(spark, rows) == sorted(plain_lloyd(rows))
    assert run(spark, []) == [] and run(spark, [(1, None, 3)]) == []
    huge = run(spark, [(1, [1e38] * 16, 0), (2, [-1e38] * 16, 0)])
    assert [r[2] for r in huge] == [0, 0]
    uneven = run(spark, [(1, [1.0] * 20, 0), (2, [1.0] * 3, 0)])
    assert [r[1] for r in uneven] == ["00" * 16, "00" + "01" * 9 + "00" * 6]


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(6)
    centres = rng.integers(-200, 200, (30, 16, 4))
    x = centres[rng.integers(0, 30, 400)] + rng.integers(-3, 4, (400, 16, 4))
    books = vc.Codebooks(x[:64].swapaxes(0, 1).copy(), np.zeros((16, 64), np.float32))
    code, upper, lower = vc.first_state(x, books)
    for shift in (2, 1, 0):
        new = books.entries + rng.integers(-shift, shift + 1, books.entries.shape)
        books = vc.Codebooks(new, vc._above(np.sqrt(((new - books.entries) ** 2).sum(-1))))
        code, upper, lower, measured = vc.next_state(x, code, upper, lower, books)
        squared = ((x[:, :, None] - books.entries[None]) ** 2).sum(-1)
        assert (code == squared.argmin(-1)).all()
        assert (lower <= np.sqrt(squared)).all() and (upper >= np.sqrt(np.take_along_axis(squared, code[..., None], -1)[..., 0])).all()
        assert measured < 0.6 * squared.size

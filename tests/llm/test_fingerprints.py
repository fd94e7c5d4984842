from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tidepanel.llm import fingerprints as fp
from tidepanel.llm.texthash import shingle_sets


def jaccard(a, b):
    a, b = (set(x.lower().split()) and {tuple(x.lower().split()[i : i + 5]) for i in range(max(1, len(x.split()) - 4))} for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_neighbours(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[(i * 7) % 300 : (i * 7) % 300 + 3 + (i * 13) % 90]) for i in range(60)}
    texts |= {60: None, 61: "", 62: "é à", 63: "x"}
    rows = [(i * 3, texts[i], "clash") for i in texts]
    got = {r["doc_id"]: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)).collect()}
    assert len(got) == len(rows)
    ids = sorted(got)
    plain = {i * 3: t or "" for i, t in texts.items()}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        n = len(plain[i])
        edited = plain[i][: n - n // 4] + plain[j][: n // 4]
        assert got[i]["n_chars"] == n
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(jaccard(plain[i], edited))
        assert got[i]["near_next"] == pytest.approx(jaccard(plain[i], plain[j]))
        assert got[i]["edited_fingerprint"] == got[j]["fingerprint"] or edited != plain[j]


def test_one_row_empty_table_null_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    one = fp.edited_fingerprints(spark.createDataFrame([(5, "abcd")], schema)).first()
    assert (one["edited_sha256"], one["near_next"]) == (hashlib.sha256(b"abca").hexdigest(), 1.0)
    assert fp.edited_fingerprints(spark.createDataFrame([], schema)).collect() == []
    rows = fp.edited_fingerprints(spark.createDataFrame([(None, "aaaa"), (1, "bbbb"), (1, "bbbb"), (1, "cccc")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["edited_sha256"]) for r in rows) == sorted((i, hashlib.sha256(t).hexdigest()) for i, t in [(0, b"aaab"), (1, b"bbbb"), (1, b"bbbc"), (1, b"ccca")])


def test_estimates_of_large_sets():
    rng = np.random.default_rng(3)
    whole = np.unique(rng.integers(0, 2**63, 30000, dtype=np.uint64) * np.uint64(2))
    a, b = whole[: 20000], whole[10000:]
    a, b = np.sort(rng.permutation(whole)[:20000]), whole
    true = len(np.intersect1d(a, b)) / len(whole)
    assert abs(fp.resemblance(fp.sketch(a), fp.sketch(b)) - true) < 0.15
    assert abs(fp.containment(fp.sketch(a), fp.sketch(b)) - 1) < 0.2
    assert abs(fp.distinct_count(fp.sketch(whole)) / len(whole) - 1) < 0.3
    halves = fp.merge(fp.sketch(whole[:15000]), fp.sketch(whole[15000:]))
    assert (halves == fp.sketch(whole)).all() and (fp.decode(fp.encode(halves)) == halves).all()


def test_plain_fingerprints(spark):
    text = " ".join(f"w{i}" for i in range(500))
    rows = fp.fingerprints(spark.createDataFrame([(1, text), (2, text.upper()), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and rows[2]["fingerprint"] == "" and rows[2]["n_shingles"] == 0
    assert (fp.decode(rows[0]["fingerprint"]) == next(shingle_sets(pa.array([text])))[: fp.K]).all()

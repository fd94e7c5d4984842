from __future__ import annotations

import json
import random

import pytest

from tidepanel.llm import mixing


def corpus():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = " ".join(rng.choices([f"word{k}" for k in range(300)], k=50)) if good else " ".join(["AB|"] * rng.randrange(30, 60))
        rows.append((i, text, "src", "en", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    return rows, labels


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def test_expected_totals_meet_targets(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(900, None, "s", "en", 0), (901, "", "s", "en", 0), (901, "", "s", "en", 0)], SCHEMA)
    table = spark.createDataFrame(labels + [(3000, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mixture_rates(docs, table, {"1": 0.9, "0": 0.1}).collect()
    assert len(got) == 403 and all(0 <= r["rate"] <= 2 and r["residual"] < 1e-5 for r in got)
    total = sum(r["n_tokens"] for r in got)
    for domain, share in (("1", 0.9), ("0", 0.1)):
        assert sum(r["rate"] * r["n_tokens"] * json.loads(r["posteriors"])[domain] for r in got) / total == pytest.approx(share, abs=1e-4)


def test_brute_force_descent(spark):
    """The solver's totals are those of a plain projected gradient in numbers."""
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = mixing.mixture_rates(docs, table, {"1": 0.6, "0": 0.4}, most=1.5).collect()
    p = [[json.loads(r["posteriors"])[d] for d in ("0", "1")] for r in got]
    t = [r["n_tokens"] for r in got]
    total = sum(t)
    share = [sum(a * b[k] for a, b in zip(t, p)) / total for k in (0, 1)]
    rate = [1.0] * len(t)
    for _ in range(400):
        off = [sum(r * a * b[k] for r, a, b in zip(rate, t, p)) / total - g for k, g in ((0, 0.4), (1, 0.6))]
        rate = [min(1.5, max(0.0, r - 0.9 * sum(o * x / s for o, x, s in zip(off, b, share)))) for r, b in zip(rate, p)]
    for k in (0, 1):
        mine = sum(r["rate"] * a * b[k] for r, a, b in zip(got, t, p)) / total
        assert mine == pytest.approx(sum(r * a * b[k] for r, a, b in zip(rate, t, p)) / total, abs=2e-3)


def test_rows_follow_rates(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = mixing.mixed(docs, table, {"1": 0.95, "0": 0.05})
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    good = [i for i, text, *_ in rows if "word" in text]
    assert set(good) <= set(ids) and len(ids) == len(set(ids)) < len(rows)
    twice = mixing.mixed(docs, table, {"1": 1.0}, most=2.0, budget=1.4)
    assert len(twice.collect()) > len(good)
    assert mixing.mixed(docs.limit(0), table, {"1": 1.0}).collect() == []
    assert mixing.mixture_rates(docs, table.limit(0), {"all": 1.0}).count() == len(rows)


def test_posteriors_of_held_out_labels(spark):
    """Domains that differ by their words alone; the labels of a third of the documents are kept back."""
    rng = random.Random(12)
    rows, labels, held = [], [], {}
    for i in range(600):
        domain = rng.choice(["news", "code", "talk"])
        own = {"news": range(0, 120), "code": range(80, 200), "talk": range(160, 280)}[domain]
        rows.append((i, " ".join(f"t{k}" for k in rng.choices(own, k=40))))
        if i % 3:
            labels.append((i, domain))
        else:
            held[i] = domain
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([*labels, (1, "news"), (1, "talk"), (None, "code")], "doc_id long, quality string")
    got = {r["doc_id"]: json.loads(r["posteriors"]) for r in mixing.mixture_rates(docs, table, {"news": 1, "code": 1, "talk": 2}).collect()}
    right = sum(max(got[i], key=got[i].get) == d for i, d in held.items())
    assert right > 0.97 * len(held)


def test_clashing_names_long_texts_and_targets_out_of_reach(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t, *_ in rows] + [(None, "word1 " * 200_000, 1, 2, 3)], "doc_id long, text string, row int, tokens int, p0 int")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert mixing.mixed(docs, table, {"1": 0.9, "0": 0.1}).schema == docs.schema
    out = mixing.mixture_rates(docs, table, {"1": 1.0}, most=1.0, budget=1.0).first()
    assert out["residual"] > 0.01
    with pytest.warns(UserWarning, match="off its targets"):
        mixing.mixed(docs, table, {"1": 1.0}, budget=1.0)

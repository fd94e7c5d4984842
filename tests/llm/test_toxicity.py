from __future__ import annotations

import random
import zlib

from tidepanel.llm import toxicity


def corpus(n):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(5, 60))
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["moron", "scum", "idiot"]))
        rows.append((i, " ".join(text), f"s{i % 3}"))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_folds(spark):
    rows, labels = corpus(1200)
    docs = spark.createDataFrame(rows + [(5000, None, "s"), (5001, "", "s"), (5001, "", "s")], "doc_id long, text string, score string")
    table = spark.createDataFrame(labels + [(7, None), (99999, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, table)).collect()
    assert len(got) == 1203
    truth = dict(labels)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    test = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in test) > 0.95 * len(test)
    assert len({r["score"] for r in got if r["doc_id"] >= 5000}) == 1


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    models = [toxicity.train(docs, spark.createDataFrame(t, "doc_id long, toxic int")) for t in (labels, flipped)]
    assert (models[0].buckets == models[1].buckets).all() and models[0].bias == models[1].bias


def test_empty_tables_and_filter(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 1e-9 and not r["predicted"] for r in toxicity.score(docs.limit(3), none).collect())
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, p in scores.items() if not p)
    assert toxicity.score(docs.limit(0), model).collect() == [] and toxicity.without_toxic(docs.limit(0), model).collect() == []

from __future__ import annotations

import random

import numpy as np

from tidepanel.llm import decontaminate as dc


def plain_score(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_equals_the_plain_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 16))] for _ in range(2))
        score, first, end = dc.smith_waterman(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == plain_score(a, b)
        assert score == plain_score(a, b[first:end])


def test_exact_and_edited_passages(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(2000)]
    items = {i: rng.choices(words, k=30) for i in range(6)}
    items[6] = ["the", "of"]
    rows, leaks = [], set()
    for d in range(120):
        text = rng.choices(words, k=rng.randrange(20, 200))
        if d % 4 == 0:
            k = d // 4 % 6
            part = [rng.choice(words) if d % 8 and rng.random() < 0.15 else w for w in items[k]]
            at = rng.randrange(len(text))
            text[at:at] = part
            leaks.add((d, k))
        rows.append((d, " ".join(text).upper() if d % 3 else " ".join(text), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (502, " ".join(items[0]), "x"), (502, " ".join(items[0]), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(90, None), (91, ""), (0, " ".join(items[0]))], "item_id long, text string")
    for bits in (25, 8):  # a sieve that lets most grams pass changes nothing
        monkeypatch.setattr(dc, "SIEVE_BITS", bits)
        got = dc.benchmark_leaks(docs, bench).collect()
        pairs = [(r["doc_id"], r["item_id"]) for r in got]
        assert set(pairs) == leaks | {(502, 0)} and pairs.count((502, 0)) == 2
        for r in got:
            if r["doc_id"] % 8 == 0 and r["doc_id"] < 500:
                assert r["score"] == 1.0 and r["end_word"] - r["first_word"] == 30
    kept = dc.decontaminated(docs, bench)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([d for d in range(120) if d % 4] + [500, 501])
    assert dc.benchmark_leaks(docs.limit(0), bench).collect() == [] and dc.benchmark_leaks(docs, bench.limit(0)).collect() == []


def test_every_text_of_an_id_is_searched(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"v{rng.randrange(5000)}" for _ in range(20)) for _ in range(12)]
    #: ids that restart, and none at all; the first text is there twice, and once with its last words changed
    near = texts[0].rsplit(" ", 4)[0] + " other words stand here"
    bench = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts[:8])] + [(None, t) for t in texts[8:]] + [(0, texts[0]), (0, near)], "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (50, "nothing of it")], "doc_id long, text string").repartition(2)
    want = sorted([(i, i % 4 if i < 8 else -1, 1.0) for i in range(12)] + [(0, 0, 1.0)])
    for bits in (25, 8):
        monkeypatch.setattr(dc, "SIEVE_BITS", bits)
        got = dc.benchmark_leaks(docs, bench).collect()
        assert sorted((r["doc_id"], -1 if r["item_id"] is None else r["item_id"], r["score"]) for r in got) == want
    assert [r["doc_id"] for r in dc.decontaminated(docs, bench).collect()] == [50]


def test_seeds_lose_no_edited_copy_against_all_pairs(spark):
    rng = random.Random(4)
    words = [f"u{i}" for i in range(400)]
    items = {i: rng.choices(words, k=rng.randrange(12, 40)) for i in range(8)}
    rows = []
    for d in range(160):
        text = rng.choices(words, k=rng.randrange(5, 90))
        if d % 2:
            part = [rng.choice(words) if rng.random() < 0.2 else w for w in items[d % 8] if rng.random() > 0.08]
            at = rng.randrange(len(text))
            text[at:at] = part
        rows.append((f"d{d}", " ".join(text)))
    #: ties: the passage twice, and a text of over a megabyte
    rows.append(("twice", " ".join([*items[1], "between", *items[1]])))
    rows.append(("long", " ".join(rng.choices(words, k=260_000) + items[2])))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id string, text string, key int").repartition(3)
    bench = spark.createDataFrame([(str(k), " ".join(v)) for k, v in items.items()], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in dc.benchmark_leaks(docs, bench).collect()}
    want = {}
    for doc, text in rows[:-1]:
        for k, item in items.items():
            score = plain_score(item, text.split()) / (2 * len(item))
            if score >= 0.5:
                want[doc, str(k)] = score
    assert len(want) > 60
    assert {p: r["score"] for p, r in got.items() if p[0] != "long"} == want
    assert (got["twice", "1"]["first_word"], got["twice", "1"]["end_word"]) == (0, len(items[1]))
    assert got["long", "2"]["score"] == 1.0


def test_phrases_of_many_items_align_no_pairs(spark):
    rng = random.Random(5)
    phrase = "which of the following is true".split()
    items = {i: [f"q{rng.randrange(3000)}" for _ in range(15)] + phrase + [f"q{rng.randrange(3000)}" for _ in range(9)] for i in range(100)}
    rows = [[f"d{rng.randrange(3000)}" for _ in range(20)] + phrase + [f"d{rng.randrange(3000)}" for _ in range(20)] for _ in range(400)]
    for d in range(0, 400, 20):  # copies, whole and with every eighth word replaced
        rows[d] += [w if d % 40 or i % 8 != 3 else "other" for i, w in enumerate(items[d // 20])]
    docs = spark.createDataFrame([(d, " ".join(r)) for d, r in enumerate(rows)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    texts = dc.materialize(bench.select(dc.F.col("item_id").alias("key"), "text"), "texts")
    numbered = docs.select(dc.F.col("doc_id").alias("doc"), "text", dc.F.xxhash64("text").alias("text_hash"))
    assert dc._candidates(numbered, texts, 3, 2)[1].count() < 1000
    assert {(r["doc_id"], r["item_id"]) for r in dc.benchmark_leaks(docs, bench).collect()} == {(d, d // 20) for d in range(0, 400, 20)}


def test_items_of_one_body_and_ids_of_one_text(spark):
    rng = random.Random(6)
    body = [f"b{i}" for i in range(30)]
    items = [(i, " ".join([*body, f"last{i}"])) for i in range(20)] + [(100 + i, "short item of six words here") for i in range(12)]
    rows = [(1, " ".join([f"d{rng.randrange(99)}" for _ in range(30)] + body)), (1, "clean text"), (None, "so: short item of six words here"), (None, None), (2, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.benchmark_leaks(docs, bench).collect()}
    assert got == {(1, i) for i in range(20)} | {(None, 100 + i) for i in range(12)}
    assert {(r["doc_id"], r["text"]) for r in dc.decontaminated(docs, bench).collect()} == {(1, "clean text"), (None, None), (2, "another text")}


def test_recall_with_a_third_of_the_words_replaced(spark):
    """Against all pairs with 25 to 35 % of the words replaced at random, 0.9 of the alignments of 0.5 or more are found."""
    rng = random.Random(7)
    items = {i: [f"u{rng.randrange(900)}" for _ in range(30)] for i in range(10)}
    rows = []
    for d in range(300):
        share = rng.uniform(0.25, 0.35)
        rows.append((d, " ".join([f"u{rng.randrange(900)}" for _ in range(20)] + [f"u{rng.randrange(900)}" if rng.random() < share else w for w in items[d % 10]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    want = {(d, d % 10) for d, text in rows if plain_score(items[d % 10], text.split()) >= 30}
    got = {(r["doc_id"], r["item_id"]) for r in dc.benchmark_leaks(docs, bench).collect()}
    assert len(want) > 150 and len(want & got) >= 0.9 * len(want)

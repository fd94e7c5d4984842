from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from tidepanel.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes, kept = docs.columns, [docs.count()], {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{corpus_pipeline.shared_path(spark, 'test-stage')}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= kept, name
        kept = now
        sizes.append(docs.count())
    assert sizes[-1] > 0.5 * sizes[0] and sizes == sorted(sizes, reverse=True)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == kept
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_toxic_stage_is_the_operator(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.score(docs, toxicity.train(docs, labels))
    want = sorted(r["doc_id"] for r in scores.where("predicted = 0").collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()) == want


def test_near_copies_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " more", " ".join(f"x{i}" for i in range(60))
    rows = [(1, text, "a"), (1, text, "a"), (1, near, "b"), (None, text, "c"), (None, other, "d"), (None, other + " more", "e"), (2, "alone in this table it stands", "f"), (2, "a text of its own again", "g"), (3, None, "h"), (None, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    kept = [r["source"] for r in got.collect()]
    assert len(kept) == len(set(kept)) == 6 and {"f", "g", "h", "i"} <= set(kept)
    assert len({"a", "b"} & set(kept)) == 1 and len({"d", "e"} & set(kept)) == 1 and "c" not in kept


def _tables(spark, folder, labels, items):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties and columns that the stages might use themselves."""
    rng = random.Random(31)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = say(30)
    rows = [(i, say(40), None if i % 5 == 0 else "en", None if i % 7 == 0 else "web", 7) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "web", 0), (101, "", "en", "web", 0), (None, None, None, None, None), (None, say(25), "en", "web", 1)]
    rows += [(200, rows[3][1], "en", "web", 7), (200, rows[3][1], "en", "web", 7), (201, f"{say(15)} {item} {say(15)}", "en", "web", 7), (202, " ".join(f"z{rng.randrange(90_000)}" for _ in range(250_000)), "en", "web", 7)]
    names = "doc_id long, text string, lang string, source string, n_chars long, row long, key long, node long, tokens long, words string, shard int, size int"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, "x", 5, 6) for r in rows], names).repartition(4)
    labels = [(i, int(i % 10 != 0), 0) for i in range(0, 60, 2)] + [(1, None, None), (None, 1, 0), (2, 0, 0), (999, 1, 1)]
    place = _tables(spark, corpus_pipeline.shared_path(spark, "odd"), labels, [(1, item), (None, None), (2, "")])
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.shared_path(spark, "odd-stage")
        stage(spark, left, place).write.parquet(path)
        before, left = left, spark.read.parquet(path)
        assert left.columns == docs.columns and left.count() <= before.count(), name
        ids = [r["doc_id"] for r in left.select("doc_id").collect()]
        if name == "near-duplicates":
            assert ids.count(200) == 0 and ids.count(3) == 1 and ids.count(101) == 2 and ids.count(None) == 2 and 202 in ids
        if name == "decontamination":
            assert 201 not in ids and len(ids) == len(rows) - 3
    out = corpus_pipeline.shard(spark, left, place)
    assert out.count() == left.count()


def test_sharding_has_links_when_no_copies_are_left(spark):
    """The stages before leave no equal texts; the last one keeps documents together that share a line."""
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    families = [say(12) for _ in range(32)]
    docs = spark.createDataFrame([(i, f"{say(30)}\n{families[i % 32]}\n{say(30)}", "en", "web", 0) for i in range(320)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_near_copies(spark, docs, SF).count() == 320
    place = {r["doc_id"]: r["shard"] for r in corpus_pipeline.shard(spark, docs, SF).collect()}
    assert set(Counter(place.values()).values()) == {40}
    assert sum(place[i] == place[i % 32] for i in range(32, 320)) > 0.6 * 288


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    place = _tables(spark, corpus_pipeline.shared_path(spark, "empty"), [], [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.shard(spark, docs, place).count() == 0
    some = spark.createDataFrame([(1, "a few words of a text", "en", "web", 21)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, some, place).count() == 1, name

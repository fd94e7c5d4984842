"""Texts of over a megabyte, and columns that are named like the operators' own."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidepanel.llm import fingerprints, minhash_dedup, secrets, sharding, tokenbin, toxicity

NAMES = ["doc", "node", "path", "blob", "version", "spans", "size", "text_crc32", "shard", "range", "keys", "component", "n_shingles", "label", "features", "score", "at", "row", "fingerprint", "start"]
RNG = random.Random(11)
WORDS = [f"w{RNG.randrange(40_000)}" for _ in range(220_000)]
LONG = " ".join(WORDS)
CHANGED = " ".join([*WORDS[:100_000], "another", *WORDS[100_001:]])
TEXTS = {1: LONG, 2: CHANGED, 3: "short é text of six words", 4: None, 5: f"{LONG} token=abcdefghijklmnop"}


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 1 << 20
    rows = [(i, t, *["clash"] * len(NAMES)) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)).repartition(2)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_secrets(docs):
    got = by_id(secrets.document_secrets(docs))
    begin = len(LONG) + 1
    assert {i: r["n_assign"] + r["n_access"] + r["n_hex"] for i, r in got.items()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    assert got[5]["spans"] == f"assign:{begin}:{begin + 22}"


def test_shards(docs):
    got = by_id(sharding.shard_documents(docs, 2))
    for i, text in TEXTS.items():
        raw = (text or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert sorted(sum(r["shard"] == s for r in got.values()) for s in (0, 1)) == [2, 3]


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    got = by_id(toxicity.score(docs, toxicity.train(docs, labels)))
    assert set(got) == set(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    kept = toxicity.without_toxic(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and set(by_id(kept)) == {i for i, r in got.items() if not r["predicted"]}


def test_token_files(docs):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    whole, at = tokenizers.Tokenizer.from_file(path), 0
    got = by_id(tokenbin.tokenize_to_files(docs, path, 2, 49408))
    for i, text in TEXTS.items():
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_fingerprints(docs):
    got = by_id(fingerprints.edited_fingerprints(docs))
    for i, text in TEXTS.items():
        text, following = text or "", TEXTS[i % 5 + 1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    assert got[1]["near_next"] > 0.9


def test_near_duplicates(docs):
    got = by_id(minhash_dedup.near_duplicate_groups(docs))
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    assert got[1]["n_shingles"] == len({tuple(WORDS[i : i + 5]) for i in range(len(WORDS) - 4)})

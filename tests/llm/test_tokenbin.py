from __future__ import annotations

import zlib

import numpy as np
import pytest

from tidepanel.llm import tokenbin
from tidepanel.session import shared_path

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
TEXTS = ["Hello, World's 123 words", None, "", "  \n", "naïve café Ünïcode don't", "<|endoftext|> mid<|startoftext|>dle <| x", "long " * 3000, "a b c\x1cd", "é ́x"]


@pytest.mark.parametrize("vocabulary", [49408, 1 << 20])
def test_files_equal_the_library(spark, vocabulary):
    path = public.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    rows = [(i * 5 - 7, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, "null id"), (3, "b"), (3, "a")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start long").repartition(4)
    folder = shared_path(spark, "tokens")
    got = tokenbin.tokenize_to_files(docs, path, 2, vocabulary, folder).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    at = 0
    for r, (doc, text) in zip(got, want, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    import os

    local = folder.removeprefix("file://")
    flat = sorted(f for f in os.listdir(local) if f.endswith(".bin"))
    width = 2 if vocabulary <= 1 << 16 else 4
    assert sum(os.path.getsize(f"{local}/{f}") for f in flat) == at * width
    assert tokenbin.tokenize_to_files(docs.limit(0), path, 2, vocabulary).collect() == []


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenbin, "WORDS_KEPT", 3)
    path = public.path("word_bpe_49k.json")
    encoder = tokenbin.WordEncoder(path, "<u2")
    whole = tokenizers.Tokenizer.from_file(path)
    for text in ("one two three four five", "six one seven two", "eight one five"):
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_gives_the_librarys_ids(name):
    path = public.path(name)
    whole, encoder = tokenizers.Tokenizer.from_file(path), tokenbin.WordEncoder(path, "<u4")
    texts = ["two words  here", "", " a\tb\n\nc ", "l'été  中文", "very long text, " * 70_000]
    assert encoder.splits == name.startswith("word")
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids

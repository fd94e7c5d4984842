from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidepanel.llm import suffix_dedup, suffixsort


def brute(rows, window):
    count = Counter(t[i : i + window] for _, t in rows for i in range(len(t) - window + 1))
    out = []
    for doc, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "gram"), [(200, 40), (30, 12)])
def test_removed_bytes_equal_brute_force(spark, window, gram):
    rng = random.Random(window)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randrange(1, 9)))
    passage = [" ".join(word() for _ in range(80)) for _ in range(3)]
    texts = [None, "", "short", "x" * 500, "ab" * 300]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 60)))]
        if rng.random() < 0.6:
            p = rng.choice(passage)
            parts.append(p[rng.randrange(100) : len(p) - rng.randrange(100)])
        parts.append(" ".join(word() for _ in range(rng.randrange(1, 60))))
        texts.append(" ".join(parts))
    texts += [texts[10], texts[10], texts[11] + "!", passage[0] + passage[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[8])]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs, window=window, gram=gram).collect())
    assert got == brute([(i, (t or "").encode()) for i, t in rows], window)
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize(("memory", "flat", "chunk"), [(200, 1024, 1 << 15), (1 << 24, 1024, 1 << 15), (200, 2, 5)])
def test_suffixes_and_common_prefixes(memory, flat, chunk, monkeypatch):
    monkeypatch.setattr(suffixsort, "FLAT", flat)
    monkeypatch.setattr(suffixsort, "CHUNK", chunk)
    rng = np.random.default_rng(memory)
    for turn in range(120):
        symbols = int(rng.integers(2, 6 if turn % 2 else 40))
        text = rng.integers(1, symbols, rng.integers(1, 90))
        if turn % 3 == 0:
            text = np.r_[np.tile(text[:7], 12), text]
        if turn % 7 == 0:
            text = np.r_[text, text]
        text = np.r_[text, 0].astype(np.uint32)
        for depth in (5, 200):
            order, common = suffixsort.suffix_order(text, symbols, depth, memory)
            assert sorted(order) == list(range(len(text)))
            plain = text.tolist()
            for a, b, n in zip(order[:-1], order[1:], common[1:]):
                x, y = plain[a : a + depth], plain[b : b + depth]
                assert x <= y
                assert n == next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))


def test_a_shard_beyond_memory_spills_and_recurses(monkeypatch):
    spilled, strings = [], []
    spill, begin = suffixsort.BucketQueue._spill, suffixsort.Text.__init__
    monkeypatch.setattr(suffixsort.BucketQueue, "_spill", lambda self: (spill(self), spilled.append(self.spilled)))
    monkeypatch.setattr(suffixsort.Text, "__init__", lambda self, values, *rest: strings.append(len(values)) or begin(self, values, *rest))
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(300)]
    spans = [" ".join(rng.choices(words, k=60)).encode() for _ in range(600)]
    for k in range(0, 600, 5):
        at = rng.randrange(20, 60)
        spans[k] = spans[k][:at] + spans[k + 1][40:130] + spans[k][at:]
    memory = 1 << 14
    shard = suffix_dedup.Shard(50, memory)
    for k, span in enumerate(spans):
        shard.add(str(k).encode(), 1, span)
    assert shard.size > 8 * memory
    starts, marked = shard.marked()
    assert spilled and len(strings) >= 3  # the names recursed on their own, with queues on disk
    count = Counter(s[i : i + 50] for s in spans for i in range(len(s) - 49))
    for start, span in zip(starts.tolist(), spans):
        assert [count[span[i : i + 50]] > 1 for i in range(len(span) - 49)] == marked[start : start + len(span) - 49].tolist()
    found = {r["digest"]: r["runs"] for r in shard.runs().to_pylist()}
    for k, span in enumerate(spans):
        gone = np.zeros(len(span), bool)
        for i in range(len(span) - 49):
            gone[i : i + 50] |= count[span[i : i + 50]] > 1
        runs = np.frombuffer(found.get(str(k).encode(), b""), "<i8").reshape(-1, 2)
        mine = np.zeros(len(span), bool)
        for a, b in runs:
            mine[a:b] = True
        assert mine.tolist() == gone.tolist()


def test_hot_anchors_are_split(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh ", k=rng.randrange(1, 9)))
    licence = " ".join(word() for _ in range(40))
    lines = {n: licence[:n] for n in (110, 150, 185, 199, 215)}
    texts = []
    for k in range(120):
        line = lines[rng.choice(list(lines))]
        texts.append(" ".join(word() for _ in range(50)) + line + " ".join(word() for _ in range(50)))
    texts += [texts[3], texts[5][20:-9], licence + texts[7][-150:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs, hot=10, shard_bytes=4000, memory=2000).collect())
    assert got == brute([(i, t.encode()) for i, t in enumerate(texts)], 200)


def test_texts_over_a_megabyte(spark):
    rng = np.random.default_rng(8)
    long = "".join(chr(c) for c in rng.integers(97, 123, 1_200_000))
    edge = suffix_dedup.PIECE
    texts = [long, "left " + long[edge - 150 : edge + 200] + " right", long[1_100_000:1_100_400], "x" * 1_100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect())
    gone = [{*range(edge - 150, edge + 200), *range(1_100_000, 1_100_400)}, set(range(5, 355)), set(range(400)), set(range(1_100_000))]
    for (doc, size, removed, spans, kept), text, out in zip(got, texts, gone):
        rest = "".join(c for i, c in enumerate(text) if i not in out)
        assert (size, removed, kept) == (len(text), len(out), hashlib.sha256(rest.encode()).hexdigest()), doc
        assert spans == sum(i - 1 not in out for i in out)


def test_anchors_are_least_grams():
    rng = np.random.default_rng(5)
    for data in (rng.integers(97, 100, 700).astype(np.uint8), np.full(400, 97, np.uint8)):
        anchors, hashes = suffix_dedup.window_anchors(data, 60, 20)
        for i, a in enumerate(anchors):
            part = hashes[i : i + 41]
            assert a == i + int(part.argmin())

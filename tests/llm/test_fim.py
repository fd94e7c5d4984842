from __future__ import annotations

import hashlib
import random
import re

import pytest

from tidepanel.llm import fim


def plain_form(doc, text):
    """The contract, on lists of tokens."""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(5)
    made = ["", None, "a", "<", "<P>", "x<S>y", "<S", "P>", "é" * 5000, "b" * 9000, "\x00\n\r  \U0001f600z"]
    for i in range(400):
        made.append("".join(rng.choice(["word", "Zed", " ", "\n", "<", "P>", "S", ">", "7", "é", "\U0001f600", "aaaaaaaaaaaa"]) for _ in range(rng.choice([1, 3, 40, 900]))))
    made.append("long text, of 1 MB; " * 60_000)
    return made


def test_equals_the_plain_transformation_and_restores(spark):
    rows = [(i * 3 - 50, t, "clash", 1) for i, t in enumerate(texts())] + [(None, "no id here", "x", 2), (7, "same row", "x", 3), (7, "same row", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    got = [tuple(r) for r in fim.restore_texts(fim.fill_in_middle(docs)).collect()]
    want = [(d, *plain_form(d, t or ""), t or "") for d, t, *_ in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("size", [1, 2, 5, 4096])
def test_rope_splits_at_every_rank(monkeypatch, size):
    monkeypatch.setattr(fim, "PIECE", re.compile(r"(?s:.{1,%d})[A-Za-z]*" % size))
    text = "ab, cd<e>f\n\nghi é1" * 3
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    rope = fim.build(text)
    assert (rope.units, rope.chars) == (len(units), len(text))
    for rank in range(len(units) + 1):
        a, b = fim.split(rope, rank)
        assert (fim.text_of(a), fim.text_of(b)) == ("".join(units[:rank]), "".join(units[rank:]))
        assert (a.units, b.units, a.chars + b.chars) == (rank, len(units) - rank, len(text))
        assert fim.text_of(fim.concat(b, a)) == "".join(units[rank:] + units[:rank])


def test_depth_stays_small():
    depth = lambda r: 0 if r.left is None else 1 + max(depth(r.left), depth(r.right))
    rope = fim.build("word " * 200_000)
    assert depth(rope) <= 10 and all(depth(x) <= 21 for x in fim.split(rope, 123_456))


def test_empty_table(spark):
    none = fim.restore_texts(fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")))
    assert none.collect() == [] and none.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from tidepanel.llm import sharding


def test_counts_slots_and_groups(spark):
    rng = random.Random(1)
    texts = [None, "", ""] + [f"text {rng.randrange(60)}" for _ in range(120)] + [f"own é {i}" for i in range(81)]
    rows = [(i % 190, t, 1) for i, t in enumerate(texts)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4), 8).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"rows"} and all(r["grown_shard"] is None for r in got)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for j in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == j) == list(range(counts[j]))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    groups = {}
    for r in got:
        groups.setdefault((r["text_crc32"], r["size"]), []).append(r["shard"])
    shared = [g for g in groups.values() if len(g) > 1]
    assert sum(len(set(g)) == 1 for g in shared) >= 0.8 * len(shared)


def test_group_larger_than_a_shard_and_small_tables(spark):
    docs = spark.createDataFrame([(i, "same" if i < 30 else f"t{i}") for i in range(40)], "doc_id long, text string")
    counts = Counter(r["shard"] for r in sharding.shard_documents(docs, 8).collect())
    assert sorted(counts.values()) == [5] * 8
    assert [r["slot"] for r in sharding.shard_documents(docs.limit(1), 8).collect()] == [0]
    assert sharding.shard_documents(docs.limit(0), 8).collect() == []


def test_propagation_lowers_the_cut(spark):
    rng = random.Random(2)
    edges = [(a * 10 + i, a * 10 + j, 1) for a in range(40) for i in range(10) for j in range(i) if rng.random() < 0.5]
    links = spark.createDataFrame(edges, "src long, dst long, weight int")
    nodes = spark.range(400).withColumnRenamed("id", "node")
    place = {r["node"]: r["shard"] for r in sharding.balanced(nodes, links, 4).collect()}
    assert max(Counter(place.values()).values()) == 100
    assert sum(place[a] != place[b] for a, b, _ in edges) < 0.5 * len(edges)


def test_every_group_that_fits_stays_whole(spark):
    docs = spark.createDataFrame([(i, "huge" if i < 150 else f"g{i // 5}") for i in range(800)], "doc_id long, text string").repartition(4)
    got = sharding.shard_documents(docs, 8).collect()
    counts, groups = Counter(r["shard"] for r in got), {}
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == j) == list(range(counts[j])) for j in counts)
    for r in got:
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) == 1


def test_propagation_settles_or_tells(spark):
    links = spark.createDataFrame([(i, i - i % 100, 1) for i in range(3000) if i % 100], "src long, dst long, weight int")
    place = {r["node"]: r["shard"] for r in sharding.propagate(links, [1000] * 8).collect()}
    assert all(place[i] == place[i - i % 100] for i in place)
    with pytest.warns(UserWarning, match="bound of 1 rounds"):
        sharding.propagate(links, [1000] * 8, rounds=1)


def line_sets(rng):
    """Texts of forty families of five: a family shares a line, all share another one, no two texts are equal."""
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common = say(3)
    family = [say(20) for _ in range(40)]
    return [(i, f"{say(8)}\n {family[i % 40]}\t\r\n\n{common}\n{family[i % 40]}\n{say(5)}") for i in range(200)]


def test_rows_that_share_lines_keep_together(spark):
    docs = spark.createDataFrame(line_sets(random.Random(4)), "doc_id long, text string").repartition(4)
    split = {}
    for lines in (False, True):
        got = sharding.shard_documents(docs, 8, lines=lines).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(200)) and set(Counter(r["shard"] for r in got).values()) == {25}
        assert all(sorted(r["slot"] for r in got if r["shard"] == j) == list(range(25)) for j in range(8))
        place = {r["doc_id"]: r["shard"] for r in got}
        split[lines] = sum(place[i] != place[i % 40] for i in range(40, 200))
    assert split[True] < 0.5 * split[False]


def test_line_links_join_all_holders_by_small_trees(spark):
    held = [(i, 1, 9) for i in range(1000)] + [(i, 2 + i // 3, 4) for i in range(300)]
    links = sharding.line_links(spark.createDataFrame(held, "node long, line long, n int")).collect()
    degree = Counter(r["dst"] for r in links)
    assert max(degree.values()) <= 3 * (1000 // sharding.PARTS + sharding.PARTS) / 2
    root = list(range(1000))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for r in links:
        assert r["src"] != r["dst"] and r["weight"] in (4, 9, 13)
        root[find(r["src"])] = find(r["dst"])
    assert len({find(i) for i in range(1000)}) == 1
    small = [(r["src"], r["dst"]) for r in links if r["weight"] in (4, 13)]
    assert len(small) == 200 and all(a // 3 == b // 3 for a, b in small)

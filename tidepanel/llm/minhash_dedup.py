"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round i every shingle of a document is thrown
into one of t bins with value i + hash; a bin keeps its least value. After t rounds, round t + j
throws all shingles into bin j, so that every bin is filled. Each bin agrees between two
documents with the probability of their Jaccard similarity, with concentration bounds.

Banding: BANDS groups of ROWS bins. Two sets of similarity s share a band with probability
1 - (1 - s^ROWS)^BANDS, which is over 1 - 1e-8 for s = 0.85 (40 bands of 6).

Verification: documents of a shared band meet in one task with their full shingle sets, where a
search over postings links every pair that reaches the threshold and is not connected yet. It
returns a spanning forest of the true links, so that at most one row leaves for each document
of a bucket, and no link between components is lost. Buckets of more than BLOCK_SHINGLES are
cut into blocks, and each pair of blocks is searched, so that no task holds a hot bucket whole.
Copies (equal sets) are folded before banding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.components import connected_components
from tidepanel.llm.texthash import mix, shingle_sets
from tidepanel.session import materialize, shuffle_partitions

BANDS, ROWS = 40, 6
BLOCK_SHINGLES, BLOCK_DOCS = 2_000_000, 4000
_U = np.uint64
_LOW32 = _U(0xFFFFFFFF)


def fast_similarity_sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The sketch of a nonempty set of 64-bit hashes: `bins` values, round in the upper half."""
    out = np.full(bins, np.iinfo(_U).max, _U)
    done, n = 0, len(shingles)
    while done < bins:
        rounds = min(bins - done, max(1, -(-3 * bins // n)))
        numbers = np.arange(done, done + rounds, dtype=_U)
        hashes = mix(shingles[None, :] ^ mix(numbers + _U(1))[:, None])
        values = (numbers << _U(32))[:, None] | (hashes & _LOW32)
        places = ((hashes >> _U(32)) * _U(bins)) >> _U(32)
        np.minimum.at(out, places.ravel().astype(np.int64), values.ravel())
        done += rounds
        if out.max() < np.iinfo(_U).max:
            return out
    for j in np.flatnonzero(out == np.iinfo(_U).max):
        number = np.array([bins + j], _U)
        hashes = mix(shingles ^ mix(number + _U(1)))
        out[j] = (number[0] << _U(32)) | (hashes & _LOW32).min()
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ."""
    key = mix(np.arange(1, bands + 1, dtype=_U))
    for part in sketch.reshape(bands, rows).T:
        key = mix(key * _U(0xD1342543DE82EF95) ^ part)
    return key.view(np.int64)


def _node(shingles: np.ndarray) -> int | None:
    """A 64-bit name of a set; None for the empty one."""
    return int.from_bytes(hashlib.sha256(shingles.tobytes()).digest()[:8], "little", signed=True) if len(shingles) else None


def _signatures(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for s in shingle_sets(batch.column(1)):
                sizes.append(len(s))
                nodes.append(_node(s))
                keys.append(band_keys(fast_similarity_sketch(s, bands * rows), bands, rows).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.binary())], ["doc", "n_shingles", "node", "keys"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n_shingles, keys) to a row for each band key."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            keys = [np.frombuffer(k, np.int64) for k in part.column(2).to_pylist()]
            each = [len(k) for k in keys]
            node, n = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), each) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(node), pa.array(n)], ["key", "node", "n_shingles"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sets = list(shingle_sets(batch.column(1).slice(at, 512)))
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])


def spanning_links(docs: list, sets: list[np.ndarray], num: int, den: int) -> list[tuple]:
    """A spanning forest of the graph that links sets with den * |a & b| >= num * |a | b|.

    Searches breadth first. Each document is compared once, through postings, with the documents
    that no search has reached yet; larger sets go first, which tend to be the originals.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    bounds = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    lengths = np.diff(bounds)
    rank = np.repeat(np.arange(len(lengths)), lengths)
    #: postings of shingles that several documents have, and of each document its ranks
    back = np.argsort(owner, kind="stable")
    ranks, firsts = rank[back], np.r_[0, np.cumsum(sizes)]
    waiting = np.ones(len(sets), bool)
    links = []
    for root in np.argsort(-sizes, kind="stable"):
        if not waiting[root]:
            continue
        waiting[root] = False
        frontier = [root]
        while frontier and waiting.any():
            at = frontier.pop()
            own = ranks[firsts[at] : firsts[at + 1]]
            own = own[lengths[own] > 1]
            if not len(own):
                continue
            run = lengths[own]
            places = np.repeat(bounds[own] - np.r_[0, np.cumsum(run)[:-1]], run) + np.arange(run.sum())
            common = np.bincount(owner[places], minlength=len(sets))
            union = sizes + sizes[at] - common
            for other in np.flatnonzero(waiting & (common > 0) & (den * common >= num * union)):
                waiting[other] = False
                links.append((docs[at], docs[other]))
                frontier.append(other)
    return links


def _verify(num: int, den: int):
    def flush(docs: list, sets: list) -> pa.RecordBatch:
        links = spanning_links(docs, [np.frombuffer(s, _U) for s in sets], num, den) if len(docs) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, sets = None, [], []
        for batch in batches:
            for bucket, doc, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now:
                    if len(docs) > 1:
                        yield flush(docs, sets)
                    now, docs, sets = bucket, [], []
                docs.append(doc)
                sets.append(s)
        if len(docs) > 1:
            yield flush(docs, sets)

    return run


def near_duplicate_links(docs: DataFrame, signatures: DataFrame, num: int, den: int) -> DataFrame:
    """(src, dst): a spanning forest of the links between the sets in signatures.

    docs: (doc, text). signatures: (node, doc, n_shingles, keys), one row for each distinct set.
    """
    parts = shuffle_partitions(docs.sparkSession)
    unpacked = signatures.select("node", "n_shingles", "keys").mapInArrow(_unpack, "key long, node long, n_shingles long")
    keys = materialize(unpacked, "band-keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight"), F.sum(F.pmod(F.xxhash64("node"), F.lit(1 << 40))).alias("mark"), F.min("node").alias("first")).where("members > 1")
    #: bands in which the same documents meet are searched once
    shared = shared.groupBy("members", "weight", "mark", "first").agg(F.min("key").alias("key"))
    shared = shared.select("key", F.greatest(F.ceil(F.col("weight") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_DOCS)).cast("int").alias("blocks"))
    members = materialize(keys.join(shared, "key").select("key", "node", "blocks"), "band-members")
    wanted = signatures.join(members.select("node").distinct(), "node", "left_semi").select("doc").distinct()
    sets = materialize(docs.join(wanted.hint("shuffle_hash"), "doc", "left_semi").select("doc", "text").mapInArrow(_sets, "node long, shingles binary"), "shingle-sets")
    #: a row goes to every pair of blocks that holds its own block
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bucket = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = dealt.select(bucket.alias("bucket"), "node").join(sets, "node").select("bucket", "node", "shingles")
    links = rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_verify(num, den), "src long, dst long")
    return links.distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 4, den: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is num/den or
    more (0.8 unless given). component_id is the smallest id reachable over links. Null and blank
    texts have no shingles and link with nothing. Rows that repeat an id are documents of their own
    that share the id, null ids among them. Ids are whole numbers: a text that is none ends the job. Texts
    of any length are read whole. Other columns are left aside, whatever their names; an empty table gives
    an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(source.mapInArrow(_signatures(bands, rows), "doc long, n_shingles long, node long, keys binary"), "signatures")
    first = signed.where("node is not null").groupBy("node").agg(F.min("doc").alias("doc"))
    one = signed.select("node", "doc", "n_shingles", "keys").join(first, ["node", "doc"], "left_semi").dropDuplicates(["node"])
    found = connected_components(near_duplicate_links(source, one, num, den))
    classes = first.join(found, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    classes = classes.join(classes.groupBy("component").agg(F.min("doc").alias("component_id")), "component").select("node", "component_id")
    out = signed.select("doc", "n_shingles", "node").join(classes, "node", "left")
    out = out.select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))

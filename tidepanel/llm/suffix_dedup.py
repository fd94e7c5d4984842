"""Exact substring deduplication: remove every byte of a WINDOW-byte string that occurs elsewhere.

The decision over a window comes from suffixes and common prefixes sorted by external induced
sorting (suffixsort). What a shard holds is chosen so that equal windows meet:

1. Each window has an anchor, its GRAM-byte gram of the least hash (the leftmost of equals).
   Equal windows have equal anchors, and windows whose anchor gram occurs once cannot repeat.
2. The windows of one anchor occurrence are one stretch of text, a span. Spans travel to the
   shard of their anchor's hash; equal spans are folded with their count before they travel.
3. An anchor with more than HOT spans is dealt out: windows that hold it at nearby offsets (a class
   of `width` offsets) share a longer stretch, the class's core, which takes the anchor's place. Cores
   that occur once are done; those still hot are split by narrower classes, at last of one offset,
   where the core is the window. So no passage gathers its surroundings in one task.
4. A shard joins the spans of anchors that have several different ones into texts of about SHARD_BYTES
   (whole anchors), sorts all suffixes and marks those with a common prefix of WINDOW bytes with a
   neighbour; spans that occur twice are marked whole. Its queues and texts go to disk beyond
   suffixsort.MEMORY_BYTES.
5. Marks go back to the spans' places. Documents are cut and hashed where something is removed.

Texts that occur twice or more are removed whole if they have WINDOW bytes, and only the first
of them takes part as a partner of others.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.suffixsort import MEMORY_BYTES, chunks, sorted_suffixes, space
from tidepanel.llm.texthash import _BASE, _INVERSE, _LETTER, mix, text_buffer
from tidepanel.session import drop_tables, materialize, shuffle_partitions

WINDOW, GRAM = 200, 100
SHARD_BYTES = 8 << 20
#: an anchor with more spans is split, first by classes of as many offsets, then by the next
HOT, WIDTHS = 4096, (33, 7, 1)
PIECE = 1 << 18
_PLACES = 1 << 19
#: spans that a task remembers to have sent
_SENT = 1 << 16
_U = np.uint64
_BYTE = mix(np.arange(301, 557, dtype=_U))
_table: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _table or len(_table["up"]) < n:
        steps = np.full(max(n, PIECE + 2 * WINDOW), _BASE, _U)
        steps[0] = 1
        _table["up"] = np.multiply.accumulate(steps)
        steps[1:] = _INVERSE
        _table["down"] = np.multiply.accumulate(steps)
    return _table["up"], _table["down"]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every gram-byte stretch of data."""
    n = len(data)
    up, down = _powers(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def window_anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, gram hashes): positions of the leftmost least gram in every window of data."""
    hashes = gram_hashes(data, gram)
    width, n = window - gram + 1, len(hashes)
    if n > _PLACES:
        raise ValueError(f"more than {_PLACES} grams; see pieces()")
    #: a gram's rank is its hash with its place in the low bits, so that a minimum names the leftmost place
    ranked = (hashes & ~_U(_PLACES - 1)) | np.arange(n, dtype=_U)
    #: minima of `width` neighbours: running minima from both ends of blocks of that width
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(_U).max, _U)
    padded[:n] = ranked
    shaped = padded.reshape(blocks, width)
    right = np.minimum.accumulate(shaped, axis=1).ravel()
    left = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    anchors = (np.minimum(left[: n - width + 1], right[width - 1 : n]) & _U(_PLACES - 1)).astype(np.int64)
    return anchors, hashes


def pieces(n: int, window: int) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that together hold every window of n bytes once."""
    windows, at = n - window + 1, 0
    while at < windows:
        to = min(windows, at + PIECE)
        yield at, to + window - 1
        at = to


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            keys, sizes, found = [], [], []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                data = raw[a:b]
                keys.append(hashlib.sha256(data.tobytes()).digest())
                sizes.append(b - a)
                own = []
                for lo, hi in pieces(b - a, window):
                    anchors, hashes = window_anchors(data[lo:hi], window, gram)
                    places = anchors[np.r_[True, anchors[1:] != anchors[:-1]]]
                    own.append(hashes[places].tobytes())
                found.append(b"".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["doc", "key", "n_bytes", "anchors"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in packed])
        values = np.concatenate(packed) if packed else np.zeros(0, np.int64)
        for at in range(0, max(1, len(values)), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 18)]), pa.array(values[at : at + (1 << 18)])], ["node", "anchor"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to (doc, key, compressed text), the form in which texts are shuffled."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw, offs = text_buffer(batch.column(1))
        texts = [raw[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([squeeze.compress(t) for t in texts], pa.binary())], ["doc", "key", "packed"])


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    stretch = zstandard.ZstdDecompressor()
    for x in column:
        yield np.frombuffer(stretch.decompress(x.as_py()), np.uint8)


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _span_rows(window: int, gram: int):
    """(node, copies, wanted anchors, text) to the spans of wanted anchors.

    A span's bytes go along once a task; `told` marks the first two rows of a span in a task, which
    is all that its count needs. Texts are unpacked and cut one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        rows: list[tuple] = []
        weight = 0
        stretch = zstandard.ZstdDecompressor()
        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(_U)
            for k, (node, copies) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                wanted = np.unique(flat[ends[k] : ends[k + 1]])
                data = np.frombuffer(stretch.decompress(batch.column(3)[k].as_py()), np.uint8)
                for lo, hi in pieces(len(data), window):
                    anchors, hashes = window_anchors(data[lo:hi], window, gram)
                    firsts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
                    ends_at = np.r_[firsts[1:], len(anchors)]
                    own = hashes[anchors[firsts]]
                    keep = np.isin(own, wanted)
                    offsets = anchors[firsts] - firsts
                    for f, e, h, at in zip(firsts[keep].tolist(), ends_at[keep].tolist(), own[keep].view(np.int64).tolist(), offsets[keep].tolist(), strict=True):
                        span = data[lo + f : lo + e + window - 1].tobytes()
                        digest = _digest(span, h.to_bytes(8, "little", signed=True))
                        times = sent.get(digest, 0)
                        rows.append((h, digest, node, lo + f, copies, times < 2, at, None if times else span))
                        if not times:
                            weight += len(span)
                            if len(sent) > _SENT:
                                sent.clear()
                        sent[digest] = times + 1
                        if weight > 1 << 21 or len(rows) > 1 << 13:
                            yield _pack_spans(rows)
                            rows, weight = [], 0
        if rows:
            yield _pack_spans(rows)

    return run


def _batch(rows: list[tuple], names: list[str], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _pack_spans(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
    return _batch(rows, ["anchor", "digest", "node", "start", "copies", "told", "at", "span"], types)


def _split_spans(window: int, gram: int, width: int):
    """Distinct spans (digest, count, place of the anchor, bytes) to their parts by class of `width` anchor offsets."""
    names = ["anchor", "parent", "shift", "digest", "count", "at", "span"]
    types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = [], 0
        for batch in batches:
            for parent, count, at, span in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                #: a window at f holds the anchor at offset at - f, from 0 to window - gram
                for kind in range(max(0, at - (len(span) - window)) // width, min(window - gram, at) // width + 1):
                    low, high = max(0, at - kind * width - width + 1), min(len(span) - window, at - kind * width)
                    core = span[at - kind * width : at - kind * width - width + 1 + window]
                    key = _digest(core, bytes((kind, width)))
                    part = span[low : high + window]
                    rows.append((int.from_bytes(key[:8], "little", signed=True), parent, low, _digest(part, key), count, at - low, part))
                    weight += len(part)
                if weight > 1 << 21:
                    yield _batch(rows, names, types)
                    rows, weight = [], 0
        if rows:
            yield _batch(rows, names, types)

    return run


class Shard:
    """Spans as they arrive, each followed by a separator; in a temporary file beyond `memory` bytes."""

    def __init__(self, window: int, memory: int = MEMORY_BYTES):
        self.window, self.memory, self.size = window, memory, 0
        self.digests: list[bytes] = []
        self.lengths: list[int] = []
        self.counts: list[int] = []
        self.alone: list[tuple[bytes, int]] = []
        self.store = tempfile.SpooledTemporaryFile(max_size=memory)

    def add(self, digest: bytes, count: int, span: bytes) -> None:
        self.digests.append(digest)
        self.lengths.append(len(span))
        self.counts.append(count)
        self.store.write(span + b"\0")
        self.size += len(span) + 1

    def marked(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the spans, whether the window that begins at a place occurs at another place)."""
        starts = np.r_[0, np.cumsum(np.array(self.lengths, np.int64) + 1)]
        text = space(self.size + 1, np.uint16, self.memory)
        self.store.seek(0)
        for part in chunks(self.size):
            text[part] = np.frombuffer(self.store.read(part.stop - part.start), np.uint8)
            text[part] += 2
        text[starts[1:] - 1] = 1  # between spans, below all bytes
        text[-1] = 0
        marked = space(len(text), bool, self.memory)
        marked[:] = False
        before = 0
        for pos, common in sorted_suffixes(text, 258, self.window, self.memory):
            near = np.flatnonzero(common >= self.window)
            marked[pos[near]] = True
            marked[np.where(near > 0, pos[near - 1], before)] = True
            before = pos[-1]
        return starts, marked

    def runs(self) -> pa.RecordBatch:
        """(digest, runs of bytes that repeated windows cover) for the spans that have some."""
        window = self.window
        starts, marked = self.marked() if self.digests else (np.zeros(1, np.int64), np.zeros(0, bool))
        lengths, whole = np.array(self.lengths, np.int64), np.array(self.counts, np.int64) > 1
        begins, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in chunks(self.size):
            at = np.flatnonzero(marked[part]) + part.start
            own = np.searchsorted(starts, at, side="right") - 1
            ok = ~whole[own] & (at - starts[own] <= lengths[own] - window)
            begins.append(at[ok] - starts[own[ok]])
            owner.append(own[ok])
        at, own = np.concatenate(begins), np.concatenate(owner)
        cut = np.flatnonzero(np.r_[True, (at[1:] - at[:-1] > window) | (own[1:] != own[:-1])]) if len(at) else np.zeros(0, np.int64)
        found = np.stack([at[cut], at[np.r_[cut[1:], len(at)] - 1] + window], axis=1).astype("<i8") if len(at) else np.zeros((0, 2), "<i8")
        heads = np.flatnonzero(np.r_[True, np.diff(own[cut]) != 0]) if len(cut) else np.zeros(0, np.int64)
        some = [(self.digests[k], found[a:b].tobytes()) for k, a, b in zip(own[cut][heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(cut)], strict=True)] if len(cut) else []
        both = [(self.digests[k], int(lengths[k])) for k in np.flatnonzero(whole).tolist()] + self.alone
        some += [(digest, np.array([0, length], "<i8").tobytes()) for digest, length in both]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], pa.binary()) for i in (0, 1)], ["digest", "runs"])


def _sort_shard(window: int, shard_bytes: int, memory: int):
    """Spans by anchor and digest to the runs that repeat; a shard ends after an anchor's last span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, group, last = Shard(window, memory), None, 0, None  # last: the span at hand, which may go on

        def put() -> None:
            if group > 1:
                shard.add(*last)
            elif last and last[1] > 1:  # the anchor's only span
                shard.alone.append((last[0], len(last[2])))

        for batch in batches:
            for anchor, digest, count, span in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last and digest == last[0]:
                    last[1] += count
                    continue
                if anchor != now:
                    put()
                    if shard.size > shard_bytes or len(shard.alone) > _SENT:
                        yield shard.runs()
                        shard = Shard(window, memory)
                    now, group = anchor, 1
                else:
                    group += 1
                    shard.add(*last)
                last = [digest, count, span]
        put()
        yield shard.runs()

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, places) to what is removed of each text and the hash of the rest."""
    for batch in batches:
        rows = []
        for key, places, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _texts(batch.column(1)), strict=True):
            edges = np.zeros(len(data) + 1, np.int32)
            for place in places:
                runs = np.frombuffer(place["runs"], "<i8").reshape(-1, 2) + place["start"]
                np.add.at(edges, runs[:, 0], 1)
                np.add.at(edges, runs[:, 1], -1)
            gone = np.cumsum(edges)[:-1] > 0
            spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
            rows.append((key, int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], ["key", "n_removed", "n_spans", "kept_sha256"])


def _hot_anchors(told: DataFrame, hot: int) -> DataFrame:
    """The anchors of more than `hot` rows, written out."""
    return materialize(told.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor"), "suffix-hot")


def _repeated_runs(told: DataFrame, window: int, gram: int, hot: int, shard_bytes: int, memory: int) -> DataFrame:
    """(digest, shift, runs): what repeats of the spans told (anchor, digest, count, at, span)."""
    parts = shuffle_partitions(told.sparkSession)
    columns = ["anchor", "digest", "count", "span"]
    ready, links = [], []
    for width in WIDTHS:
        hottest = _hot_anchors(told, hot)
        if hottest.isEmpty():
            break
        ready.append(told.join(hottest, "anchor", "left_anti").select(columns))
        #: the bytes came with one row of each task at least
        folded = told.join(hottest, "anchor", "left_semi").groupBy("anchor", "digest").agg(F.sum("count").alias("count"), F.max("at").alias("at"), F.max("span").alias("span"))
        split = folded.select("digest", "count", "at", "span").mapInArrow(_split_spans(window, gram, width), "anchor long, parent binary, shift long, digest binary, count long, at int, span binary")
        split = materialize(split, "suffix-split")
        again = materialize(split.groupBy("anchor").agg(F.sum("count").alias("n")).where("n > 1").select("anchor"), "suffix-again")
        split = materialize(split.join(again, "anchor", "left_semi"), "suffix-split")
        links.append(split.select("parent", "shift", "digest"))
        told = split.groupBy("anchor", "digest").agg(F.sum("count").alias("count"), F.max("at").alias("at"), F.max("span").alias("span"))
    ready.append(told.select(columns))
    #: within a digest the row that has the bytes comes first
    for k, rows in enumerate(ready):
        dealt = rows.repartition(parts, "anchor").sortWithinPartitions("anchor", "digest", F.col("span").desc_nulls_last())
        found = dealt.mapInArrow(_sort_shard(window, shard_bytes, memory), "digest binary, runs binary").withColumn("shift", F.lit(0).cast("long"))
        ready[k] = materialize(found, "suffix-runs")
    #: from the narrowest parts back to the spans they were cut from
    found = ready.pop()
    while links:
        link = links.pop()
        found = found.withColumnRenamed("shift", "inner").join(link, "digest").select(F.col("parent").alias("digest"), "runs", (F.col("shift") + F.col("inner")).alias("shift"))
        found = ready.pop().unionByName(found)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    Texts are taken as UTF-8; strings are judged on the input. Null texts are empty; texts of fewer than
    `window` bytes stay whole; very long ones are cut into pieces that share their windows' bytes. Rows of
    equal text, repeated rows too, are copies of each other. Ids keep their type and may be null or repeat.
    Other columns are left aside; an empty table gives an empty result.

    hot: spans of an anchor that one task sorts at most. shard_bytes: text that is sorted at once; an anchor
    that goes on over the edge is kept whole. memory: bytes of each array and queue before the disk is used.
    """
    source = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    signed = source.mapInArrow(_anchor_rows(window, gram), f"doc {kind}, key binary, n_bytes long, anchors binary").withColumn("node", F.monotonically_increasing_id())
    signed = materialize(signed, "suffix-docs")
    first = signed.groupBy("key").agg(F.min(F.struct("node", "doc")).alias("rep"), F.count(F.lit(1)).alias("copies"))
    first = materialize(first.select("key", "rep.node", F.col("rep.doc").alias("rep_doc"), "copies"), "suffix-texts")

    #: not dealt by anchor beforehand: the count combines before its shuffle and the join splits a hot anchor
    unpacked = signed.join(first.select("node"), "node", "left_semi").select("node", "anchors").mapInArrow(_unpack, "node long, anchor long")
    anchors = materialize(unpacked, "suffix-anchors")
    shared = materialize(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "suffix-shared")
    wanted = anchors.join(shared, "anchor").groupBy("node").agg(F.collect_list("anchor").alias("wanted"))
    wanted = first.join(wanted, "node").select(F.col("key").alias("rep_key"), "rep_doc", "node", "copies", "wanted")
    texts = source.mapInArrow(_packed, f"doc {kind}, key binary, packed binary")
    one = (F.col("key") == F.col("rep_key")) & F.col("doc").eqNullSafe(F.col("rep_doc"))
    spans = texts.join(wanted.hint("shuffle_hash"), one).select("node", "copies", "wanted", "packed").mapInArrow(_span_rows(window, gram), "anchor long, digest binary, node long, start long, copies long, told boolean, at int, span binary")
    spans = materialize(spans, "suffix-spans")
    drop_tables(anchors, shared)
    runs = _repeated_runs(spans.where("told").select("anchor", "digest", F.col("copies").alias("count"), "at", "span"), window, gram, hot, shard_bytes, memory)
    cuts = spans.where("copies = 1").select("digest", "node", "start").join(runs, "digest").groupBy("node").agg(F.collect_list(F.struct((F.col("start") + F.col("shift")).alias("start"), "runs")).alias("places"))
    cuts = first.join(cuts, "node").select(F.col("key").alias("rep_key"), "places")
    cut = texts.select("key", "packed").join(cuts.hint("shuffle_hash"), F.col("key") == F.col("rep_key")).select("key", "packed", "places").mapInArrow(_cut, "key binary, n_removed long, n_spans long, kept_sha256 string")
    whole = F.when((F.col("copies") > 1) & (F.col("n_bytes") >= window), F.col("n_bytes"))
    nothing = hashlib.sha256(b"").hexdigest()
    out = signed.select("doc", "key", "n_bytes").join(first.select("key", "copies"), "key").join(cut, "key", "left")
    return out.select(
        F.col("doc").alias(id_col),
        "n_bytes",
        F.coalesce(whole, "n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.when(whole.isNotNull(), F.lit(1)), "n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(F.when(whole.isNotNull(), F.lit(nothing)), "kept_sha256", F.lower(F.hex("key"))).alias("kept_sha256"),
    )

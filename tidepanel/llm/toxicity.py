"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of its word pairs, and of its pairs with
one word between them, in BUCKETS buckets, each of value 1. Training follows McMahan et al. (2013): each
coordinate has its own rate from its summed squared gradients, and L1 keeps most weights at
zero, so that the model is a short list of (bucket, weight) that every task can hold.

The model is fitted on at most about SAMPLE labelled rows, drawn by a hash of the id (all rows
are used if there are no more). The sample is split into shards of about SHARD_ROWS; each runs
EPOCHS passes of FTRL from zero, and the shards' states are averaged coordinate by coordinate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.texthash import doc_chunks, mix, text_buffer, word_hashes

BUCKETS_LOG2 = 20
SAMPLE, SHARD_ROWS, EPOCHS = 12_000, 6_000, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.1
THRESHOLD = 0.3
_U = np.uint64


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BUCKETS_LOG2, np.float32)
        out[self.buckets] = self.weights
        return out


def feature_buckets(words: np.ndarray) -> np.ndarray:
    """Buckets of words, pairs and skip-pairs of a word sequence, in three runs; not yet distinct."""
    shift = _U(64 - BUCKETS_LOG2)
    pairs = mix(words[:-1] * _U(3) + words[1:] * _U(5) + _U(1))
    skips = mix(words[:-2] * _U(7) + words[2:] * _U(11) + _U(2))
    return (np.concatenate([words, pairs, skips]) >> shift).astype(np.int64)


def _documents(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    raw, offs = text_buffer(column)
    for lo, hi in doc_chunks(offs):
        words, _, _, first = word_hashes(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield words[a:b]


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.unique(feature_buckets(w)).astype("<u4").tobytes() for w in _documents(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["doc", "label", "features"])


class Ftrl:
    """Per-coordinate state of FTRL-proximal; coordinate 0 of the extra last place is the bias."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of one shard after its passes, at the coordinates that its rows touch."""
    size = (1 << BUCKETS_LOG2) + 1
    state, touched, rows = Ftrl(np.zeros(size), np.zeros(size)), np.zeros(size, bool), []
    for batch in batches:
        for label, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.append((float(label), np.r_[np.frombuffer(packed, "<u4").astype(np.int64), size - 1]))
            touched[rows[-1][1]] = True
    for _ in range(EPOCHS):
        for label, at in rows:
            state.learn(at, label)
    some = np.flatnonzero(touched)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(state.z[some]), pa.array(state.n[some])], ["at", "z", "n"])


def held_out(id_col: Column) -> Column:
    """Whether a row's label must not be learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows that are not held out.

    Labels that are null or belong to no document are left aside; an id with several labels counts
    as toxic if one of them says so. Ids are whole numbers: a text that is none ends the job. Texts of any
    length are read whole; other columns are left aside, whatever their names. Without any label nothing is known to be toxic, and texts score next to 0.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("doc")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("label"))
    total = known.count()
    scale = 1 << 40
    chosen = known.where(F.pmod(F.xxhash64("doc"), F.lit(scale)) < int(scale * min(1.0, sample / max(1, total))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    #: the sample's ids have a bound of their own, so they go to the documents
    features = rows.join(F.broadcast(chosen), "doc").mapInArrow(_featurize, "doc long, label int, features binary")
    shards = max(1, round(min(total, sample) / SHARD_ROWS))
    dealt = features.repartition(shards, F.pmod(F.xxhash64("doc"), F.lit(shards * 1009))).sortWithinPartitions(F.xxhash64("doc", F.lit(7)), "features").select("label", "features")
    states = dealt.mapInArrow(_passes, "at long, z double, n double").groupBy("at").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()
    z, n = np.zeros((1 << BUCKETS_LOG2) + 1), np.zeros((1 << BUCKETS_LOG2) + 1)
    at = states.column("at").to_numpy()
    z[at], n[at] = states.column("z").to_numpy(), states.column("n").to_numpy()
    if not n[-1]:  # no row was learnt from
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -35.0)
    w = Ftrl(z, n).weights(slice(None))
    some = np.flatnonzero(w[:-1])
    return Model(some, w[some].astype(np.float32), float(w[-1]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            sums = []
            for words in _documents(batch.column(1)):
                at = feature_buckets(words)
                at = np.unique(at[dense[at] != 0])
                sums.append(model.bias + float(dense[at].sum(dtype=np.float64)))
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs.

    Null texts are empty and get the score of the bias; ids, languages, sources and labels play no part
    in a score. Repeated rows give repeated rows, other columns are left aside, an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(model), "doc long, score double")
    return scored.select(F.col("doc").alias(id_col), held_out(F.col("doc")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores the threshold or more; columns stay as they are. Null texts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            keep = []
            for words in _documents(batch.column(batch.schema.get_field_index(text_col)).cast(pa.string())):
                at = feature_buckets(words)
                at = np.unique(at[weights[at] != 0])
                s = model.bias + float(weights[at].sum(dtype=np.float64))
                keep.append(1 / (1 + np.exp(-np.clip(s, -35, 35))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

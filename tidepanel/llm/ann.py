"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) carries a unit vector to a
point whose nearest signed axis is its hash; a table concatenates a few such hashes. Rows enter one bucket a
table, queries probe those with the least loss of squared length. Rows and probes meet by bucket, in blocks of
bounded size, and each block reranks exactly and keeps a query's nearest rows, so no list of pairs is made.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.session import drop_tables, materialize

TABLES = 8
#: rows a bucket should have on average; more means fewer probes and more scalar products
ROWS_A_BUCKET = 128
#: probes a table: this times the root of the number of buckets
PROBES = 1.5
#: rows, and likewise probes, that meet in one block; fuller buckets are cut into several
BLOCK = 4096
#: scores by matrix product that lie this close are told apart by the exact one
CLOSE = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


@dataclass(frozen=True)
class Hashing:
    """width: a power of two that vectors are padded to; axes: the rotated axes that each function of a table looks at."""

    width: int
    axes: tuple[int, ...]
    tables: int = TABLES

    @property
    def buckets(self) -> int:
        return math.prod(2 * a for a in self.axes)

    @property
    def probes(self) -> int:
        return min(self.buckets, math.ceil(PROBES * math.sqrt(self.buckets)))

    def losses(self, x: np.ndarray, table: int) -> Iterator[np.ndarray]:
        """For each function, how much nearer the nearest signed axis is than each one."""
        for k, axes in enumerate(self.axes):
            y = x
            for turn in range(3):
                y = hadamard(y * np.random.default_rng([table, k, turn]).choice([-1.0, 1.0], self.width))
            y = np.concatenate([y[:, :axes], -y[:, :axes]], axis=1)
            yield (y.max(axis=1, keepdims=True) - y) ** 2

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each unit vector."""
        out = np.zeros(len(x), np.int64)
        for loss in self.losses(x, table):
            out = out * loss.shape[1] + loss.argmin(axis=1)
        return out

    def probe(self, x: np.ndarray, table: int) -> np.ndarray:
        """The buckets of least summed loss for each unit vector; a prefix beyond that number can't be part of one."""
        codes, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for loss in self.losses(x, table):
            choices = loss.shape[1]
            total = (total[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
            codes = (codes[:, :, None] * choices + np.arange(choices)).reshape(len(x), -1)
            best = np.argsort(total, axis=1, kind="stable")[:, : self.probes]
            total, codes = np.take_along_axis(total, best, 1), np.take_along_axis(codes, best, 1)
        return codes


def hashing_for(rows: int, length: int, tables: int = TABLES) -> Hashing:
    """Functions enough for rows / ROWS_A_BUCKET buckets: all axes for each but the last, which takes as many as are wanted."""
    width = 1 << max(0, length - 1).bit_length()
    axes, wanted = [], max(2.0, rows / ROWS_A_BUCKET)
    while wanted > 1:
        axes.append(min(width, 1 << max(0, math.ceil(math.log2(wanted)) - 1)))
        wanted /= 2 * axes[-1]
    return Hashing(width, tuple(axes), tables)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows padded by zeros, each scaled by a power of two that brings its largest component near 1."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0))[1][:, None])


def _unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added in the order of the components, so that equal rows give equal sums."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _entries(hashing: Hashing, probing: bool):
    """Each row once a table, in its bucket or in all that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), hashing.width)
            unit = vectors / np.sqrt(_dot(vectors, vectors))[:, None]
            packed = pa.array([v.tobytes() for v in vectors], pa.binary())
            for table in range(hashing.tables):
                codes = hashing.probe(unit, table) if probing else hashing.bucket(unit, table)[:, None]
                rows = pa.array(np.repeat(np.arange(len(unit)), codes.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(codes.size, table), pa.int32()), pa.array(codes.ravel(), pa.int64()), batch.column(0).take(rows), packed.take(rows)],
                    ["table", "bucket", "id", "vector"],
                )

    return run


def _nearest(width: int, k: int):
    """The k nearest of a block's rows for each of its probes, own ids left out; a probe is told by its id and its vector's digest."""

    def run(rows: pa.Table, probes: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy(), probes["id"].to_numpy()
        found: list[tuple[np.ndarray, ...]] = []
        if len(ids[0]) and len(ids[1]):
            x, q = (_unpacked(t["vector"], width) for t in (rows, probes))
            norm_x, norm_q = np.sqrt(_dot(x, x)), np.sqrt(_dot(q, q))
            near = (q / norm_q[:, None]) @ (x / norm_x[:, None]).T
            near[ids[1][:, None] == ids[0]] = -np.inf
            least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -2.0)
            for i, row in enumerate(near):
                at = np.flatnonzero(row >= max(least[i], -1.5) - CLOSE)
                score = _dot(x[at], np.broadcast_to(q[i], (len(at), width))) / (norm_q[i] * norm_x[at])
                first = np.lexsort((ids[0][at], -score))[:k]
                found.append((np.full(len(first), i), at[first], score[first]))
        i, at, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        marks = pa.array([hashlib.md5(v).digest() for v in probes["vector"].to_pylist()], pa.binary())
        columns = [probes["id"].combine_chunks().take(pa.array(i)), marks.take(pa.array(i)), rows["id"].combine_chunks().take(pa.array(at)), pa.array(score)]
        return pa.table(columns, names=["query_id", "query", "vec_id", "score"])

    return run


def _in_blocks(rows: DataFrame, probes: DataFrame, width: int, k: int) -> DataFrame:
    """Rows and probes of one bucket meet, each block of the ones with each block of the others."""
    keys = ["table", "bucket"]
    sizes = rows.groupBy(keys).agg(F.count(F.lit(1)).alias("n")).join(probes.groupBy(keys).agg(F.count(F.lit(1)).alias("m")), keys)
    cut = materialize(sizes.select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("row_blocks"), F.ceil(F.col("m") / BLOCK).cast("int").alias("probe_blocks")), "ann-blocks")
    each = lambda df, own, other, mine, theirs: (
        df.join(cut, keys).withColumn(mine, F.pmod(F.xxhash64("id", "vector"), F.col(own))).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - F.lit(1).cast("long")))).select(*keys, "a", "b", "id", "vector")
    )
    where = [*keys, "a", "b"]
    met = each(rows, "row_blocks", "probe_blocks", "a", "b").groupBy(where).cogroup(each(probes, "probe_blocks", "row_blocks", "b", "a").groupBy(where))
    found = met.applyInArrow(_nearest(width, k), "query_id long, query binary, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors found nearest by cosine to each row of queries, ties to smaller ids.

    Rows with the query's own id are no candidates. Vectors that are null, empty, zero, or hold null or
    non-finite components take no part; shorter ones are padded by zeros. Of rows with equal vectors only the
    k + 1 of smallest ids enter the tables, as no others can be among the nearest, so copies make no bucket
    hot. Rows of queries that repeat an id and a vector are one query; an id with several vectors gives a list for each.
    A row that repeats id and vector is one candidate. A query for which the tables yield fewer than k rows is held
    against all rows, in blocks. An empty side gives an empty result; other columns are left aside, whatever their names.
    Scores are computed in double precision from the whole vectors; null ids take no part.
    """
    shape = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), shape.alias("vector")).where(F.col("id").isNotNull() & finite & F.exists("vector", lambda v: v != 0)).distinct()
    rows, asked = materialize(usable(vectors), "ann-rows"), materialize(usable(queries), "ann-queries")
    copies = Window.partitionBy("vector").orderBy("id")
    kept = materialize(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "ann-kept")
    n, longest = kept.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    longest = max(longest or 1, asked.agg(F.max(F.size("vector"))).first()[0] or 1)
    hashing = hashing_for(n, longest, tables)
    schema = "table int, bucket long, id long, vector binary"
    entered = materialize(kept.mapInArrow(_entries(hashing, False), schema), "ann-entries")
    probes = materialize(asked.mapInArrow(_entries(hashing, True), schema), "ann-probes")
    found = materialize(_in_blocks(entered, probes, hashing.width, k), "ann-found")
    drop_tables(probes, rows)
    served = found.groupBy("query_id", "query").agg(F.count(F.lit(1)).alias("got")).where(F.col("got") >= k)
    one = Hashing(hashing.width, (1,), 1)
    alone = asked.mapInArrow(_entries(one, False), schema).select(F.col("id").alias("query_id"), F.unhex(F.md5("vector")).alias("query"), "vector")
    short = materialize(alone.join(served, ["query_id", "query"], "left_anti").select(F.lit(0).alias("table"), F.lit(0).cast("long").alias("bucket"), F.col("query_id").alias("id"), "vector", "query"), "ann-short")
    if not short.isEmpty():
        whole = entered.where("table = 0").withColumn("bucket", F.lit(0).cast("long"))
        rest = materialize(_in_blocks(whole, short.drop("query"), hashing.width, k), "ann-rest")
        found = found.join(short.select(F.col("id").alias("query_id"), "query"), ["query_id", "query"], "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")

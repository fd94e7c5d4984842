"""Bottom-k fingerprints of documents over hashes of five-word shingles.

A fingerprint keeps the k least of a document's distinct 64-bit shingle hashes, so two
fingerprints of one shingle family merge into that of the united texts. From a pair of
fingerprints come estimates of resemblance and containment, from one the number of distinct
shingles. A document of at most k shingles is kept whole, and its estimates are then exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.ranges import range_starts
from tidepanel.llm.texthash import shingle_sets
from tidepanel.session import shuffle_partitions

K = 128
_U = np.uint64
_SPAN = 2.0**64


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """The k least of sorted distinct hashes."""
    return shingles[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the united documents."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPAN / (float(a[k - 1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(least, both, assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty document is contained in every one."""
    if not len(a):
        return 1.0
    united = distinct_count(merge(a, b, k), k)
    return float(min(1.0, resemblance(a, b, k) * united / distinct_count(a, k)))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(_U)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, fingerprint, n_shingles): the fingerprint of each text in base64, and its estimated size.

    Null texts are empty; empty and blank texts have an empty fingerprint. Repeated rows give
    repeated rows, other columns are left aside, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [sketch(s, k) for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(m) for m in marks], pa.string()), pa.array([distinct_count(m, k) for m in marks], pa.float64())], ["id", "fingerprint", "n_shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string, n_shingles double").withColumnRenamed("id", id_col)


def _place(starts: np.ndarray):
    """Adds the range of each row; a row that begins a range is also sent, as a guest, to the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            own = np.searchsorted(starts, ids, side="right") - 1
            begins = np.flatnonzero(starts[own] == ids)
            rows = pa.Table.from_batches([batch]).append_column("range", pa.array(own, pa.int64())).append_column("guest", pa.array(np.zeros(len(ids), bool)))
            yield from rows.to_batches()
            if len(begins):
                guests = rows.take(pa.array(begins)).set_column(2, "range", pa.array((own[begins] - 1) % len(starts), pa.int64())).set_column(3, "guest", pa.array(np.ones(len(begins), bool)))
                yield from guests.to_batches()

    return run


def _pair_fingerprints(k: int):
    """Rows of a range in order, guests last: yields each own row against the next row of the table."""

    def emit(texts: list[str], ids: list[int]) -> pa.RecordBatch:
        """All texts but the last, which only serves as the next one."""
        own = texts[:-1]
        edited = []
        for now, then in zip(own, texts[1:], strict=True):
            cut = len(now) // 4
            edited.append(now[: len(now) - cut] + then[:cut])
        marks = [sketch(s, k) for s in shingle_sets(pa.array(texts, pa.string()))]
        changed = [sketch(s, k) for s in shingle_sets(pa.array(edited, pa.string()))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([encode(m) for m in marks[:-1]], pa.string()),
                pa.array([encode(m) for m in changed], pa.string()),
                pa.array([resemblance(a, b, k) for a, b in zip(marks, changed, strict=False)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(marks, marks[1:], strict=False)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, now, closed, size = [], [], None, False, 0
        for batch in batches:
            for doc, text, at, guest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != now:
                    if len(texts) > 1:
                        yield emit(texts, ids)
                    texts, ids, now, closed, size = [], [], at, False, 0
                if closed:
                    continue
                texts.append(text or "")
                ids.append(doc)
                closed, size = guest, size + len(texts[-1])
                if size > 1 << 22:
                    yield emit(texts, ids)
                    texts, ids, size = texts[-1:], ids[-1:], 0
        if len(texts) > 1:
            yield emit(texts, ids)

    return run


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The edited text has the last floor(n/4) code points replaced by the first as many (or all) of the
    next document in ascending id; the last document's next is the first. Rows that share an id follow
    each other in the order of their texts; a null id comes before all others. Null texts are empty, an
    empty table gives an empty result. Ids are whole numbers: a text that is none ends the job. Texts of any
    length are read whole; other columns are left aside, whatever their names. Rows are dealt by ranges of ids, and the first row of each range also goes
    to the range before, so that neighbours meet without a global sort.
    """
    spark = docs.sparkSession
    null = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), null).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    starts = range_starts(rows.select("doc"), 4 * parts)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not len(starts):
        return spark.createDataFrame([], schema)
    placed = rows.mapInArrow(_place(starts), "doc long, text string, range long, guest boolean")
    dealt = placed.repartition(parts, "range").sortWithinPartitions("range", "guest", "doc", "text")
    return dealt.mapInArrow(_pair_fingerprints(k), schema).withColumn("doc_id", F.nullif("doc_id", null))

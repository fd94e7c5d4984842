"""Product codes of vectors by Lloyd rounds with Elkan's bounds.

Components become integers, vectors are cut into parts, and each part position has a codebook. A row's state
holds for each part an upper bound of the distance to its entry and one lower bound for every entry; both move
by what the entries moved in a round. A distance is computed only where the bounds leave it open, from the integers,
so that ties are decided exactly. The codebooks, parts x entries, are all that passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.session import drop_tables, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: integers beyond this count as this, so that squared distances fit a double and sums of them a long
LARGEST = 1 << 23
#: rows that are worked on at once
ROWS = 512


@dataclass(frozen=True)
class Codebooks:
    """entries: parts x entries x width, integers; moved: how far each entry moved when the last round ended, rounded up."""

    entries: np.ndarray
    moved: np.ndarray

    def half_apart(self) -> np.ndarray:
        """Half the distance of each two entries of a part, rounded down; infinite from an entry to itself."""
        gaps = self.entries[:, :, None, :] - self.entries[:, None, :, :]
        half = _below(np.sqrt((gaps**2).sum(-1)) / 2)
        half[:, np.arange(half.shape[1]), np.arange(half.shape[1])] = np.inf
        return half

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _unpacked(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def first_state(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower) of rows x parts x width from all distances; the lower index wins a tie."""
    squared = ((x[:, :, None, :] - books.entries[None]) ** 2).sum(-1)
    code = squared.argmin(-1)
    lower = np.sqrt(squared)
    return code, _above(np.take_along_axis(lower, code[..., None], -1)[..., 0]), _below(lower)


def next_state(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The state against the moved entries, and how many distances it took.

    An entry is ruled out only where a bound puts it strictly farther than the row's own: one that may
    tie is measured. The own distance is measured before it is compared with any other.
    """
    part = np.arange(x.shape[1])[None, :]
    upper = _above(upper + books.moved[part, code])
    lower = _below(lower - books.moved[None])
    half = books.half_apart()
    own = np.zeros(lower.shape, bool)
    np.put_along_axis(own, code[..., None], True, -1)
    open_ = lambda: ~own & (upper[..., None] >= lower) & (upper[..., None] >= half[part, code])
    r, p = np.nonzero(open_().any(-1))
    exact = ((x[r, p] - books.entries[p, code[r, p]]) ** 2).sum(-1)
    upper[r, p] = _above(np.sqrt(exact))
    lower[r, p, code[r, p]] = _below(np.sqrt(exact))
    left = open_()
    at = np.nonzero(left)
    squared = ((x[at[0], at[1]] - books.entries[at[1], at[2]]) ** 2).sum(-1)
    lower[at] = _below(np.sqrt(squared))
    met = np.full(lower.shape, np.iinfo(np.int64).max)
    met[at] = squared
    met[r, p, code[r, p]] = exact
    code = code.copy()
    code[r, p] = met[r, p].argmin(-1)
    upper[r, p] = _above(np.sqrt(met[r, p, code[r, p]]))
    return code, upper, lower, len(exact) + len(squared)


def _assign(parts: int, books: Codebooks, first: bool):
    """States of rows (id, label, x[, code, upper, lower, measured]) against the codebooks."""
    entries, width = books.entries.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, len(whole), ROWS)):
                x = _unpacked(batch.column(2), "<i4", parts, width).astype(np.int64)
                if first:
                    code, upper, lower = first_state(x, books)
                    measured = x.shape[0] * parts * entries
                else:
                    state = _unpacked(batch.column(3), "u1", parts).astype(np.int64), _unpacked(batch.column(4), "<f4", parts), _unpacked(batch.column(5), "<f4", parts, entries)
                    code, upper, lower, measured = next_state(x, *state, books)
                error = ((x - books.entries[np.arange(parts), code]) ** 2).sum((1, 2))
                share = np.bincount([0], [measured], len(x)).astype(np.int64)  # the batch's count stands in its first row
                columns = [*batch.columns[:3], _packed(code.astype("u1")), _packed(upper.astype("<f4")), _packed(lower.astype("<f4")), pa.array(error), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "x", "code", "upper", "lower", "error", "measured"])

    return run


def _sums(parts: int, entries: int, width: int):
    """A task's sums and counts of the parts that each entry holds, one row for each entry used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _unpacked(batch.column(0), "<i4", parts, width).astype(np.int64)
            at = (_unpacked(batch.column(1), "u1", parts).astype(np.int64) + np.arange(parts) * entries).ravel()
            np.add.at(total, at, x.reshape(-1, width))
            count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        places = np.repeat(used, width), np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*places, total[used].ravel(), np.repeat(count[used], width))], ["entry", "place", "total", "n"])

    return run


def _moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry at the floor of its parts' mean; an unused one stays."""
    parts, entries, width = books.entries.shape
    tasks = state.select("x", "code").mapInArrow(_sums(parts, entries, width), "entry long, place long, total long, n long")
    new = books.entries.reshape(-1, width).copy()
    for r in tasks.groupBy("entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # parts x entries x width rows
        new[r["entry"], r["place"]] = r["total"] // r["n"]
    new = new.reshape(books.entries.shape)
    return Codebooks(new, _above(np.sqrt(((new - books.entries) ** 2).sum(-1))))


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error, measured) of each row, and the codebooks after the rounds.

    Components become floor(scale * x), those beyond 2**23 in size count as 2**23. Each part's codebook starts as that
    part of the rows of the smallest ids (of equal ids the smaller vector first, null ids first of all); with fewer
    rows than `entries` it has that many. Rows whose vector is null, empty or holds null or non-finite components are
    dropped. Shorter vectors are padded by zeros, and all of them to a multiple of `parts`. Repeated rows are rows of their own; equal rows
    share their code. code holds a byte a part, error the squared distance of all parts, measured (in one row of each
    batch, else 0) the distances that the last assignment computed. An empty table gives an empty result and empty codebooks.
    """
    if entries > 256:
        raise ValueError("codes are bytes: at most 256 entries")
    number = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), number.alias("v")).where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    bound = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-2.0 * LARGEST), F.least(F.lit(2.0 * LARGEST), x * scale)))))
    rows = materialize(rows.select("id", "label", F.transform("v", lambda x: bound(x).cast("int")).alias("v")), "codes-rows")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            out = np.zeros((len(lists), parts * width), "<i4")
            out[np.arange(parts * width) < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _packed(out)], ["id", "label", "x"])

    kind = rows.schema["label"].dataType.simpleString()
    start = [r["v"] + [0] * (parts * width - len(r["v"])) for r in rows.orderBy(F.asc_nulls_first("id"), "v").limit(entries).collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, width).swapaxes(0, 1)
    books = Codebooks(books, np.zeros(books.shape[:2], np.float32))
    schema = f"id long, label {kind}, x binary, code binary, upper binary, lower binary, error long, measured long"
    state = materialize(rows.mapInArrow(pack, f"id long, label {kind}, x binary").mapInArrow(_assign(parts, books, True), schema), "codes-state") if start else rows.sparkSession.createDataFrame([], schema)
    for _ in range(rounds if start else 0):
        books = _moved(state, books)
        after = materialize(state.mapInArrow(_assign(parts, books, False), schema), "codes-state")
        drop_tables(state)
        state = after
    return state.select("id", "label", "code", "error", "measured"), books


def coded_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of product_codes(), the code as two hex digits a part.

    label_error sums the errors of all rows with the same label, null labels together. Labels are summed before
    they meet the rows again, and both sides are plain tables, so that a label of very many rows can be split.
    """
    coded, books = product_codes(vectors, id_col, vector_col, label_col)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error")
    joined = coded.join(materialize(sums, "codes-labels"), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))

"""Vectorised word and shingle hashing over the UTF-8 buffers of Arrow batches.

A word is a maximal run of bytes other than space and \\t..\\r; A-Z fold to a-z.
Hashes are 64-bit and depend on the word's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTER = mix(np.arange(1, 257, dtype=_U))
_LETTER[65:91] = _LETTER[97:123]
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(which: str, n: int) -> np.ndarray:
    table = _powers[which]
    if len(table) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), _BASE if which == "up" else _INVERSE, _U)
        steps[0] = 1
        table = _powers[which] = np.multiply.accumulate(steps)
    return table


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def doc_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; a longer document stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def word_hashes(data: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, their byte ranges, and per document the first word's index.

    rel: offsets of the documents in data, from 0 to len(data).
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(_U), none, none, np.zeros(len(rel), np.int64)
    space = _SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[rel[:-1][rel[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[rel[1:][rel[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    sums = np.zeros(n + 1, _U)
    np.cumsum(_LETTER[data] * _power("up", n)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("down", n)[starts])
    return hashes, starts, ends, np.searchsorted(starts, rel)


def shingles_of_words(hashes: np.ndarray, first: np.ndarray, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Distinct shingle hashes of each document, sorted.

    A document of fewer words than `width` has its whole sequence as one shingle; one without words has none.
    """
    weights = np.multiply.accumulate(np.full(width, _STEP, _U))
    total = len(hashes)
    rolled = np.zeros(max(0, total - width + 1), _U)
    for j in range(width):
        rolled += hashes[j : j + len(rolled)] * weights[j]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            short = (hashes[lo:hi] * weights[: hi - lo]).sum(dtype=_U) + _U(hi - lo)
            out.append(mix(np.array([short], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def shingle_sets(column: pa.Array, width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of every text of an Arrow column, in order."""
    raw, offs = text_buffer(column)
    for lo, hi in doc_chunks(offs):
        part = offs[lo : hi + 1] - offs[lo]
        hashes, _, _, first = word_hashes(raw[offs[lo] : offs[hi]], part)
        yield from shingles_of_words(hashes, first, width)

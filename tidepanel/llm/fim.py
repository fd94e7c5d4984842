"""Fill-in-middle transformation of documents on ropes.

A text becomes a rope: a balanced tree whose leaves hold pieces of it and whose nodes cache their numbers
of units (runs of letters, or single other code points) and of code points. Splitting at two unit ranks
gives prefix, middle and suffix as subtrees; the output is a concatenation of subtrees and sentinels, and
the inverse splits the output's rope at the sentinels.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
LETTERS = re.compile(r"[A-Za-z]+")
#: a leaf has this many code points and what is left of its last run of letters, so that no unit spans two leaves
LEAF = 2048
PIECE = re.compile(r"(?s:.{1,%d})[A-Za-z]*" % LEAF)
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: documents in a hundred that stay plain, and of the others those with the suffix first
PLAIN_FROM, SPM_BELOW = 90, 20


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (left is None) or the concatenation of two ropes."""

    units: int
    chars: int
    piece: str = ""
    left: Rope | None = None
    right: Rope | None = None


def leaf(piece: str) -> Rope:
    return Rope(len(LETTERS.sub("a", piece)), len(piece), piece)


EMPTY = leaf("")


def concat(*ropes: Rope) -> Rope:
    """The ropes in their order; those without text fall out."""
    out = EMPTY
    for rope in ropes:
        out = rope if not out.chars else out if not rope.chars else Rope(out.units + rope.units, out.chars + rope.chars, "", out, rope)
    return out


def build(text: str) -> Rope:
    """A balanced rope of the text."""
    level = [leaf(m.group()) for m in PIECE.finditer(text)] or [EMPTY]
    while len(level) > 1:
        level = [concat(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def split(rope: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """What stands before and after a rank, counted in units or in chars; a rank in chars must not lie inside a run of letters."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= getattr(rope, by):
        return rope, EMPTY
    if rope.left is None:
        at = rank if by == "chars" else next(islice(UNIT.finditer(rope.piece), rank - 1, None)).end()
        return leaf(rope.piece[:at]), leaf(rope.piece[at:])
    within = getattr(rope.left, by)
    if rank < within:
        before, after = split(rope.left, rank, by)
        return before, concat(after, rope.right)
    before, after = split(rope.right, rank - within, by)
    return concat(rope.left, before), after


def text_of(rope: Rope) -> str:
    pieces, waiting = [], [rope]
    while waiting:
        node = waiting.pop()
        if node.left is None:
            pieces.append(node.piece)
        else:
            waiting += (node.right, node.left)
    return "".join(pieces)


def rearrange(text: str, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix, of middle, output) of a text under four draws."""
    rope = build(text)
    if not text or any(s in text for s in SENTINELS) or draws[2] % 100 >= PLAIN_FROM:
        return rope.units, "plain", None, None, text
    first, second = sorted(d % (rope.units + 1) for d in draws[:2])
    rest, suffix = split(rope, second)
    prefix, middle = split(rest, first)
    p, s, m = (leaf(x) for x in SENTINELS)
    form = "spm" if draws[3] % 100 < SPM_BELOW else "psm"
    out = concat(s, suffix, p, prefix, m, middle) if form == "spm" else concat(p, prefix, s, suffix, m, middle)
    return rope.units, form, prefix.chars, middle.chars, text_of(out)


def restore(output: str, form: str) -> str:
    """The text that rearrange() made output of."""
    if form == "plain":
        return output
    rope, parts = build(output), {}
    last = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    places = [0]
    for s in last[1:]:  # no part holds a sentinel, so the first found is the one set
        places.append(output.index(s, places[-1]))
    for s, at in zip(reversed(last), reversed(places), strict=True):
        rope, tail = split(rope, at, "chars")
        parts[s] = split(tail, len(s), "chars")[1]
    return text_of(concat(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]))


def draws(doc: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four 32-bit draws from the hash of seed and id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row of docs: its text rearranged for filling in the middle.

    Null texts are empty, empty ones plain. The draws depend on the id alone, so that rows which share an id
    share their draws, and repeated rows give repeated rows; null ids draw as an empty id. Ids are whole numbers. A
    text of any length is a rope of small leaves; only a run of letters is never cut. Other columns are left aside,
    whatever their names; an empty table gives an empty result.
    """
    schema = f"`{id_col}` long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [rearrange(t, draws(d, seed)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def restore_texts(moved: DataFrame) -> DataFrame:
    """moved with `restored`, the text rebuilt from its columns output and form alone."""
    kept = [c for c in moved.columns if c != "restored"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moved.select(*kept).schema) + ", restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("output", "form"))
            yield batch.append_column("restored", pa.array([restore(o, f) for o, f in zip(outputs, forms, strict=True)], pa.string()))

    return moved.select(*kept).mapInArrow(run, schema)

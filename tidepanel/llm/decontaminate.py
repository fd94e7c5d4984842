"""Benchmark decontamination: rare n-gram seeds join passages to items, then Smith-Waterman alignment.

1. Items become rows of n-grams. A sieve of fixed size, all that is broadcast, tells the documents'
   n-grams that may be of an item; those become rows as well.
2. An n-gram that more than SHARED item texts hold is a phrase of the benchmark and gives way to the
   LONG times longer gram from the same place (moved to the left where the item ends before); items
   with fewer words keep it. Document frequencies are counted over the whole corpus. Of every STRIDE
   consecutive grams of an item the rarest that occurs becomes a seed, so an item has seeds along its
   whole length and no seed is dropped for being frequent in the corpus.
3. Seeds join the documents' n-grams to items. Each document cuts the passages around its hits; they
   join the items' words and are aligned by Smith-Waterman over words (match 2, mismatch -1, gap -1).
   The score is the alignment's part of a perfect one, 1 for an exact copy. A passage with fewer of the
   item's words than the least score needs is not aligned.

Documents are read twice whatever the benchmark's size, and their texts are not moved unless they
hold a hit. A passage that shares no seed with an item is not aligned with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.texthash import _STEP, doc_chunks, mix, text_buffer, word_hashes
from tidepanel.session import drop_tables, materialize, ship_package

SEED_WORDS, STRIDE, LEAST_SCORE = 3, 2, 0.5
#: a gram that more item texts hold than SHARED is replaced by one of LONG times as many words
SHARED, LONG = 8, 3
#: bits of the sieve, as a power of two: 4 MB whatever the benchmark
SIEVE_BITS = 25
MATCH, MISMATCH, GAP = 2, -1, -1
_U = np.uint64


def item_words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of a word sequence."""
    out = np.zeros(max(0, len(words) - n + 1), _U)
    for j in range(n):
        out = out * _STEP + words[j : j + len(out)]
    return mix(out)


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first, end): the best local alignment of item in passage, as a range of passage words."""
    m = len(passage)
    at = np.arange(m + 1)
    score, start = np.zeros(m + 1, np.int64), at.copy()
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        own = np.r_[0, np.maximum(np.maximum(diagonal, up), 0)]
        came = np.r_[0, np.where(own[1:] == 0, at[1:], np.where(diagonal >= up, start[:-1], start[1:]))]
        #: gaps along the passage: the largest of the cells to the left, less their distance
        lifted = own - GAP * at
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, at, 0))
        score = top + GAP * at
        start = np.where(score > own, came[source], came)
        peak = int(score.argmax())
        if score[peak] > best[0]:
            best = (int(score[peak]), int(start[peak]), peak)
    return best


def _item_grams(n: int):
    """(key, text) to the grams of n and LONG * n words at each place of an item; one of fewer than n words is a single gram of all it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = item_words(text)
                width, long = min(n, len(words)), LONG * n
                found = grams(words, width).view(np.int64) if width else np.zeros(0, np.int64)
                m = len(found)
                longer, begin = np.zeros(m, np.int64), np.full(m, -1)
                if len(words) >= long:
                    begin = np.minimum(np.arange(m), len(words) - long)
                    longer = grams(words, long).view(np.int64)[begin]
                columns = [np.full(m, key), found, np.arange(m), np.full(m, width), longer, begin, np.full(m, len(words))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "gram", "at", "width", "longer", "begin", "size"])

    return run


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offs = text_buffer(batch.column(1))
    for lo, hi in doc_chunks(offs):
        words, _, _, first = word_hashes(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        yield lo, hi, words, first


def _sieve(items: DataFrame) -> np.ndarray:
    """A bit for each value of the first SIEVE_BITS bits of a gram's hash, set for the items' grams."""
    word, bit = F.shiftrightunsigned("gram", 64 - SIEVE_BITS + 6), F.shiftrightunsigned("gram", 64 - SIEVE_BITS).bitwiseAND(F.lit(63)).cast("int")
    packed = items.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    out = np.zeros(1 << (SIEVE_BITS - 6), _U)
    rows = packed.toArrow()  # 2**(SIEVE_BITS - 6) rows at most
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(_U)
    return out


def _hits(sieve, widths: list[int]):
    """(text's hash, text) to the places of grams that pass the sieve; `fresh` marks a gram's first in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, words, first in _chunks(batch):
                for width in widths:
                    rolled = grams(words, width)
                    slot = rolled >> _U(64 - SIEVE_BITS)
                    at = np.flatnonzero((bits[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1))
                    owner = np.searchsorted(first, at, side="right") - 1
                    inside = at + width <= first[owner + 1]
                    at, owner = at[inside], owner[inside]
                    found = rolled[at].view(np.int64)
                    order = np.lexsort((at, found, owner))
                    at, owner, found = at[order], owner[order], found[order]
                    fresh = np.ones(len(at), bool)
                    fresh[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo + owner]), pa.array(found), pa.array(at - first[owner]), pa.array(fresh)], ["text_hash", "gram", "place", "fresh"])

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, wanted (key, size, begins)) to the passages around the places where an item may begin."""
    for batch in batches:
        rows, weight = [], 0
        for row, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            words = item_words(text.as_py())
            for want in wanted.as_py():
                size, slack = want["size"], want["size"] // 2 + 4
                begins = np.unique(np.array(want["begins"], np.int64))
                #: places whose stretches meet share a passage
                cut = np.flatnonzero(np.r_[True, np.diff(begins) > size + 2 * slack])
                for a, b in zip(begins[cut].tolist(), begins[np.r_[cut[1:], len(begins)] - 1].tolist(), strict=True):
                    lo, hi = max(0, a - slack), min(len(words), b + size + slack)
                    rows.append((row, want["key"], lo, words[lo:hi].tobytes()))
                    weight += 8 * (hi - lo)
                if weight > 1 << 21:
                    yield _batch(rows, ["row", "key", "begin", "words"], (pa.int64(), pa.int64(), pa.int64(), pa.binary()))
                    rows, weight = [], 0
        yield _batch(rows, ["row", "key", "begin", "words"], (pa.int64(), pa.int64(), pa.int64(), pa.binary()))


def _batch(rows: list[tuple], names: list[str], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _align(least: float):
    """(row, key, begin, words, item's text) to the best alignment of each passage that scores `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, key, begin, words, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                item, passage = item_words(text), np.frombuffer(words, _U)
                #: a score is MATCH times the matched words at most
                if np.isin(item, passage).sum() < least * len(item):
                    continue
                score, first, end = smith_waterman(item, passage)
                if score >= least * MATCH * len(item):
                    out.append((row, key, score / (MATCH * len(item)), begin + first, begin + end))
            yield _batch(out, ["row", "key", "score", "first_word", "end_word"], (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))

    return run


def _seed_grams(texts: DataFrame, n: int) -> DataFrame:
    """(key, at, gram, width, size): the grams that may seed an item, one or none from each of its places."""
    of_items = materialize(texts.select("key", "text").mapInArrow(_item_grams(n), "key long, gram long, at long, width long, longer long, begin long, size long"), "leak-places")
    held = of_items.groupBy("gram").agg(F.countDistinct("key").alias("held"))
    phrase = (F.col("held") > SHARED) & (F.col("begin") >= 0)
    kept = of_items.join(held, "gram").select(
        "key", "size",
        F.when(phrase, F.col("begin")).otherwise(F.col("at")).alias("at"),
        F.when(phrase, F.col("longer")).otherwise(F.col("gram")).alias("gram"),
        F.when(phrase, F.lit(LONG * n)).otherwise(F.col("width")).alias("width"),
    )
    out = materialize(kept.distinct(), "leak-grams")
    drop_tables(of_items)
    return out


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, n: int = SEED_WORDS, stride: int = STRIDE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, score, first_word, end_word): the passages of docs that copy a benchmark item.

    A row for each document and item whose best alignment scores `least` or more, with the range of
    words it covers; of equal ones the first, then the longer. Null and blank texts and items match
    nothing; texts of any length are searched whole; repeated documents give repeated rows, an exact
    repeat of an item counts once; ids keep their types and may be null; other columns are left aside;
    an empty table on either side gives an empty result. All texts of an item's id are searched, and
    the row is that of the best; each text with a null id is an item of its own, with a row of its own.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    named = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    #: one key a text, whatever the number of its ids
    texts = materialize(named.select("text").distinct().withColumn("key", F.monotonically_increasing_id()), "leak-items")
    items = materialize(named.join(texts, "text").select("key", "item"), "leak-ids")
    asked, passages = _candidates(rows, texts, n, stride)
    aligned = passages.join(texts, "key").select("row", "key", "begin", "words", "text").mapInArrow(_align(least), "row long, key long, score double, first_word long, end_word long")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("low"), "end_word")).alias("best")
    each = aligned.join(items, "key").groupBy("row", "item", F.when(F.col("item").isNull(), F.col("key")).alias("own")).agg(best)
    out = materialize(each.join(asked.select("row", "doc"), "row").select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), F.col("best.score").alias("score"), (-F.col("best.low")).alias("first_word"), F.col("best.end_word").alias("end_word")), "leaks")
    drop_tables(texts, items, asked, passages)
    return out


def _candidates(rows: DataFrame, texts: DataFrame, n: int, stride: int) -> tuple[DataFrame, DataFrame]:
    """Written tables (doc, text, wanted, row) of the rows with hits and (row, key, begin, words) of the passages to align."""
    spark = rows.sparkSession
    of_items = _seed_grams(texts, n)
    widths = sorted(r["width"] for r in of_items.select("width").distinct().collect())  # n + 1 values at most
    sieve = spark.sparkContext.broadcast(_sieve(of_items.select("gram").distinct()))
    hits = materialize(rows.select("text_hash", "text").mapInArrow(_hits(sieve, widths), "text_hash long, gram long, place long, fresh boolean"), "leak-hits")

    frequency = hits.where("fresh").groupBy("gram").agg(F.count(F.lit(1)).alias("docs"))
    known = of_items.join(frequency, "gram", "left")
    order = Window.partitionBy("key").orderBy("at", "gram")
    rarest = F.min(F.when(F.col("docs").isNotNull(), F.struct("docs", "at", "gram"))).over(order.rowsBetween(0, stride - 1))
    numbered = known.select("key", "size", F.row_number().over(order).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy("key")).alias("n"), rarest.alias("best"))
    chosen = numbered.where((F.col("nth") <= F.greatest(F.lit(1), F.col("n") - stride + 1)) & F.col("best").isNotNull())
    seeds = materialize(chosen.select("key", "size", F.col("best.at").alias("at"), F.col("best.gram").alias("gram")).distinct(), "leak-seeds")

    near = hits.join(seeds, "gram").groupBy("text_hash", "key", "size").agg(F.collect_set(F.col("place") - F.col("at")).alias("begins"))
    wanted = materialize(near.groupBy("text_hash").agg(F.collect_list(F.struct("key", "size", "begins")).alias("wanted")), "leak-wanted")
    #: numbered where they are written, so that repeated documents stay apart
    asked = materialize(rows.join(wanted, "text_hash").select("doc", "text", "wanted").withColumn("row", F.monotonically_increasing_id()), "leak-docs")
    passages = materialize(asked.select("row", "text", "wanted").mapInArrow(_passages, "row long, key long, begin long, words binary"), "leak-passages")
    drop_tables(of_items, hits, seeds, wanted)
    sieve.unpersist()
    return asked, passages


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that hold a benchmark passage; columns and clean rows stay as they are.

    Rows are judged by their texts alone, so repeated and null ids hide no leak and take no clean row
    with them; rows with a null text are kept.
    """
    digest = F.sha2(F.col(text_col).cast("string"), 256)
    leaks = benchmark_leaks(docs.select(digest.alias("digest"), text_col), benchmark, id_col="digest", text_col=text_col, **options)
    return docs.join(leaks.select(F.col("digest").alias("__leaked")).distinct(), digest == F.col("__leaked"), "left_anti")

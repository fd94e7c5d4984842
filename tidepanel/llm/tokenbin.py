"""Token ids as flat unsigned integer files with 64-bit document offsets.

A range of ascending ids becomes three files: `.bin` holds the token ids as little-endian
unsigned integers (16 bit if the vocabulary allows, else 32), `.offsets` a 64-bit offset for
each document and one for the end, counted in tokens from the start of the file, and `.docs`
the 64-bit document ids. The manifest, a Parquet table, lists the files of each range; prefix
sums over its token counts give every range the base that makes offsets global. Readers map
the files into memory.

Files are written under a name of the task attempt and listed once complete, so that a lost or
doubled task leaves files that no manifest names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidepanel.llm.ranges import range_starts
from tidepanel.session import materialize, shared_path, shuffle_partitions

NULL_ID = -(1 << 63)
WORDS_KEPT = 1_500_000
_BETWEEN = "<|startoftext|>"


class WordEncoder:
    """Encodes texts by the library, each distinct word once.

    A tokenizer that drops white space and never joins what it separates, like word_bpe_49k, encodes
    a text to the joined encodings of its ASCII-space separated pieces. Pieces are encoded in batches,
    and their ids kept as bytes; the cache is emptied when it holds WORDS_KEPT pieces. Any other tokenizer,
    told by its encodings of SPACED, gets the texts whole.
    """

    #: texts of words in all kinds of ASCII space, single, repeated and at the ends
    SPACED = ("two words  here", " at\tboth\n\nends ", "a \x0b b\x0cc\rd", "It's 12 o'clock, (x) y.", "\u00e9t\u00e9 \u4e2d\u6587 caf\u00e9")

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.known = Tokenizer.from_file(path), dtype, {}
        self.between = self.tokenizer.token_to_id(_BETWEEN)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.splits = all(ids(t) == [i for w in t.encode().split() for i in ids(w.decode())] for t in self.SPACED)

    def learn(self, words: list[bytes]) -> None:
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        plain = [w for w in words if b"<|" not in w]
        if self.between is None:
            plain = []
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.tokenizer.encode(_BETWEEN.join(w.decode() for w in some), add_special_tokens=False).ids, np.int64)
            cuts = np.flatnonzero(ids == self.between)
            if len(cuts) != len(some) - 1:
                plain = plain[:at]
                break
            flat, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
            starts, ends = np.r_[0, cuts + 1] * width, np.r_[cuts, len(ids)] * width
            self.known.update((w, flat[s:e]) for w, s, e in zip(some, starts.tolist(), ends.tolist(), strict=True))
        rest = [w for w in words if w not in self.known]
        for w, found in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False) if rest else [], strict=True):
            self.known[w] = np.array(found.ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        pieces = [t.encode().split() for t in texts]
        new = set().union(*pieces).difference(self.known) if pieces else set()
        if new:
            before = len(self.known)
            self.learn(list(new))
            if len(self.known) < before:
                self.learn(list(set().union(*pieces).difference(self.known)))
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]


_encoders: dict[tuple, WordEncoder] = {}


def _encoder(path: str, dtype: str) -> WordEncoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = WordEncoder(path, dtype)
    return _encoders[path, dtype]


def _writer(folder: str, tokenizer: str, dtype: str, end_id: int, starts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encoder, end, width = _encoder(tokenizer, dtype), np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        attempt = TaskContext.get().taskAttemptId()
        now, sinks, lengths, docs, rows = None, None, [], [], []

        def close() -> None:
            total = np.r_[0, np.cumsum(np.array(lengths, np.int64))]
            sinks.close()
            for kind, values in (("offsets", total), ("docs", np.array(docs, np.int64))):
                with store.open_output_stream(f"{root}/range-{now:08d}-{attempt}.{kind}") as out:
                    out.write(values.astype("<i8").tobytes())
            rows.append((now, f"range-{now:08d}-{attempt}", len(docs), int(total[-1])))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                for place, doc, code in zip(part.column(2).to_pylist(), part.column(0).to_pylist(), codes, strict=True):
                    if place != now:
                        if sinks is not None:
                            close()
                        now, lengths, docs = place, [], []
                        sinks = store.open_output_stream(f"{root}/range-{now:08d}-{attempt}.bin")
                    sinks.write(code + end)
                    lengths.append(len(code) // width + 1)
                    docs.append(doc)
        if sinks is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["range", "name", "n_docs", "n_tokens"])

    return run


def _place(starts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(starts, batch.column(0).to_numpy(zero_copy_only=False), side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64())], ["doc", "text", "range"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs in ascending id into files under folder; returns the manifest.

    Rows that share an id follow each other in the order of their texts; a null id, stored as the
    least 64-bit integer, comes first; null texts are empty and hold the end id alone. Ids are whole
    numbers: a text that is none ends the job. Texts of any length are encoded whole; other columns are
    left aside, whatever their names. An empty table gives an empty manifest. Manifest: (range, name, n_docs, n_tokens, base, dtype, folder).
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    starts = range_starts(rows.select("doc"), 4 * parts)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    dealt = rows.mapInArrow(_place(starts), "doc long, text string, range long").repartition(parts, "range").sortWithinPartitions("range", "doc", "text")
    written = materialize(dealt.mapInArrow(_writer(folder, tokenizer, dtype, end_id, starts), "range long, name string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    return written.withColumns({"base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")), "dtype": F.lit(dtype), "folder": F.lit(folder)})


def _mapped(store: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """The numbers of a file, mapped into memory where the store is a local or mounted one."""
    if store.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, base, dtype, folder in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            store, root = pafs.FileSystem.from_uri(folder)
            ids, offsets, docs = (_mapped(store, f"{root}/{name}.{kind}", t) for kind, t in (("bin", dtype), ("offsets", "<i8"), ("docs", "<i8")))
            for lo in range(0, len(docs), 4096):
                hi = min(len(docs), lo + 4096)
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi]), pa.array(offsets[lo:hi] + base), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(sums, pa.int64())], ["doc", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files that the manifest names."""
    parts = shuffle_partitions(manifest.sparkSession)
    rows = manifest.select("name", "base", "dtype", "folder").repartition(parts, "name").mapInArrow(_reader, "doc long, start long, n_tokens long, ids_crc32 long")
    return rows.select(F.nullif("doc", F.lit(NULL_ID)).alias(id_col), "start", "n_tokens", "ids_crc32")


def tokenize_to_files(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of docs, by default to a new shared folder, and read their digest back."""
    spark: SparkSession = docs.sparkSession
    folder = folder or shared_path(spark, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id, vocabulary, id_col, text_col), id_col)

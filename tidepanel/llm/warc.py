"""Web archives: legacy ARC files to equivalent WARC files, and readers for both.

ARC files open with a version block; its first number tells which header line every record has:

    1: URL IP-address Archive-date Content-type Archive-length
    2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The converter reads the declared lengths and synthesises for each record a WARC identifier,
timestamp, type and payload digest. Types and URLs may hold spaces; records that don't parse become
rejects with a reason, and the conversion goes on. Records of equal payload become one response and
revisits of it. Archives are written by Spark's text writer, so that a file appears whole or not at
all, with gzip. Files are cut by records, as many as their size class allows, so that a file holds
CLASSES' bytes at most or a single record; they are read as whole files by task.

A page's id travels as the fragment `#page-<id>` of an ARC record's URL, and in WARC records as
the header WARC-Page-Id; the full payload's length as WARC-Payload-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.session import materialize, shared_path

#: (bytes of a payload below which a record is in the class, records in a file); 64 MB a file, or one record
CLASSES = ((64 << 10, 1000), (4 << 20, 16), (None, 1))
#: fast gzip; a level of the writer's codec
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
ARC_DATE = "20200101000000"
_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_HEADER = {
    1: re.compile(r"(?P<url>.+?) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<kind>.*) (?P<length>\d+)"),
    2: re.compile(r"(?P<url>.+?) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<kind>.*) \S+ \S+ \S+ \S+ \S+ (?P<length>\d+)"),
}
_PAGE = re.compile(r"#page-(-?\d*)$")
_NAMESPACE = uuid.UUID("7d0f5c58-7f3e-5d0b-9c7e-2f7a1b0c4d11")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- legacy archives


def arc_version_block(version: int) -> str:
    about = f"{version} 0 tidepanel\n{_FIELDS[version]}\n"
    if version == 1:
        return f"filedesc://pages.arc 0.0.0.0 {ARC_DATE} text/plain {len(about)}\n{about}"
    return f"filedesc://pages.arc 0.0.0.0 {ARC_DATE} text/plain 200 - - 0 pages.arc {len(about)}\n{about}"


def arc_record(version: int, url: str, page: int | None, payload: str) -> str:
    target = f"{quote(url, safe=':/?#[]@!$&()*+,;=%~')}#page-{'' if page is None else page}"
    length = len(payload.encode())
    if version == 1:
        return f"{target} 0.0.0.0 {ARC_DATE} text/html {length}\n{payload}"
    return f"{target} 0.0.0.0 {ARC_DATE} text/html 200 - - 0 pages.arc {length}\n{payload}"


def _arc_lines(per_file: int):
    """A row for each record; every per_file-th also carries the version block that opens a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for page, url, html in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in range(3)), strict=True):
                    version = 1 + count // per_file % 2
                    opening = arc_version_block(version) + "\n" if count % per_file == 0 else ""
                    rows.append(opening + arc_record(version, url or "about:blank", page, html or ""))
                    count += 1
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    return run


def _classes(rows: DataFrame, size: Column, known: DataFrame | None = None) -> Iterator[tuple[DataFrame, int]]:
    """The rows of each size class that has some, and how many records a file of them holds. known: a table with the sizes, cheaper to read."""
    low, tests = 0, []
    for high, per_file in CLASSES:
        tests.append(((size >= low) if high is None else (size >= low) & (size < high), per_file))
        low = high
    there = (known or rows).agg(*[F.coalesce(F.bool_or(test), F.lit(False)).alias(str(k)) for k, (test, _) in enumerate(tests)]).first()
    for k, (test, per_file) in enumerate(tests):
        if there[k] or k == 0:  # an empty table still has a folder
            yield rows.where(test), per_file


def write_arc(pages: DataFrame, folder: str) -> None:
    """Legacy archives of (page, url, html), files of version 1 and 2 in turn."""
    for rows, per_file in _classes(pages, F.coalesce(F.octet_length("html"), F.lit(0))):
        lines = rows.mapInArrow(_arc_lines(per_file), "value string")
        lines.write.mode("append").option("maxRecordsPerFile", per_file).options(**GZIP).text(folder)


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """(offset, header, payload, None) of each record of an ARC file, the version block left out.

    What can't be read gives (offset, {}, the bytes, reason): a header of another form skips the record if its
    last field is a length, else the rest of the file, as does a record that is cut off.
    """
    at, version = 0, None
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        header = data[at:end].decode("utf-8", "replace").strip()
        length = header.rsplit(" ", 1)[-1]
        if not (length.isascii() and length.isdigit()):
            yield at, {}, data[at:], "a header without length"
            return
        payload = data[end + 1 : end + 1 + int(length)]
        if len(payload) < int(length):
            yield at, {}, data[at:], f"a record declares {length} bytes, and {len(payload)} follow"
            return
        if version is None:
            number = payload.split(b" ", 1)[0]
            if not header.startswith("filedesc://") or number not in (b"1", b"2"):
                yield at, {}, data[at:], "no version block of a known version"
                return
            version = int(number)
        else:
            fields = _HEADER[version].fullmatch(header)
            yield (at, fields.groupdict(), payload, None) if fields else (at, {}, data[at : end + 1 + int(length)], f"not an ARC {version} header")
        at = end + 1 + int(length)


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "uri", "ip", "date", "content_type", "record_id", "digest", "n_bytes", "payload", "reject"]
    types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], names)

    def fields(file: str, at: int, header: dict[str, str], payload: bytes, reason: str | None) -> tuple:
        record = uuid.uuid5(_NAMESPACE, f"{file} {at}").urn  # a file's name and a place in it are told apart from all others
        if reason is None:
            try:
                when = datetime.strptime(header["date"].ljust(14, "0") if len(header["date"]) > 8 else header["date"] + "000000", "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
            except ValueError:
                reason = f"no date: {header['date']}"
        if reason is not None:
            return None, None, None, None, None, record, payload_digest(payload), len(payload), payload, reason
        page = _PAGE.search(header["url"])
        uri = header["url"][: page.start()] if page else header["url"]
        return int(page[1]) if page and page[1] else None, uri, header["ip"], when, header["kind"], record, payload_digest(payload), len(payload), payload, None

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, rows, weight = content.as_py(), [], 0
            for found in parse_arc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                rows.append(fields(path.rsplit("/", 1)[-1], *found))
                weight += len(found[2])
                if weight > 1 << 22:
                    yield packed(rows)
                    rows, weight = [], 0
            if rows:
                yield packed(rows)


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all ARC files of a folder, with what their WARC equivalents need.

    Bytes that are no record have a reason in `reject` and nulls for the header's fields.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_arc_rows, "page_id long, uri string, ip string, date string, content_type string, record_id string, digest string, n_bytes long, payload binary, reject string")


# ---------------------------------------------------------------- WARC


def revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record_id, refers_to, refers_to_id) of the records whose payload an earlier page has.

    Of records with equal payloads of least_bytes or more, those of the smallest page id are responses.
    Records without a page id stay responses.
    """
    sized = records.where((F.col("n_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("record_id", "page_id", "digest", "n_bytes")
    first = sized.groupBy("digest", "n_bytes").agg(F.min(F.struct("page_id", "record_id")).alias("first"), F.count(F.lit(1)).alias("records")).where("records > 1")
    first = materialize(first, "warc-first")  # both sides of the join as they lie, so that a common payload can be split
    return sized.join(first, ["digest", "n_bytes"]).where("page_id > first.page_id").select("record_id", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_to_id"))


def warc_text(records: DataFrame) -> DataFrame:
    """(value): each record's header and block, as the text writer takes it."""
    again = F.col("refers_to_id").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Payload-Length", F.col("n_bytes").cast("string")),
        line("WARC-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to_id", F.lit(">"))), line("WARC-Refers-To-Page-Id", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return records.select(F.concat(header, F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))).alias("value"))


def write_warc(records: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """WARC files of the records of read_arc(), equal payloads once as response, else as revisit; rejects are left out."""
    good = records.where("reject is null")
    known = materialize(good.select("record_id", "page_id", "digest", "n_bytes"), "warc-records")
    again = materialize(revisits(known, least_bytes), "warc-revisits")
    typed = good.join(again.hint("shuffle_hash"), "record_id", "left")
    for rows, per_file in _classes(typed, F.col("n_bytes"), known):
        warc_text(rows).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).options(**GZIP).text(folder)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:100]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"a WARC record declares {length} bytes and ends elsewhere")
        yield headers, block
        at = end + 8 + length


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            data, rows = content.as_py(), []
            for headers, block in parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response" and (payload_digest(block) != digest or len(block) != int(headers["warc-payload-length"])):
                    raise ValueError(f"the payload of {headers['warc-record-id']} isn't the one that was written")
                page, refers = headers["warc-page-id"], headers.get("warc-refers-to-page-id")
                rows.append((int(page) if page else None, int(headers["warc-payload-length"]), digest, headers["warc-type"], int(refers) if refers else None, headers["warc-record-id"].strip("<>"), headers["warc-target-uri"], headers["warc-date"]))
            if rows:
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "date"]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], names)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of all WARC files of a folder; responses are checked against their digest."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(_warc_rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to legacy archives, those to WARC, and the WARC files' records.

    Null html is an empty payload, a null url becomes about:blank, a null page id stays null and its
    record a response. Payloads may be as long as a row of Spark may be. Rows that share the smallest page id of equal payloads are all responses. Other
    columns are left aside; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    legacy, folder = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(rows, legacy)
    write_warc(read_arc(spark, legacy), folder, least_bytes)
    return read_warc(spark, folder).withColumnRenamed("page_id", id_col)

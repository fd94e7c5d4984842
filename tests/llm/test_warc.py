from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from tidepanel.llm import warc
from tidepanel.session import shared_path

PAGES = [
    (5, "http://a.example/x y", "<p>one é</p>\r\n\r\nWARC/1.1\r\n"),
    (3, "http://b.example/#frag", "<p>one é</p>\r\n\r\nWARC/1.1\r\n"),
    (9, None, "<p>one é</p>\r\n\r\nWARC/1.1\r\n"),
    (7, "http://c.example", None),
    (8, "http://d.example", ""),
    (4, "http://e.example", "x" * 5000 + "\n"),
    (None, "http://f.example", "no id"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("per_file", [1000, 2])
def test_round_trip(spark, monkeypatch, per_file):
    monkeypatch.setattr(warc, "CLASSES", ((1000, per_file), (None, 1)))
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(2)
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == len(PAGES)
    for page, _, html in PAGES:
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((html or "").encode()), digest(html))
    kinds = {p: (r["record_type"], r["refers_to"]) for p, r in got.items()}
    assert kinds == {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 7: ("response", None), 8: ("revisit", 7), 4: ("response", None), None: ("response", None)}
    large = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(pages, least_bytes=100).collect()}
    assert set(large.values()) == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_repeated_rows_and_a_large_page(spark):
    large = "é" * 3_000_000
    pages = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (3, "w", large), (4, "w", large + "!")], "page_id long, url string, html string")
    got = warc.archive_round_trip(pages).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "response"), (1, "response"), (2, "revisit"), (3, "response"), (4, "response")]
    assert len({r["record_id"] for r in got}) == 5
    assert {r["page_id"]: r["payload_bytes"] for r in got if r["page_id"] > 2} == {3: 6_000_000, 4: 6_000_001}


def test_both_arc_versions_and_damage(spark):
    for version in (1, 2):
        data = (warc.arc_version_block(version) + "\n" + warc.arc_record(version, "http://a/", 4, "body é\nmore") + "\n").encode()
        assert [(h["url"], p.decode(), why) for _, h, p, why in warc.parse_arc(data)] == [("http://a/#page-4", "body é\nmore", None)]
        spaced = data.replace(b"text/html", b"text/html; charset=utf-8").replace(b"http://a/#", b"http://a/b c#")
        (_, header, _, why), = warc.parse_arc(spaced)
        assert (header["url"], header["kind"], why) == ("http://a/b c#page-4", "text/html; charset=utf-8", None)
        assert [why for *_, why in warc.parse_arc(data[:-4])] != [None]
        odd = data + b"http://odd/ no-date 4\nbody\n" + warc.arc_record(version, "http://b/", 5, "next").encode()
        assert [why is None for *_, why in warc.parse_arc(odd)] == [True, False, True]
    assert [why for *_, why in warc.parse_arc(b"http://a/ 0.0.0.0 20200101000000 text/html 4\nbody\n")] == ["no version block of a known version"]
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nbody\r\n\r\n"))
    folder = shared_path(spark, "own-arc").removeprefix("file://")
    import os

    os.makedirs(folder)
    with gzip.open(f"{folder}/old.arc.gz", "wb") as f:
        f.write((warc.arc_version_block(1) + "\nhttp://old/ 1.2.3.4 19990203040506 text/plain 3\nabc\nhttp://bad/ 1.2.3.4 19991503040506 text/plain 3\nxyz\nrubbish\n").encode())
    rows = {r["n_bytes"]: r for r in warc.read_arc(spark, f"file://{folder}").where("reject is null").collect()}
    assert (rows[3]["uri"], rows[3]["date"], rows[3]["page_id"], rows[3]["ip"]) == ("http://old/", "1999-02-03T04:05:06Z", None, "1.2.3.4")
    reasons = sorted(r["reject"] for r in warc.read_arc(spark, f"file://{folder}").where("reject is not null").collect())
    assert reasons == ["a header without length", "no date: 19991503040506"]
    out = shared_path(spark, "own-warc")
    warc.write_warc(warc.read_arc(spark, f"file://{folder}"), out)
    assert [r["target_uri"] for r in warc.read_warc(spark, out).collect()] == ["http://old/"]

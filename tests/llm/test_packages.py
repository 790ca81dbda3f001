"""Packages against the standard library's reader, records against the rows they were written for."""

import gzip
import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.llm.packages import (
    DATA,
    INDEX,
    PackageWriter,
    _opened,
    archived,
    index_entries,
    locate_records,
    members,
    parse,
    place_of,
    read_packages,
    record,
    with_revisits,
    write_packages,
)

SCHEMA = "page_id long, url string, html string, id string, payload string, bytes string, digest string"
EXTRA = ("x",) * 4
LONG, WIDE = "a" * 999, "é" * 500
ROWS = [
    (1, "http://a/", "small", *EXTRA),
    (2, "http://b/", "small", *EXTRA),
    (3, None, None, *EXTRA),
    (4, "", "", *EXTRA),
    (5, "http://c/\r\nX: y", LONG, *EXTRA),  # one byte short
    (6, "http://d/", LONG, *EXTRA),
    (7, "http://e/ü", WIDE, *EXTRA),  # just long enough in bytes
    (8, "http://f/", WIDE, *EXTRA),
    (8, "http://f/", WIDE, *EXTRA),  # a repeated row of the largest
    (-2, "http://g/", WIDE, *EXTRA),
    (None, "http://h/", WIDE, *EXTRA),
    (None, "http://i/", "n" * 2_000, *EXTRA),
    (None, "http://j/", "n" * 2_000, *EXTRA),
    (9, "http://k/", "\r\n\r\nWARC/1.1\r\n" * 100_000, *EXTRA),
]


def plain(rows):
    """(id, url, bytes, digest, type, refers_to)."""
    out = []
    for name, url, html, *_ in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == body and r[0] is not None]
        first = max(same, default=None)
        revisit = len(body) >= 1000 and first is not None and name != first
        kind, to = ("revisit", first) if revisit else ("response", None)
        address = url and url.replace("\r", "%0D").replace("\n", "%0A")
        out.append((name, address, len(body), hashlib.sha1(body).hexdigest(), kind, to))
    return sorted(out, key=repr)


def test_records_come_back(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for folder in (None, f"file://{tmp_path}/some", f"{tmp_path}/other"):
        found = archived(pages, folder=folder).collect()
        mine = [
            (r["id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found
        ]
        assert sorted(mine, key=repr) == plain(ROWS)
        assert all(r["intact"] for r in found)


def test_payloads_and_runs_of_any_size(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    packages = write_packages(with_revisits(pages), f"file://{tmp_path}", most=2_000)
    assert packages.count() > 2
    assert sum(r["records"] for r in packages.collect()) == len(ROWS)
    for most in (1, 300, 1 << 20):
        runs = locate_records(packages, most).collect()
        assert sum(len(r["places"]) for r in runs) == len(ROWS)
        found = read_packages(packages, most=most).where("record_type = 'response'").collect()
        stored = sorted(bytes(r["payload"]).decode() for r in found)
        wanted = [(r[2] or "") for r in ROWS if (r[0], r[2]) not in {(7, WIDE), (-2, WIDE), (None, WIDE)}]
        assert stored == sorted(wanted)


def test_package_is_a_zip_of_gzip_members(tmp_path):
    writer = PackageWriter(f"file://{tmp_path}/x.wacz", 6)
    for i in range(3):
        writer.add(str(i), f"http://{i}/", b"p" * 10 * i, hashlib.sha1(b"p" * 10 * i).hexdigest(), "0" if i == 2 else None)
    address, size, count = writer.close()
    assert size == os.path.getsize(tmp_path / "x.wacz") and count == 3
    with zipfile.ZipFile(tmp_path / "x.wacz") as package:
        assert package.testzip() is None
        assert {i.filename: i.compress_type for i in package.infolist()} == {DATA: 0, INDEX: 0}
        whole = gzip.decompress(package.read(DATA))
    assert whole.count(b"WARC-Type: response") == 2 and whole.count(b"WARC-Type: revisit") == 1
    file = _opened(address)
    places = index_entries(file)
    raw = (tmp_path / "x.wacz").read_bytes()
    parts = [parse(gzip.decompress(raw[a : a + n])) for a, n in places]
    assert [p["id"] for p in parts] == ["0", "1", "2"] and parts[2]["refers_to"] == "0"
    assert parts[2]["payload_bytes"] == 20 and parts[2]["payload"] is None


@pytest.mark.parametrize("limit", [1, 200])
def test_zip64_directories(tmp_path, monkeypatch, limit):
    """Sizes, places and the directory's place past a lowered limit stand in ZIP64 fields."""
    path = tmp_path / "big.zip"
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as package:
        for i in range(5):
            package.writestr(f"archive/{i}", bytes([i]) * 400)
        package.comment = b"PK\5\6 in the comment"
    monkeypatch.undo()
    file = _opened(f"file://{path}")
    found = members(file)
    assert [(m.name, m.length) for m in found] == [(f"archive/{i}", 400) for i in range(5)]
    for i, m in enumerate(found):
        assert file.read_at(400, place_of(file, m)) == bytes([i]) * 400


def test_damaged_packages_are_refused(tmp_path):
    def refused(name, raw, what):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(ValueError, match=what):
            index_entries(_opened(f"file://{tmp_path}/{name}"))

    refused("none", b"", "no end record")
    refused("text", b"not a package at all" * 10, "no end record")
    with zipfile.ZipFile(tmp_path / "deflated", "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr(DATA, b"x" * 1000)
    with pytest.raises(ValueError, match="deflated"):
        index_entries(_opened(f"file://{tmp_path}/deflated"))
    with zipfile.ZipFile(tmp_path / "whole", "w") as package:
        package.writestr(DATA, b"x" * 1000)
    refused("cut", (tmp_path / "whole").read_bytes()[:-1], "no end record")


def test_record_is_what_the_format_says():
    raw = record("7", "http://x/", b"body", "d", None)
    head, _, block = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert f"Content-Length: {len(block) - 4}".encode() in head and raw.endswith(b"body\r\n\r\n")


def test_empty_table_and_hot_payload(spark):
    assert archived(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, f"http://{i}", "same " * 300 if i % 3 else f"other {i}", *EXTRA) for i in range(600)]
    found = archived(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert found.where("record_type = 'revisit' AND refers_to = 599").count() == 399
    assert found.where("record_type = 'response'").count() == 201
    assert found.where(~F.col("intact")).count() == 0

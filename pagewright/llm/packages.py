"""WARC records in ZIP packages, written by tasks and read by ranges.

A package is a ZIP file of the kind web archives are exchanged in: a member
``archive/data.warc.gz`` with one gzip member for each record, and a member
``indexes/index.cdxj`` with a line for each record that gives its file, offset
and length.  Both are stored, not deflated, so a record's bytes stand as they
are in the package.

Writing: each task writes packages of about ``PACKAGE_BYTES`` straight into the
shared folder, each under a name of its own, and returns the names as rows; the
stored table of these rows is the list of packages.  What a lost or repeated
task wrote is in no row and so in no result.

Reading: nothing is unpacked.  From a package's tail come the end record or,
where that overflows, the ZIP64 end record; from those the central directory;
from that the places of members and the index.  The index gives runs of adjacent
records of about ``RUN_BYTES``, which are spread over all tasks; each run is one
range read.

Files are opened with ``pyarrow.fs`` by their full address, on any store it
knows; the folder is that of ``spark.checkpoint.dir`` unless one is named.

Equal payloads of at least ``least_revisit`` bytes are stored once, by the
record of the largest identifier; the others are revisits, which keep the
response's header and refer to it.  Rows repeated with that identifier are
responses, too.  A null identifier comes before all others, and refers to
nothing where no identifier is known.  Null payloads count as empty.  A record
of any length is written and read whole, by one task.  Control characters of an
address are written in percent form.  An empty table writes no package.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.frames import known, pieces_of, stored
from pagewright.plans.materialize import scratch_path

#: Smallest payload that is stored once.
LEAST_REVISIT = 1_000
#: A package is closed at the first record past so many bytes or records.
PACKAGE_BYTES = 64 << 20
PACKAGE_RECORDS = 50_000
#: Bytes of one range read, unless a single record is longer.
RUN_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
#: Marks of the ZIP format and the profile of the WARC format; fixed values.
END, END64, LOCATOR64, ENTRY, LOCAL = (b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PACKAGES = "package string, bytes long, records long"
RUNS = "package string, at long, length long, places array<struct<at: int, length: int>>"
RECORDS = (
    "record_type string, id string, refers_to string, url string, payload_digest string, "
    "payload_bytes long, intact boolean, payload binary"
)


# ---- who is stored, who refers -------------------------------------------------------


def with_revisits(
    pages: DataFrame, payload: str = "html", ident: str = "page_id", url: str = "url", least_revisit: int = LEAST_REVISIT
) -> DataFrame:
    """id, url, payload, digest (SHA-1), bytes and ``refers_to``: null for responses.

    Only payloads that occur more than once are looked up again.
    """
    body = known(payload)
    rows = pages.select(
        F.col(ident).alias("own"),
        F.col(url).cast("string").alias("url"),
        F.explode(F.array(body.cast("binary"))).alias("payload"),
    ).withColumns(
        {"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long"), "second": F.xxhash64("payload")}
    )
    same = ["digest", "bytes", "second"]
    repeated = (
        rows.where(F.col("bytes") >= least_revisit)
        .groupBy(*same)
        .agg(F.max("own").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = rows.join(stored(repeated, "repeated-payloads"), same, "left")
    refers = F.when(~F.col("own").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    return joined.select(F.col("own").cast("string").alias("id"), "url", "payload", "digest", "bytes", refers.alias("refers_to"))


# ---- writing -------------------------------------------------------------------------


def _urn(ident: str | None) -> str:
    return "urn:row:unknown" if ident is None else "urn:page:" + quote(ident, safe="")


def _named(urn: str | None) -> str | None:
    return unquote(urn.removeprefix("urn:page:")) if urn and urn.startswith("urn:page:") else None


def record(ident: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the header of the response and no payload."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: <{_urn(ident)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: quote(m[0]), url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class PackageWriter:
    """One package: records go straight to the file, the index follows at the end."""

    def __init__(self, address: str, level: int):
        store, path = fs.FileSystem.from_uri(address)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.address, self.level, self.lines, self.offset = address, level, [], 0
        self.raw = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, ident: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> None:
        packed = gzip.compress(record(ident, url, payload, digest, refers_to), self.level, mtime=0)
        self.data.write(packed)
        facts = {"url": url, "digest": f"sha1:{digest}", "filename": DATA.rsplit("/", 1)[1]}
        facts |= {"offset": str(self.offset), "length": str(len(packed))}
        self.lines.append(f"{_urn(ident)} {re.sub('[^0-9]', '', DATE)} {json.dumps(facts)}")
        self.offset += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            index.write("".join(line + "\n" for line in sorted(self.lines)).encode())
        self.zip.close()
        size = self.raw.tell()
        self.raw.close()
        return self.address, size, len(self.lines)


def write_packages(rows: DataFrame, folder: str | None = None, level: int = 1, most: int = PACKAGE_BYTES) -> DataFrame:
    """The stored list of packages written for the rows of ``with_revisits``."""
    target = (folder or scratch_path(rows.sparkSession, "llm-packages")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            columns = [batch.column(n) for n in ("id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns):
                writer = writer or PackageWriter(f"{target}/{uuid.uuid4().hex}.wacz", level)
                writer.add(*[cell.as_py() for cell in row])
                if writer.offset >= most or len(writer.lines) >= PACKAGE_RECORDS:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        names = ["package", "bytes", "records"]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(names, d)) for d in done],
            pa.schema([("package", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]),
        )

    return stored(rows.mapInArrow(run, PACKAGES), "packages")


# ---- finding members without unpacking -----------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    length: int
    size: int
    header: int


@lru_cache(maxsize=4)
def _opened(address: str):
    store, path = fs.FileSystem.from_uri(address)
    return store.open_input_file(path)


def _read(file, at: int, length: int) -> bytes:
    found = file.read_at(length, at)
    if len(found) < length:
        raise ValueError(f"package ends at {at + len(found)}, {length} bytes wanted at {at}")
    return found


def directory(file) -> tuple[int, int, int]:
    """Where the central directory begins, its bytes and its members.

    The end record stands in the last 65,557 bytes, behind it only a comment of
    the length it gives.  Fields of all ones are in the ZIP64 end record, which
    a locator right before the end record points to.
    """
    size = file.size()
    tail_at = max(0, size - 65_557)
    tail = _read(file, tail_at, size - tail_at)
    place = tail.rfind(END)
    while place >= 0 and (
        len(tail) < place + 22 or struct.unpack_from("<H", tail, place + 20)[0] != len(tail) - place - 22
    ):
        place = tail.rfind(END, 0, place)
    if place < 0:
        raise ValueError("no end record: not a ZIP package, or cut off")
    members, length, begin = struct.unpack_from("<10xHII", tail, place)
    if members == 0xFFFF or length == 0xFFFFFFFF or begin == 0xFFFFFFFF:
        mark, at = struct.unpack("<4s4xQ4x", _read(file, tail_at + place - 20, 20))
        if mark != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        mark, members, length, begin = struct.unpack("<4s28xQQQ", _read(file, at, 56))
        if mark != END64:
            raise ValueError("no ZIP64 end record")
    return begin, length, members


def members(file) -> list[Member]:
    """The members in the central directory, ZIP64 sizes and places included."""
    begin, length, count = directory(file)
    raw, at, found = _read(file, begin, length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != ENTRY:
            raise ValueError("central directory is damaged")
        method, packed, size, n_name, n_extra, n_comment, header = struct.unpack_from("<10xH8xIIHHH8xI", raw, at)
        name = raw[at + 46 : at + 46 + n_name]
        extra, place = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while place + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, place)
            if kind == 1:  # ZIP64: only those fields that overflow, in this order
                wide, inside = extra[place + 4 : place + 4 + n], 0
                fields = [size, packed, header]
                for i, value in enumerate(fields):
                    if value == 0xFFFFFFFF:
                        (fields[i],) = struct.unpack_from("<Q", wide, inside)
                        inside += 8
                size, packed, header = fields
            place += 4 + n
        found.append(Member(name.decode("utf-8", "replace"), method, packed, size, header))
        at += 46 + n_name + n_extra + n_comment
    return found


def place_of(file, member: Member) -> int:
    """Where the bytes of a stored member begin, behind its local header."""
    if member.method != 0:
        raise ValueError(f"{member.name} is deflated; its records cannot be read by ranges")
    mark, n_name, n_extra = struct.unpack("<4s22xHH", _read(file, member.header, 30))
    if mark != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    return member.header + 30 + n_name + n_extra


def index_entries(file) -> list[tuple[int, int]]:
    """Offset in the package and length of every record that the indexes name, in order."""
    inside = members(file)
    places = {m.name.rsplit("/", 1)[-1]: place_of(file, m) for m in inside if m.name.startswith("archive/")}
    found = []
    for member in inside:
        if not member.name.startswith("indexes/"):
            continue
        raw = _read(file, place_of(file, member), member.length)
        text = gzip.decompress(raw) if member.name.endswith(".gz") else raw
        for line in text.decode().split("\n"):
            if line:
                facts = json.loads(line[line.index("{") :])
                found.append((places[facts["filename"]] + int(facts["offset"]), int(facts["length"])))
    return sorted(found)


def locate_records(packages: DataFrame, most: int = RUN_BYTES) -> DataFrame:
    """Runs of adjacent records: package, where the run begins, its bytes and the records' places in it."""
    schema = pa.schema(
        [
            ("package", pa.string()),
            ("at", pa.int64()),
            ("length", pa.int64()),
            ("places", pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column("package").to_pylist():
                runs: list[list[tuple[int, int]]] = []
                for at, length in index_entries(_opened(package)):
                    if not runs or at != sum(runs[-1][-1]) or at + length - runs[-1][0][0] > most:
                        runs.append([])
                    runs[-1].append((at, length))
                rows = [
                    {
                        "package": package,
                        "at": r[0][0],
                        "length": sum(r[-1]) - r[0][0],
                        "places": [{"at": at - r[0][0], "length": length} for at, length in r],
                    }
                    for r in runs
                ]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return packages.select("package").mapInArrow(run, RUNS)


# ---- reading records -----------------------------------------------------------------


def parse(raw: bytes) -> dict:
    """A record: its type, identifiers, address, digest, the length of its full payload, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    response = fields["warc-type"] == "response"
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = hashlib.sha1(payload).hexdigest() if response else stated
    announced = re.search(rb"(?im)^content-length: *(\d+)", http)
    full = len(payload) if response or not announced else int(announced[1])
    return {
        "record_type": fields["warc-type"],
        "id": _named(fields["warc-record-id"][1:-1]),
        "refers_to": _named(fields.get("warc-refers-to", "")[1:-1]),
        "url": fields.get("warc-target-uri"),
        "payload_digest": digest,
        "payload_bytes": full,
        "intact": digest == stated and (not announced or int(announced[1]) == full),
        "payload": payload if response else None,
    }


_ARROW = pa.schema(
    [
        ("record_type", pa.string()),
        ("id", pa.string()),
        ("refers_to", pa.string()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("intact", pa.bool_()),
        ("payload", pa.binary()),
    ]
)


def read_packages(packages: DataFrame, payloads: bool = True, most: int = RUN_BYTES) -> DataFrame:
    """Every record of the listed packages (column ``package``).

    Digest and length are those of the payload read back, for revisits those
    their header states.  With ``payloads`` off, payloads are read and checked
    but not returned.
    """
    runs = stored(locate_records(packages, most), "record-runs")
    slots = packages.sparkSession.sparkContext.defaultParallelism
    spread = runs.repartition(max(slots, pieces_of(runs.count(), 4)), "package", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = _read(_opened(row["package"]), row["at"], row["length"])
                rows, held = [], 0
                for place in row["places"]:
                    rows.append(parse(gzip.decompress(raw[place["at"] : place["at"] + place["length"]])))
                    held += rows[-1]["payload_bytes"]
                    if not payloads:
                        rows[-1]["payload"] = None
                    if held > most:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return spread.mapInArrow(run, RECORDS)


def archived(pages: DataFrame, payload: str = "html", ident: str = "page_id", folder: str | None = None) -> DataFrame:
    """The records of ``pages``, written to packages and read back, without their payloads."""
    packages = write_packages(with_revisits(pages, payload, ident), folder)
    kind = pages.schema[ident].dataType.simpleString()
    own: dict[str, Column] = {n: F.col(n).cast(kind) for n in ("id", "refers_to")}
    return read_packages(packages, payloads=False).withColumns(own).drop("payload")


ARCHIVE_SQL = f"""
    WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    named AS (
        SELECT page_id, body, strlen(body) AS size, max(page_id) OVER (PARTITION BY body) AS first FROM bodies
    )
    SELECT page_id, size AS payload_bytes, sha1(body) AS payload_digest,
           CASE WHEN size >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN size >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM first THEN first END AS refers_to,
           TRUE AS intact
    FROM named
    """

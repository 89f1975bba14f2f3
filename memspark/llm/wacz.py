"""WARC records in ZIP packages: written from pages, read back by ranges without extraction.

A package is a ZIP archive with two stored members, archive/data.warc.gz (one gzip
member for each record) and indexes/index.cdxj (one line for each record, with its
offset and length). Reading takes three ranges before any record: the end of the file,
the central directory and the index; ZIP64 records and sizes are followed. Index rows
are then dealt over the tasks, and each task reads just the ranges of its records, in
order and joined where they touch; how many tasks that are follows the packages' bytes. Packages are written below the shared folder under
names that a retried task can't clash with; only those in the manifest are read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import math
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, read, scratch_dir

#: Records of a package at most; bytes after which one is closed; index rows of a reading range; bytes read at once.
PACKAGE_RECORDS, PACKAGE_BYTES, RANGE_RECORDS, READ_BYTES = 2000, 64 << 20, 500, 8 << 20
#: Bytes of packages for each task that reads records.
TASK_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Digests that occur more than once are broadcast up to this number; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Payloads shorter than this are responses, whatever else is equal to them.
LEAST_REVISIT = 0
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")
    return system, path


# -- records ------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, gzipped; payload None makes a revisit, whose HTTP header still tells the payload's size."""
    kind = "response" if payload is not None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress(b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in lines.decode().split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _page(urn: str | None) -> int | None:
    last = (urn or "").strip("<>").rsplit(":", 1)[-1]
    return int(last) if last.lstrip("-").isdigit() else None


def parse_record(data: bytes) -> tuple[int | None, str | None, str, int, str, int | None, bytes]:
    """(page_id, url, kind, payload bytes, digest, refers_to, payload) of a gzipped record; a response's size and digest are taken anew."""
    raw = gzip.decompress(data)
    at = raw.index(b"\r\n\r\n")
    head = _headers(raw[:at])
    block = raw[at + 4 : at + 4 + int(head["content-length"])]
    inner = block.index(b"\r\n\r\n")
    payload, kind = block[inner + 4 :], head["warc-type"]
    url, page = head.get("warc-target-uri"), _page(head["warc-record-id"])
    if kind == "revisit":
        return page, url, kind, int(_headers(block[:inner])["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"), _page(head.get("warc-refers-to")), b""
    return page, url, kind, len(payload), digest(payload), None, payload


# -- packages -----------------------------------------------------------------------------


def write_package(out, records: Iterator[bytes], zip64: bool = False) -> int:
    """Writes a package to a binary stream; returns the number of records. zip64 forces ZIP64 sizes."""
    lines, at = [], 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
            for data in records:
                member.write(data)
                lines.append(json.dumps({"offset": at, "length": len(data)}))
                at += len(data)
        with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=zip64) as member:
            member.write("".join(f"{x}\n" for x in lines).encode())
    return len(lines)


def _extra64(extra: bytes, wanted: list[int]) -> list[int]:
    """The 8-byte values of the ZIP64 extra field that stand for those of wanted that are all ones."""
    at, found = 0, []
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            found = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
        at += 4 + n
    left = iter(found)
    return [next(left) if w == 0xFFFFFFFF else w for w in wanted]


def directory(read_at, size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset of its bytes, length) of each stored member. read_at(offset, length) gives bytes."""
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, entries, length, start, _ = struct.unpack_from("<4s4H2LH", tail, end)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        head = read_at(at, 56)
        if head[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<3Q", head, 32)
    raw, at, out = read_at(start, length), 0, {}
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, n, m, k, offset = struct.unpack_from("<10xH8xLLHHH8xL", raw, at)
        name = raw[at + 46 : at + 46 + n].decode()
        full, packed, offset = _extra64(raw[at + 46 + n : at + 46 + n + m], [full, packed, offset])
        if method:
            raise ValueError(f"{name} is compressed, not stored")
        n2, m2 = struct.unpack("<26xHH", read_at(offset, 30))
        out[name] = (offset + 30 + n2 + m2, packed)
        at += 46 + n + m + k
    return out


def index_of(uri: str) -> list[tuple[int, int]]:
    """(offset in the file, length) of each record of a package, from its directory and index alone."""
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        members = directory(lambda at, n: f.read_at(n, at), f.size())
        at, n = members[INDEX]
        rows = [json.loads(x) for x in f.read_at(n, at).splitlines()]
    return [(members[DATA][0] + r["offset"], r["length"]) for r in rows]


def read_ranges(uri: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each range, in order of offset; ranges that touch are read together."""
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        ranges = sorted(ranges)
        while ranges:
            start, n = ranges[0]
            k, end = 1, start + n
            while k < len(ranges) and ranges[k][0] == end and end + ranges[k][1] - start <= READ_BYTES:
                end += ranges[k][1]
                k += 1
            data = f.read_at(end - start, start)
            yield from (data[a - start : a - start + m] for a, m in ranges[:k])
            ranges = ranges[k:]


# -- on Spark -----------------------------------------------------------------------------


def write_packages(pages: DataFrame, folder: str, package_records: int = PACKAGE_RECORDS, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """pages: page_id (a whole number), url, html. Writes packages below folder; returns their manifest (path, records, bytes).

    Of pages with equal payloads of at least least_revisit bytes the one with the largest page_id is
    written as response, the others as revisits of it (repeats of that page_id are responses, too, and so
    are pages without an id where none has one). A null html is an empty payload. An empty table makes none."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("string").alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    last = cut(rows.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha1", "last"))
    repeats = F.coalesce(F.octet_length("html") >= least_revisit, F.lit(False)) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    rows = join_hot(rows, last, "sha1", "left") if last.count() > BROADCAST_DIGESTS else rows.join(F.broadcast(last), "sha1", "left")
    rows = rows.select("page_id", "url", F.octet_length("html").cast("long").alias("size"), "sha1", F.when(repeats, F.col("last")).alias("refers"), F.when(~repeats, F.col("html")).alias("html"))

    def write(batches):
        """Packages of a task's records, as they come from the join: payloads are shuffled once at most."""
        held: list[bytes] = []
        size = 0

        def out():
            uri = f"{folder}/package-{uuid.uuid4().hex}.wacz"
            system, path = _open(uri)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            data = io.BytesIO()
            n = write_package(data, iter(held))
            with system.open_output_stream(path) as f:
                f.write(data.getbuffer())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64()), pa.array([data.tell()], pa.int64())], names=["path", "records", "bytes"])

        for b in batches:
            for r in b.to_pylist():
                payload = None if r["html"] is None else r["html"].encode()
                sha1 = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                held.append(record(r["page_id"], r["url"], payload, r["size"], sha1, r["refers"]))
                size += len(held[-1])
                if len(held) >= package_records or size >= PACKAGE_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()

    return cut(rows.mapInArrow(write, "path string, records long, bytes long"))


def read_packages(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """manifest: path, bytes. One row per record: path, page_id, url, record_type, payload_bytes, payload_digest, refers_to
    and, if asked for, payload (empty for revisits). Nothing is extracted; each task reads the ranges of its records."""

    def index(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = sorted(index_of(uri))
                for k in range(0, len(rows), RANGE_RECORDS):
                    part = rows[k : k + RANGE_RECORDS]
                    yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([k], pa.int64()), pa.array([[a for a, _ in part]], pa.list_(pa.int64())), pa.array([[n for _, n in part]], pa.list_(pa.int64()))], names=["path", "first", "offsets", "lengths"])

    schema = pa.schema([("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def records(batches):
        for b in batches:
            for r in b.to_pylist():
                out = []
                for data in read_ranges(r["path"], list(zip(r["offsets"], r["lengths"]))):
                    page, url, kind, size, sha1, refers, payload = parse_record(data)
                    out.append((r["path"], page, url, kind, size, sha1, refers, payload if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(schema.types)], schema=schema)

    tasks = max(1, math.ceil((manifest.agg(F.sum("bytes")).first()[0] or 0) / TASK_BYTES))
    ranges = manifest.select("path").mapInArrow(index, "path string, first long, offsets array<long>, lengths array<long>")
    out = ranges.repartition(tasks, "path", "first").mapInArrow(records, "path string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
    return out if payloads else out.drop("payload")


def op5_wacz(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_packages(read(spark, sf_dir, "pages"), scratch_dir(spark, "wacz"))
    return read_packages(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::bigint AS payload_bytes, sha1(html) AS h FROM p),
c AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last, list_transform(range(0, 8), lambda g: ('0x' || h[g * 5 + 1:g * 5 + 5])::bigint) AS parts FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::int + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM c
"""

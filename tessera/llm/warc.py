"""Legacy archive converter: ARC files become WARC files.

ARC records are read by the field names that the file's version block declares and by the declared length
of each record; WARC records get a synthesised identifier (from target, date and digest), an ISO date, a type and
SHA-1 digests in base32. Of records with equal payloads the one with the largest key is a response, the others
are revisits that name it; only digests are shuffled by content.

Archives are written below spark.checkpoint.dir by Spark's text writer (compressed by file) and read back as whole
files. Both kinds consist of segments of about ``SEGMENT_BYTES``, ``FILE_SEGMENTS`` to a file, so the size of a file is bounded (a single larger record stays whole).
Which rows are revisits is written first; where that is small, Spark sends it to the payloads instead of shuffling them.

Defined results: null or empty payloads are records of 0 bytes, equal to one another; very long payloads are written and read whole; a null key is kept
as null and never chosen over a known one; rows repeated with the same key and payload are all responses
(or all revisits); white space in a url is percent-encoded (its UTF-8 bytes), a null url becomes ``urn:unknown``; an empty table
gives an empty table; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import discard, materialise, shared_path, slices

#: Bytes of records after which a new ARC segment (with its own version block) begins.
SEGMENT_BYTES = 4 << 20
#: Segments in one archive file.
FILE_SEGMENTS = 8
#: Options of the text writer: speed over size, as archives are intermediate.
_WRITE = {"maxRecordsPerFile": FILE_SEGMENTS, "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Header fields of both versions of the format, in the order of the header line (fixed values).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_SPACE = re.compile(r"[\s\x00-\x1f\x7f]")
_KEY = re.compile(rb"\r\nX-Row-Key: (-?\d+)\r\n")


def base32_sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- ARC ----------------------------------------------------------------------------------------

def _arc_header(version: int, url: str, date: str, length: int) -> str:
    if version == 1:
        return f"{url} 0.0.0.0 {date} text/html {length}\n"
    return f"{url} 0.0.0.0 {date} text/html 200 - - 0 archive.arc {length}\n"


def _version_block(version: int, date: str) -> str:
    body = f"{version} 0 tessera\n{ARC_FIELDS[version]}\n"
    url, mime = "filedesc://archive.arc", "text/plain"
    if version == 1:
        head = f"{url} 0.0.0.0 {date} {mime} {len(body)}\n"
    else:
        head = f"{url} 0.0.0.0 {date} {mime} 200 - - 0 archive.arc {len(body)}\n"
    return f"{head}{body}\n"


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url_col: str = "url", payload_col: str = "html",
              date: str = "20240101000000") -> None:
    """Writes rows as ARC records; the versions of the format alternate by segment."""

    def run(batches):
        version, parts, held = 1, [], 0
        for batch in batches:
            for part in slices(batch, "_payload"):
                for k, url, payload in zip(*(part.column(c).to_pylist() for c in ("_key", "_url", "_payload"))):
                    payload = payload or ""
                    url = _SPACE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "urn:unknown"
                    row = f"X-Row-Key: {k}\r\n" if k is not None else ""
                    head = f"HTTP/1.1 200 OK\r\n{row}Content-Type: text/html; charset=utf-8\r\n\r\n"
                    size = len(head) + (len(payload) if payload.isascii() else len(payload.encode()))
                    parts.append(f"{_arc_header(version, url, date, size)}{head}{payload}\n")
                    held += size
                    if held >= SEGMENT_BYTES:
                        yield _segment(version, date, parts)
                        version, parts, held = 3 - version, [], 0
        if parts:
            yield _segment(version, date, parts)

    rows = pages.select(F.col(key).cast("long").alias("_key"), F.col(url_col).alias("_url"), F.col(payload_col).alias("_payload"))
    rows.mapInArrow(run, "value string").write.options(**_WRITE).text(path)


def _segment(version: int, date: str, parts: list[str]) -> pa.RecordBatch:
    return _lines([_version_block(version, date), *parts])


def _lines(parts: list[str]) -> pa.RecordBatch:
    text = "".join(parts)
    return pa.RecordBatch.from_arrays([pa.array([text[:-1]], pa.string())], names=["value"])  # the writer ends the line


def parse_arc(data: bytes):
    """Yields (fields of the header line, block) of each record; version blocks set the fields' names."""
    names, pos, n = ARC_FIELDS[1].split(), 0, len(data)
    while pos < n:
        end = data.index(b"\n", pos)
        values = data[pos:end].decode().split(" ")
        length = int(values[-1])
        block = data[end + 1:end + 1 + length]
        if len(block) != length:
            raise ValueError("an ARC record is shorter than declared")
        pos = end + 1 + length + 1
        if values[0].startswith("filedesc://"):
            names = block.split(b"\n")[1].decode().split(" ")
            continue
        if len(values) != len(names):
            raise ValueError("an ARC header line doesn't match its version")
        yield dict(zip(names, values)), block


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _inflated(batches):
    for batch in batches:
        for data in batch.column("content"):
            yield gzip.decompress(data.as_buffer())


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of ARC files: key, digest, n_bytes; with ``payloads`` also target, date, head, payload and block digests."""
    names = ["key", "digest", "n_bytes"] + (["target", "date", "ip", "head", "payload", "block_digest", "head_digest"] if payloads else [])
    types = ["long", "string", "long"] + ["string"] * 7 * payloads
    kinds = [pa.int64(), pa.string(), pa.int64()] + [pa.string()] * 7 * payloads
    limit = SEGMENT_BYTES if payloads else 1 << 60

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for data in _inflated(batches):
            rows, held = [], 0
            for fields, block in parse_arc(data):
                cut = block.index(b"\r\n\r\n") + 4
                head, payload = block[:cut], block[cut:]
                found = _KEY.search(head)
                row = [int(found[1]) if found else None, base32_sha1(payload), len(payload)]
                if payloads:
                    d = fields["Archive-date"]
                    row += [fields["URL"], f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", fields["IP-address"],
                            head.decode(), payload.decode(), base32_sha1(block), base32_sha1(head)]
                rows.append(row)
                held += len(block)
                if held >= limit:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return _files(spark, path).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


# ---- WARC ---------------------------------------------------------------------------------------

_REVISIT = "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"


def _record(key, digest, n_bytes, target, date, ip, head, payload, block_digest, head_digest, refers_to) -> str:
    """One WARC record: a revisit has the head alone as its block."""
    revisit = refers_to is not None
    name = hashlib.md5("|".join(str(x) for x in (target, date, digest, key) if x is not None).encode()).hexdigest()
    block, rows = head if revisit else head + payload, ""
    if key is not None:
        rows += f"X-Row-Key: {key}\r\n"
    if revisit:
        rows += f"X-Refers-To-Key: {refers_to}\r\n"
    return (f"WARC/1.0\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\n"
            f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {target}\r\n"
            f"WARC-IP-Address: {ip}\r\nWARC-Payload-Digest: sha1:{digest}\r\nWARC-Block-Digest: sha1:{head_digest if revisit else block_digest}\r\n"
            f"{_REVISIT if revisit else ''}X-Payload-Length: {n_bytes}\r\n{rows}Content-Type: application/http; msgtype=response\r\n"
            f"Content-Length: {len(head.encode()) + (0 if revisit else n_bytes)}\r\n\r\n{block}\r\n\r\n")


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit_bytes: int = 0) -> None:
    """Converts ARC files to WARC files; duplicates of at least ``min_revisit_bytes`` bytes become revisits."""
    meta = materialise(read_arc(spark, arc_path, payloads=False), "digests")
    copies = (
        meta.where(F.col("n_bytes") >= min_revisit_bytes)
        .groupBy("digest").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    revisits = meta.select("key", "digest").join(copies, "digest").where("NOT key <=> refers_to").distinct()
    revisits = materialise(revisits.select(F.col("key").alias("r_key"), F.col("digest").alias("r_digest"), "refers_to"), "revisits")
    rows = read_arc(spark, arc_path)
    rows = rows.join(revisits, F.col("key").eqNullSafe(F.col("r_key")) & (F.col("digest") == F.col("r_digest")), "left")
    names = ["key", "digest", "n_bytes", "target", "date", "ip", "head", "payload", "block_digest", "head_digest", "refers_to"]

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, "payload"):
                for row in zip(*(part.column(c).to_pylist() for c in names)):
                    parts.append(_record(*row))
                    held += len(parts[-1]) if row[-1] is not None else row[2] + len(row[6])
                    if held >= SEGMENT_BYTES:
                        yield _lines(parts)
                        parts, held = [], 0
        if parts:
            yield _lines(parts)

    rows.select(*names).mapInArrow(run, "value string").write.options(**_WRITE).text(warc_path)
    discard(meta, revisits)


def parse_warc(data: bytes):
    """Yields (header fields, block) of each record by its declared length."""
    pos, n = 0, len(data)
    while pos < n:
        end = data.index(b"\r\n\r\n", pos)
        lines = data[pos:end].decode().split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError("a WARC record doesn't start where the last one ends")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where declared")
        yield fields, data[start:stop]
        pos = stop + 4


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of WARC files with their digests verified: key, record_type, n_bytes, digest, refers_to, target, date, record_id
    and, with ``payloads``, the payload (null for revisits)."""
    names = ["key", "record_type", "n_bytes", "digest", "refers_to", "target", "date", "record_id"] + ["payload"] * payloads
    types = ["long", "string", "long", "string", "long", "string", "string", "string"] + ["string"] * payloads
    kinds = [pa.int64() if t == "long" else pa.string() for t in types]

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for data in _inflated(batches):
            rows, held = [], 0
            for f, block in parse_warc(data):
                cut = block.index(b"\r\n\r\n") + 4
                payload, digest = block[cut:], f["WARC-Payload-Digest"].removeprefix("sha1:")
                response = f["WARC-Type"] == "response"
                if response and (base32_sha1(payload) != digest or len(payload) != int(f["X-Payload-Length"])):
                    raise ValueError("a payload doesn't match its digest")
                key, refers = f.get("X-Row-Key"), f.get("X-Refers-To-Key")
                row = [key and int(key), f["WARC-Type"], int(f["X-Payload-Length"]), digest, refers and int(refers),
                       f["WARC-Target-URI"], f["WARC-Date"], f["WARC-Record-ID"]]
                rows.append(row + ([payload.decode() if response else None] if payloads else []))
                held += len(block) if payloads else 0
                if held >= SEGMENT_BYTES:
                    yield emit(rows)
                    rows, held = [], 0
            if rows:
                yield emit(rows)

    return _files(spark, path).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def archive(pages: DataFrame, key: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_revisit_bytes: int = 0) -> DataFrame:
    """Rows through ARC files to WARC files and back: what ``read_warc`` finds."""
    spark = pages.sparkSession
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc, key, url_col, payload_col)
    convert(spark, arc, out, min_revisit_bytes)
    return read_warc(spark, out)

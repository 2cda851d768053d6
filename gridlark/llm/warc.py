"""WARC writer and reader with Zstandard dictionaries.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built
from the archive's own records; then each record is one Zstandard frame. Of records with equal
payloads of at least `min_bytes` bytes the one with the largest page_id is a response and the
others are revisits of it; smaller payloads are all responses.

Defined results: null html is an empty payload; rows that repeat the page_id and payload of a
response are responses too; in a group of equal payloads without any page_id all are responses;
a null url is written as an empty target. An empty table gives no archive and no row. Very long
pages are records of their own, never cut.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import chunks, lean, stored

DICT_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 8 << 20
SAMPLE_BYTES = 2 << 20
DICT_BYTES = 64 << 10
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8").int >> 64 << 64


def record_id(page_id: int | None, digest: str) -> str:
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"
    return f"<urn:uuid:{uuid.UUID(int=SPACE | (page_id & (1 << 64) - 1))}>"


def page_of(rid: str) -> int:
    low = uuid.UUID(rid[len("<urn:uuid:") : -1]).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with refers_to a revisit, whose block has the HTTP header only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive: dictionary frame, then one frame a record."""
    import zstandard

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[: 128 << 10] for r in records[::step]]
    try:
        data = zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too few or too uniform samples
        data = b""
    data = data or b"".join(samples)[: DICT_BYTES] or b"WARC/1.1"
    made = zstandard.ZstdCompressionDict(data)
    made.precompute_compress(level=3)
    c = zstandard.ZstdCompressor(dict_data=made, level=3)
    return struct.pack("<II", DICT_MAGIC, len(data)) + data + b"".join(c.compress(r) for r in records)


def unpack(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """WARC header fields (lower-case names) and block of each record."""
    import zstandard

    magic, n = struct.unpack_from("<II", archive)
    if magic != DICT_MAGIC:
        raise ValueError("the archive has no dictionary frame")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + n]))
    f = io.BufferedReader(d.stream_reader(io.BytesIO(memoryview(archive)[8 + n :]), read_across_frames=True), 1 << 20)
    while line := f.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("no record begins here")
        head = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        block = f.read(int(head["content-length"]))
        f.read(4)
        yield head, block


def _write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(it, "payload", ARCHIVE_BYTES):
        rows = zip(*(t[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True)
        data = pack([record(*r) for r in rows])
        name = hashlib.sha1(data).hexdigest()[:20]
        yield pa.record_batch({"archive": [f"{name}.warc.zst"], "data": pa.array([data], pa.binary())})


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for batch in it:
        for archive, data in zip(batch["archive"].to_pylist(), batch["data"].to_pylist(), strict=True):
            rows = []
            for head, block in unpack(data):
                http, _, payload = block.partition(b"\r\n\r\n")
                n, digest = int(http.rpartition(b"Content-Length:")[2]), head["warc-payload-digest"].removeprefix("sha1:")
                page, ref = head.get("warc-x-page-id"), head.get("warc-refers-to")
                if ref is None:  # what was read must be what was written; a revisit has no payload of its own
                    read = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if read != (n, digest):
                        raise ValueError(f"{archive}: a payload differs from its digest")
                rows.append((
                    None if page is None else int(page), head["warc-target-uri"], n, digest,
                    head["warc-type"], None if ref is None else page_of(ref), archive, payload if ref is None else None,
                ))
            cols = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives as rows (archive, data), stored in the shared folder by Spark's writer.

    Who refers to whom is found from digests and page_ids alone; payloads are then joined by page_id and
    digest, so a payload that a third of all pages share is spread like any others.
    """
    lean(pages.sparkSession)
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    last = p.filter(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    last = last.filter("n > 1 and last is not null").select("sha", "last")
    again = p.select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha")).join(last, F.col("_sha") == F.col("sha")).filter(~F.col("_page").eqNullSafe(F.col("last")))
    again = again.select("_page", "_sha", F.col("last").alias("refers_to")).distinct()
    p = p.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left")
    out = p.select(F.col("page_id").cast("long").alias("page_id"), "url", "payload", "refers_to")
    return stored(out.mapInArrow(_write, "archive string, data binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record, payloads included (null for revisits)."""
    return archives.mapInArrow(
        _read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, payload binary"
    )


def export_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file into a folder that is mounted on all machines."""
    from pathlib import Path

    def put(rows):
        Path(folder).mkdir(parents=True, exist_ok=True)
        for r in rows:
            part = Path(folder, r.archive + ".part")
            part.write_bytes(r.data)
            part.rename(Path(folder, r.archive))

    archives.foreachPartition(put)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
d AS (SELECT h, last, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::BIGINT) AS v FROM m),
b AS (SELECT h, last, array_to_string(list_transform(v, lambda x:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((x >> 15) & 31))::BIGINT, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((x >> 10) & 31))::BIGINT, 1)
     || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((x >> 5) & 31))::BIGINT, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (x & 31))::BIGINT, 1)), '') AS digest FROM d)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, b.digest AS payload_digest,
       CASE WHEN p.page_id = b.last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> b.last THEN b.last END AS refers_to
FROM p JOIN b ON p.h = b.h
"""

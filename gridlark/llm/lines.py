"""Line dedup: lines that many documents share, as compressed keep bitmaps.

A line's key is the line without white space at both ends and with A-Z lower-cased. Rows (digest of a key, document,
places of the key in it) are dealt by ranges of digest and document, sorted, and streamed: a run of one digest is held only
until it has `min_docs` documents, so a line that a third of all documents share is spread over many tasks and none
holds it. A run that touches an end of its range leaves its count, and at most `min_docs` undecided rows, which meet those of
the neighbouring ranges. What comes back is one bitmap a document, not text.

Defined results: null and empty texts are one empty line; keys of fewer than `min_chars` code points are never dropped;
keys are equal when their 128-bit digests are; rows alike in doc_id and text are one document, and each of them is
returned by `apply_bitmaps`; rows that share a doc_id only (null included) are documents of their own. The first
occurrence is the smallest (doc_id, digest of the text, place), null doc_id first. An empty table gives no rows. Very long texts
are read whole; columns of any other name are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import arrow_batches, chunks, stored

SPACE = b" \t\n\x0b\x0c\r"
BATCH = 4 << 20
DOCUMENT, DROPPED, OPEN = 0, 1, 2
STEP = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("doc", pa.binary()), ("places", pa.binary()), ("n", pa.int64()), ("lead", pa.bool_())])


def document(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128-bit digest of a row's doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))))


def _lines(min_chars: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(it, "text", BATCH):
            rows = [], [], [], []
            for doc_id, doc, text in zip(t["doc_id"].to_pylist(), t["doc"].to_pylist(), t["text"].cast(pa.binary()).to_pylist(), strict=True):
                found: dict[bytes, list[int]] = {}
                lines = (text or b"").lower().split(b"\n")  # of bytes, so A-Z only
                for i, line in enumerate(lines):
                    if key := line.strip(SPACE):
                        found.setdefault(key, []).append(i)
                if min_chars > 1:
                    found = {k: v for k, v in found.items() if len(k.decode()) >= min_chars}
                rows[0].extend([b"", *(hashlib.md5(k).digest() for k in found)])
                rows[1].extend([doc_id] * (1 + len(found)))
                rows[2].extend([doc] * (1 + len(found)))
                rows[3].extend(np.array(v, np.int32).tobytes() for v in ([len(lines)], *found.values()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, (pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["key", "doc_id", "doc", "places"])

    return run


def _stream(min_docs: int, keep_first: bool):
    """Rows sorted by key and document: those to drop, those of runs at the ends of the range, and each document's number of lines."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, last, held, n, lead, at_start = None, None, [], 0, None, True

        def drop(row: tuple) -> None:
            if keep_first and row is lead:
                if at_start:  # the range before may have an earlier one
                    out.append((OPEN, key, *row, 0, True))
                elif len(row[2]) > 4:
                    out.append((DROPPED, None, row[0], row[1], row[2][4:], 0, False))
            else:
                out.append((DROPPED, None, *row, 0, False))

        def close(at_end: bool) -> None:
            if key is not None and (at_start or at_end):
                out.append((OPEN, key, lead[0], lead[1], b"", n, False))
                out.extend((OPEN, key, *row, 0, row is lead) for row in held)

        for batch in it:
            for k, doc_id, doc, places in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "doc", "places")), strict=True):
                row = (doc_id, doc, places)
                if not k:
                    out.append((DOCUMENT, None, doc_id, doc, None, int.from_bytes(places, "little"), False))
                    continue
                if k != key:
                    close(False)
                    at_start = key is None
                    key, last, held, n, lead = k, None, [], 0, row
                if doc == last:  # a repeated row of one document
                    continue
                last, n = doc, n + 1
                if n < min_docs:
                    held.append(row)
                else:
                    for x in (*held, row):
                        drop(x)
                    held = []
            if len(out) >= 1 << 14:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), STEP, strict=True)], schema=STEP)
                out.clear()
        close(True)
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), STEP, strict=True)], schema=STEP)

    return run


def _bitmaps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    c = zstandard.ZstdCompressor(level=1)
    for b in it:
        lost, maps = [], []
        for n, places in zip(b["n_lines"].to_pylist(), b["places"].to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(places), np.int32)] = False
            lost.append(n - int(keep.sum()))
            maps.append(c.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch([b["doc"], b["doc_id"], b["n_lines"], pa.array(lost, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "doc_id", "n_lines", "n_dropped", "keep"])


def bits(keep: bytes, n_lines: int) -> np.ndarray:
    """The flags of a compressed bitmap."""
    import zstandard

    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(keep), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """One row a document: doc (digest of the row), doc_id, n_lines, n_dropped, keep (compressed bitmap, a bit a line).

    Lines go whose key is in at least `min_docs` documents: all of them, or with `keep_first` all but the first one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document().alias("doc"), "text")
    with arrow_batches(docs.sparkSession, 256, "4m"):
        lines = stored(rows.mapInArrow(_lines(min_chars), "key binary, doc_id long, doc binary, places binary"), "lines")
    order = ["key", "doc_id", "doc"]
    schema = "kind int, key binary, doc_id long, doc binary, places binary, n long, lead boolean"
    steps = stored(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs, keep_first), schema), "line-runs")
    left = steps.filter(F.col("kind") == OPEN)  # a run or two a range, at most min_docs rows each
    total = left.groupBy("key").agg(F.sum("n").alias("total"), F.min(F.struct("doc_id", "doc")).alias("first")).filter(F.col("total") >= min_docs)
    is_first = F.lit(keep_first) & F.col("lead") & F.struct("doc_id", "doc").eqNullSafe(F.col("first"))
    late = left.filter(F.octet_length("places") > 0).join(total, "key").withColumn("places", F.when(is_first, F.expr("substring(places, 5)")).otherwise(F.col("places")))
    cols = ["doc", "doc_id", F.when(F.col("kind") == DOCUMENT, F.col("n")).alias("n"), "places"]
    every = steps.filter(F.col("kind") != OPEN).select(*cols).unionByName(late.select(*cols))
    every = every.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.max("n").alias("n_lines"), F.collect_list("places").alias("places"))
    return every.mapInArrow(_bitmaps, "doc binary, doc_id long, n_lines long, n_dropped long, keep binary")


def _kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        texts = []
        for text, n, lost, keep in zip(*(b[c].to_pylist() for c in ("text", "_n_lines", "_n_dropped", "_keep")), strict=True):
            texts.append("\n".join(x for x, k in zip(text.split("\n"), bits(keep, n).tolist(), strict=True) if k) if lost else text)
        names = [f for f in b.schema.names if f != "_keep"]
        yield pa.record_batch([pa.array(texts, pa.string()) if f == "text" else b[f] for f in names], names=names)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the kept lines as text (null where the text is null), _n_lines and _n_dropped."""
    maps = bitmaps.select(F.col("doc").alias("_doc"), F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"), F.col("keep").alias("_keep"))
    both = docs.withColumn("_doc", document()).join(maps, "_doc").drop("_doc")
    return both.mapInArrow(_kept, both.drop("_keep").schema)


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10, min_chars=1))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
m AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM m WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
d AS (SELECT m.*, often.key IS NOT NULL AS gone FROM m LEFT JOIN often USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

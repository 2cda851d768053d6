"""Shared helpers of the training-data operators: scratch space, Arrow batching, hashing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MASK = 0xFFFFFFFFFFFFFFFF
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a fresh one on a single machine, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_gridlark_dir", None)
        if base is None:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext._gridlark_dir = base
            spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """Write df to the shared folder in n buckets of key: joins on key then leave it where it is."""
    spark = df.sparkSession
    name = f"gridlark_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("path", new_path(spark, name)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: files at a path of one's own stay, and so does the resolved frame
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not when the driver happens to collect garbage.

    Handles of frames are let go on the Python side first and, a moment later, on the other side: hence two rounds.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        spark._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Delete tables that stored() or bucketed() wrote and nothing will read again, and the shuffle files of finished steps."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if tables:
        release(tables[0].sparkSession)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """A digest of these text columns, nulls told apart: rows with one key are alike in all of them."""
    parts = [F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(F.octet_length(c), F.lit(0)).cast("string"), F.lit(":"), F.coalesce(c, F.lit(""))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def quartiles(df: DataFrame, group: str, *columns: str, digits: int = 3) -> DataFrame:
    """Rows (group, q1_<column>, q2_<column>, q3_<column>): exact quartiles of the values rounded to `digits` places.

    Values are counted first, so what a group's window sees is bounded by the number of rounded values.
    """
    out = None
    for c in columns:
        n = df.filter(F.col(c).isNotNull()).groupBy(group, F.round(c, digits).alias("v")).agg(F.count("*").alias("n"))
        w = Window.partitionBy(group)
        n = n.withColumns({"below": F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
        q = n.groupBy(group).agg(*[F.min(F.when(4 * F.col("below") >= i * F.col("all"), F.col("v"))).alias(f"q{i}_{c}") for i in (1, 2, 3)])
        out = q if out is None else out.join(q, group, "full")
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(spark: SparkSession) -> SparkSession:
    """Let Arrow batches hold few rows, unless the session says how many: rows here are texts or blocks of megabytes, and
    a batch is in memory on both sides."""
    for key, usual, value in (("maxRecordsPerBatch", "10000", "256"), ("maxBytesPerBatch", "67108864b", "4m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == usual:
            spark.conf.set(key, value)
    return spark


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: str) -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes for the jobs that run inside; the session's settings come back after them."""
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def chunks(it: Iterator[pa.RecordBatch], column: str, target: int) -> Iterator[pa.Table]:
    """Regroup Arrow batches so that `column` holds about `target` bytes in each table.

    A batch larger than the target is cut at row borders; one very long row stays whole.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in it:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        n = max(1, col.nbytes)
        step = max(1, int(batch.num_rows * target / n)) if n > target else batch.num_rows
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            held.append(part)
            size += part.column(batch.schema.get_field_index(column)).nbytes
            if size >= target:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
        held = []
    pa.default_memory_pool().release_unused()  # the worker is kept for later tasks


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * MIX1
    h ^= h >> np.uint64(27)
    h *= MIX2
    h ^= h >> np.uint64(31)
    return h


def window_hash(b: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all windows of k consecutive values, by doubling."""
    n = len(b) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    cur = mix(b.astype(np.uint64) + MULT)
    p, width = int(MULT), 1
    out, have = None, 0
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, have = cur[: len(b) - width + 1].copy(), width
            else:
                m = len(b) - have - width + 1
                out = out[:m] * np.uint64(p) + cur[have : have + m]
                have += width
        rest >>= 1
        if rest:
            m = len(cur) - width
            cur = cur[:m] * np.uint64(p) + cur[width : width + m]
            width *= 2
            p = p * p & MASK
    return mix(out[:n])


def window_minima(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each window of w hashes, and the leftmost place that has it."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, k = h, 1
    while 2 * k <= w:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    low = np.minimum(low[:n], low[w - k : w - k + n])
    # the leftmost place is the window's own begin, or that of the next window with the same minimum; the last of a
    # run of such windows is looked through
    told = h[:n] == low
    last = np.flatnonzero(~told & np.append(low[1:] != low[:-1], True))
    place = np.arange(n)
    for a in range(0, len(last), 1 << 16):
        i = last[a : a + (1 << 16)]
        place[i] += (h[i[:, None] + np.arange(w)] == low[i, None]).argmax(1)
    told[last] = True
    told = np.flatnonzero(told)
    return low, np.repeat(place[told], np.diff(told, prepend=-1))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each byte string (the same on every machine)."""
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(len(flat), dtype=np.uint64) - np.repeat(starts, size).astype(np.uint64)
    v = mix((flat + np.uint64(1)) * MULT + mix(at + np.uint64(77)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
    return mix(total[starts + size] - total[starts] + size.astype(np.uint64) * MIX2)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges start..start+length-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(total) - np.repeat(begin, lengths) + np.repeat(starts, lengths)

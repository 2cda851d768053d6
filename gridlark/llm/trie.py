"""Conversation prefix trie: which conversations share their first turns, from sorted sequences and range minima.

Turns become 128-bit digests; a conversation is the string of its turns' digests. Equal conversations are merged, the
distinct ones sorted, and each is given the number of leading turns that it shares with the one before (its LCP). A node is a
prefix; its members are neighbours in that order. A sparse table holds the least LCP of every stretch of 2^k neighbours, so that
each candidate prefix finds how far it reaches to the left and to the right by binary search, independently of all others and without a
stack. Sums over subtrees are differences of running sums.

The order is cut into ranges and, in a task, into blocks of bounded size. A node inside a block is complete. Of nodes that cross a
block's end (prefixes of its first or last sequence) each block gives a part, and parts are added up by node. So neither a first turn
that a third of all conversations share nor a group of equal conversations is ever held by one task: of a group's members only
compressed blocks of sorted ids meet, which one task streams through the hash.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), ties by a digest of role and text; repeated
rows are turns of their own; rows without conv_id belong to no conversation and are left out; turns are equal when their 128-bit
digests are. A table without conversations gives no node, not even the root. Very long texts are only hashed; of a conversation 20 bytes a turn are held
together, so the longest conversation, not the largest group, bounds a row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import stored

WIDTH = 16
IDS = 1 << 16  # ids of one block of a group
BLOCK_ROWS = 1 << 15
BLOCK_BYTES = 8 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
MEMBERS = pa.schema([("id", pa.binary()), ("key", pa.binary()), ("words", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ids", pa.binary()), ("ends", pa.string())])
NODES = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends", pa.string()), ("id", pa.binary()), ("parent", pa.binary()),
])
SQL_TYPES = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL_TYPES[f.type]}" for f in schema)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest, words>>): each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    each = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_shared_start(convs: DataFrame, every: int = 20, longest: int = 3) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % `every` (fewer or none if there are no more), then its own
    turns after its first h; h is the unsigned crc32 of the decimal c, modulo `longest` + 1."""
    h = (F.crc32(F.col("conv_id").cast("string")) % (longest + 1)).cast("int")
    first = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, longest).alias("_first"))
    own = convs.withColumn("_h", h).join(first, F.col("conv_id") - F.col("conv_id") % every == F.col("_base"), "left")
    start = F.when(F.col("_first").isNotNull(), F.slice("_first", F.lit(1), F.col("_h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return own.select("conv_id", F.concat(start, rest).alias("turns"))


def _packed(convs: DataFrame) -> DataFrame:
    """(conv_id, id, key, words): the digests as one string of bytes, the words as 8 hex digits each."""

    def joined(f) -> Column:
        return F.unhex(F.array_join(F.transform("turns", f), ""))

    p = convs.select("conv_id", joined(lambda t: t["digest"]).alias("key"), joined(lambda t: F.lpad(F.hex(t["words"]), 8, "0")).alias("words"))
    return p.select("conv_id", F.unhex(F.md5("key")).alias("id"), "key", "words")


def _zip(ids: list[int]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(np.array(ids, np.int64), prepend=0).tobytes())


def _unzip(block: bytes) -> list[int]:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.int64)).tolist()


def _members(most: int):
    """Rows sorted by (id, conv_id): one row a group; groups at the ends of the range, or of many ids, as blocks of ids without their hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, ids, flushed, at_start = None, [], False, True

        def block() -> tuple:
            return (*now, len(ids), ids[0], _zip(ids), None)

        def close(at_end: bool) -> None:
            if not ids:
                return
            if flushed or at_start or at_end:
                out.append(block())
            else:
                out.append((*now, len(ids), ids[0], None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))

        for b in it:
            for conv, *row in zip(*(b[c].to_pylist() for c in ("conv_id", "id", "key", "words")), strict=True):
                if now is None or row[0] != now[0]:
                    close(False)
                    at_start = now is None
                    now, ids, flushed = row, [], False
                ids.append(conv)
                if len(ids) == most:
                    out.append(block())
                    ids, flushed = [], True
            if len(out) >= 1 << 12:
                yield _batch(out, MEMBERS)
                out.clear()
        close(True)
        if out:
            yield _batch(out, MEMBERS)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by (id, first conv_id): one row a group, its ids streamed through the hash."""
    out: list[tuple] = []
    now, n, first, h = None, 0, None, None

    def close() -> None:
        if now is not None:
            out.append((*now, n, first, None, h.hexdigest()))

    for b in it:
        for gid, key, words, size, conv, ids in zip(*(b[c].to_pylist() for c in ("id", "key", "words", "n", "conv_id", "ids")), strict=True):
            if now is None or gid != now[0]:
                close()
                now, n, first, h = (gid, key, words), 0, conv, hashlib.sha256()
            h.update((("," if n else "") + ",".join(map(str, _unzip(ids)))).encode())
            n += size
    close()
    if out:
        yield _batch(out, MEMBERS)


def groups(packed: DataFrame, block_ids: int) -> DataFrame:
    """Distinct sequences (id, key, words, n, conv_id, ends): members, the smallest, and the hash of all their decimal ids in order."""
    cols = ["id", "key", "words", "n", "conv_id", "ends"]
    made = stored(packed.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(_members(block_ids), _ddl(MEMBERS)), "members")
    cut = made.filter("ends is null").repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(_joined, _ddl(MEMBERS))
    return made.filter("ends is not null").select(*cols).unionByName(cut.select(*cols))


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of leading digests that two keys share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            low = mid
        else:
            high = mid
    return low


def _adjacent(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their range's number, their place in it, and the turns shared with the row before (none: null) and after."""
    part, place, held = TaskContext.get().partitionId(), 0, None
    for b in it:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        keys = t["key"].to_pylist()
        lcp = [shared_turns(x, y) for x, y in zip(keys, keys[1:], strict=False)]
        m = len(keys) - 1  # the last row waits for the next one
        yield from _placed(t.slice(0, m), part, place, [before, *lcp][:m] if held is not None else [None, *lcp][:m], lcp)
        before = lcp[-1] if lcp else (before if held is not None else None)
        place, held = place + m, t.slice(m)
    if held is not None:
        yield from _placed(held, part, place, [before], [None])


def _placed(t: pa.Table, part: int, place: int, before: list, after: list) -> Iterator[pa.RecordBatch]:
    n = t.num_rows
    for name, values in (("part", [part] * n), ("place", range(place, place + n)), ("lcp", before), ("after", after)):
        t = t.append_column(name, pa.array(values, pa.int64()))
    yield from t.to_batches()


def _between(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last keys of the ranges in order: what each range's ends share with their neighbours; -1 where there is none."""
    keys: dict[int, list[bytes]] = {}
    for b in it:
        for part, key in zip(b["part"].to_pylist(), b["key"].to_pylist(), strict=True):
            keys.setdefault(part, []).append(key)
    parts = list(keys)
    lcp = [-1, *(shared_turns(keys[p][-1], keys[q][0]) for p, q in zip(parts, parts[1:], strict=False)), -1]
    yield pa.record_batch([pa.array(c, pa.int64()) for c in (parts, lcp[:-1], lcp[1:])], names=["part", "at_first", "at_last"])


def sparse_table(v: np.ndarray) -> list[np.ndarray]:
    """Row k: the least of v[i .. i + 2^k - 1] for each i."""
    rows = [v]
    while 2 << (len(rows) - 1) <= len(v):
        half = 1 << (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    return rows


def range_min(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    k = np.log2(right - left + 1).astype(np.int64)
    out = np.empty(len(left), np.int64)
    for i in np.unique(k).tolist():
        at = np.flatnonzero(k == i)
        out[at] = np.minimum(table[i][left[at]], table[i][right[at] - (1 << i) + 1])
    return out


def extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the prefix of `depth` turns of each sequence `at` reaches to the left and to the right: steps of falling powers of two."""
    m, left, right = len(table[0]), at.copy(), at.copy()
    for k in range(len(table) - 1, -1, -1):
        step, low = 1 << k, table[k]
        ok = np.flatnonzero(right + step < m)
        ok = ok[low[right[ok] + 1] >= depth[ok]]
        right[ok] += step
        ok = np.flatnonzero(left >= step)
        ok = ok[low[left[ok] - step + 1] >= depth[ok]]
        left[ok] -= step
    return left, right


def _chain(key: bytes, depth: int) -> list[bytes]:
    """Ids of the prefixes of a key of 0 to `depth` turns."""
    out = [b"\0" * WIDTH]
    for d in range(depth):
        out.append(hashlib.md5(out[-1] + key[d * WIDTH : (d + 1) * WIDTH]).digest())
    return out


def block_nodes(t: pa.Table) -> pa.RecordBatch:
    """The nodes of consecutive sequences; parts of nodes that cross an end carry an id, children of such nodes their parent's id."""
    keys, ends = t["key"].to_pylist(), np.array(t["ends"].to_pylist(), object)
    lcp, n, conv = (t[c].to_numpy() for c in ("lcp", "n", "conv_id"))
    after = int(t["after"][-1].as_py())
    size = np.array([len(k) // WIDTH for k in keys])
    words = np.frombuffer(b"".join(t["words"].to_pylist()), ">i4").astype(np.int64)
    m, first = len(size), int(lcp[0])
    floor = lcp.copy()  # each sequence has nodes of its own from floor + 1 turns on; at the first one, parts of all above it
    floor[0] = -1
    start = np.concatenate([[0], np.cumsum(size - floor)])
    at = np.repeat(np.arange(m), size - floor)
    depth = np.arange(len(at)) - start[at] + floor[at] + 1
    begins = depth > lcp[at]
    table = sparse_table(lcp)
    left, right = extents(table, at, depth)
    up = extents(table, at, np.maximum(depth - 1, 0))[0]
    parent = np.where(depth > 0, start[up] + depth - 1 - floor[up] - 1, -1)
    total = np.concatenate([[0], np.cumsum(n)])
    members = total[right + 1] - total[left]
    smallest = range_min(sparse_table(conv), left, right)
    leaf = np.concatenate([[0], np.cumsum(np.append(lcp[1:], after) < size)])
    word = np.where(depth > 0, np.append(words, 0)[(np.cumsum(size) - size)[at] + depth - 1], 0)
    saved = np.concatenate([[0], np.cumsum(members * word - np.where(begins, word, 0))])
    children = np.bincount(parent[begins & (depth > 0)], minlength=len(at))
    crosses = ~begins | (right == m - 1) & (depth <= after)
    own = begins & (depth == size[at])
    head, tail = _chain(keys[0], first), _chain(keys[-1], after)
    ids = [None] * len(at)
    for i in np.flatnonzero(crosses).tolist():
        ids[i] = head[depth[i]] if at[i] == 0 and depth[i] <= first else tail[depth[i]]
    open_parent = (parent >= 0) & crosses[parent]
    known = np.where(open_parent | (parent < 0), -1, parent)
    return pa.record_batch([
        pa.array(smallest), pa.array(depth), pa.array(smallest[known], mask=known < 0), pa.array(members), pa.array(children), pa.array(leaf[right + 1] - leaf[left]),
        pa.array(saved[start[right + 1]] - saved[np.arange(len(at))]), pa.array(np.where(own, ends[at], None), pa.string()), pa.array(ids, pa.binary()),
        pa.array([ids[p] if o else None for p, o in zip(parent.tolist(), open_parent.tolist(), strict=True)], pa.binary()),
    ], schema=NODES)


def _nodes(most_rows: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = held_bytes = 0
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held_bytes
            if held:
                made = block_nodes(pa.Table.from_batches(held))
                yield from (made.slice(i, 1 << 14) for i in range(0, made.num_rows, 1 << 14))
            held.clear()
            rows = held_bytes = 0

        for b in it:
            part, place, size = b["part"].to_numpy(), b["place"].to_numpy(), pc.binary_length(b["key"]).to_numpy()
            cut = 0
            for i in range(b.num_rows):
                here = (part[i], place[i] - 1)
                if here != last and last is not None or rows >= most_rows or held_bytes >= BLOCK_BYTES:
                    if i > cut:
                        held.append(b.slice(cut, i - cut))
                    yield from flush()
                    cut = i
                last = (part[i], place[i])
                rows += 1
                held_bytes += int(size[i])
            if b.num_rows > cut:
                held.append(b.slice(cut))
        yield from flush()

    return run


def prefix_trie(convs: DataFrame, block_rows: int = BLOCK_ROWS, block_ids: int = IDS) -> DataFrame:
    """All nodes of the trie of (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The sizes of blocks bound a task's memory and change nothing in the result.
    """
    distinct = groups(stored(_packed(convs), "sequences"), block_ids)
    cols = "id binary, key binary, words binary, n long, conv_id long, ends string, part long, place long, lcp long, after long"
    ordered = stored(distinct.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_adjacent, cols), "ordered")
    rims = ordered.filter("lcp is null or after is null").select("part", "place", "key").repartition(1).sortWithinPartitions("part", "place")
    rims = rims.mapInArrow(_between, "part long, at_first long, at_last long")  # a row of three numbers a range, so it may be broadcast
    known = ordered.join(F.broadcast(rims), "part").withColumns({"lcp": F.coalesce("lcp", "at_first"), "after": F.coalesce("after", "at_last")})
    nodes = stored(known.select("part", "place", "key", "words", "n", "conv_id", "ends", "lcp", "after").mapInArrow(_nodes(block_rows), _ddl(NODES)), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    crossing = nodes.filter("id is not null").groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.max("ends").alias("ends"), *sums)
    crossing = stored(crossing, "crossing")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")]
    mine = nodes.filter("id is null")
    below = mine.filter("parent is not null").drop("id").unionByName(crossing.filter("parent is not null").withColumn("parent_conv_id", F.lit(None).cast("long")).drop("id"))
    above = crossing.select(F.col("id").alias("_id"), F.col("conv_id").alias("_conv"))
    below = below.join(above, F.col("parent") == F.col("_id")).withColumn("parent_conv_id", F.col("_conv"))
    root = crossing.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return mine.filter("parent is null").select(*out).unionByName(below.select(*out)).unionByName(root.select(*out))


def op11_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(with_shared_start(stored(sequences(turns), "conversations"), every=20, longest=3))


# DuckDB has no crc32, so it is spelled out: a list of bytes, each followed by eight shifts
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length({0})), lambda i:
 [ascii(substr({0}, i + 1, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)"""

OP11_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC.format("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT c.conv_id, t.k, 0 AS own, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
      UNION ALL SELECT c.conv_id, t.k, 1, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
d AS (SELECT conv_id, text, row_number() OVER w AS d, list(sha256(length(role) || ':' || role || text)) OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, k)),
e AS (SELECT conv_id, d, text, sha256(array_to_string(path, ',')) AS node, sha256(array_to_string(path[:-2], ',')) AS up FROM d
      UNION ALL SELECT conv_id, 0, '', sha256(''), NULL FROM c),
m AS (SELECT node, any_value(up) AS up, d, min(conv_id) AS conv_id, count(*) AS n, len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS words FROM e GROUP BY node, d),
z AS (SELECT conv_id, max(d) AS d FROM e GROUP BY conv_id),
s AS (SELECT e.node, string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id) AS ids FROM e JOIN z USING (conv_id, d) GROUP BY e.node),
k AS (SELECT up, count(*) AS n FROM m WHERE up IS NOT NULL GROUP BY up),
y AS (SELECT DISTINCT a.node AS above, b.node AS node FROM e a JOIN e b ON a.conv_id = b.conv_id AND b.d >= a.d),
g AS (SELECT y.above AS node, count(*) FILTER (k.n IS NULL) AS leaves, sum((m.n - 1) * m.words) AS saved FROM y JOIN m ON m.node = y.node LEFT JOIN k ON k.up = y.node GROUP BY y.above)
SELECT m.conv_id, m.d::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, g.leaves::BIGINT AS n_leaves, g.saved::BIGINT AS saved_tokens,
       sha256(coalesce(s.ids, '')) AS ends_sha256
FROM m LEFT JOIN m AS p ON p.node = m.up LEFT JOIN k ON k.up = m.node LEFT JOIN s ON s.node = m.node JOIN g ON g.node = m.node
"""

"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the hashes of its distinct word n-grams. Texts become units of word numbers
once. Equal sets are one node; of each node one document, its representative, takes part.

1. Units send the distinct n-grams of their representatives to hash partitions, which add up in how many
   sets an n-gram stands and tell the units. Sets are ordered by that frequency, rare n-grams first.
2. Two sets that reach the threshold share their first common n-gram within their prefixes. An n-gram that
   stands in one set only keeps its place in the prefix but needs no index row. If the first common n-gram
   is rare (in FREQUENT sets at most, whatever the size of the collection: two, since an n-gram of two sets names one
   pair and no combination can make that fewer), it finds the pair by itself. If it
   is frequent, then so are all that they share, and prefixes extended by m n-grams share at least m + 1; with
   the frequent n-grams dealt into m classes, two of these fall into one class, so indexing all pairs within a
   class finds the pair. m follows the set's size, so a document has about as many combinations as n-grams in
   its prefix.
3. Candidates of an index key are first compared with the key's hub only, the node whose n-grams are the most frequent ones:
   of near copies that is the text the others were made from, or the one with the fewest edits, which links with more of them than any
   other. What links is joined to components, and then only nodes of different components that share a key are compared, all of them, with a
   key of many nodes dealt in blocks, and each two at the first key that they share. So no group of copies is expanded into pairs and no link between
   components is lost. Candidates must also pass bounds from sizes, from the place of the first common n-gram
   and from parity bits of each set (twice as many as it has members), which no linked pair fails; then they are verified on the whole sets.

Defined results: null or empty text and text of white space only has an empty set and is linked
with nothing; repeated rows have equal sets and share a component; rows without doc_id are judged
by their text, and a component's id is its smallest doc_id that is not null; extra columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.blocks import deal, unzip_arrays, zip_arrays
from gridlark.llm.common import bucketed, chunks, forget, lean, mix, ranges, release, row_key, shuffle_width, stored, word_hashes
from gridlark.llm.graph import components

BATCH = 4 << 20
FREQUENT = 2
KEY_ROWS = 4096  # nodes of one key that one task compares with each other
LOW = 32  # first keys of a node by which a pair that has met is known


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the word numbers of all texts, and the hashes of the words."""
    ids: dict[bytes, int] = {}
    flat: list[int] = []
    size = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            words = text.lower().split()  # of bytes: lower-cases A-Z and splits at ASCII white space only
            size[i] = len(words)
            flat += [ids.setdefault(w, len(ids)) for w in words]
    return size, np.array(flat, np.int64), word_hashes(list(ids))


def shingle_sets(size: np.ndarray, token: np.ndarray, word: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct k-word shingles of each text; with fewer words, of the whole sequence."""
    start = np.cumsum(size) - size
    full = np.where(size >= k, size - k + 1, 0)
    at = ranges(start, full)
    s = np.zeros(len(at), np.uint64)
    for j in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + mix(word + np.uint64(j + 1))[token[at + j]]
    s = mix(s)
    end = np.cumsum(full)
    out = []
    for n, a, e, b in zip(size.tolist(), (end - full).tolist(), end.tolist(), start.tolist(), strict=True):
        if n >= k:
            v = np.sort(s[a:e])
            out.append(v[np.concatenate([[True], v[1:] != v[:-1]])])
        elif n:
            v = np.full(1, n + 1000, np.uint64)
            for x in word[token[b : b + n]]:
                v = mix(v * np.uint64(31) + x)
            out.append(v)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> int:
    v = mix(s + np.uint64(len(s)))
    return int(mix(np.array([np.add.reduce(v) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def parity(s: np.ndarray) -> np.ndarray:
    """Bits of a set, bit i set if an odd number of members hash to i: as many as the power of two from 256 on that is at least twice the set's size.

    Two sets differ in at least as many members as their bits do, which bounds their overlap; of sets of unlike
    sizes the longer bits are folded.
    """
    m = max(256, 1 << (2 * len(s) - 1).bit_length())
    bits = np.bincount((mix(s) & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def differ(a: Column, b: Column) -> Column:
    """In how many bits two sets' parities differ; sizes of pairs in question are at most one power of two apart."""
    k = F.least(F.size(a), F.size(b))
    fold = lambda x: F.when(F.size(x) > k, F.zip_with(F.slice(x, 1, k), F.slice(x, k + 1, k), lambda y, z: y.bitwiseXOR(z))).otherwise(x)
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def _units(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, t in enumerate(chunks(it, "text", BATCH)):
            size, token, word = tokens(t["text"].cast(pa.binary()).to_pylist())
            sets = shingle_sets(size, token, word, k)
            cols = {
                "doc_id": t["doc_id"].combine_chunks(), "n": pa.array([len(s) for s in sets], pa.int64()),
                "sig": pa.array([signature(s) if len(s) else None for s in sets], pa.int64()), "mark": pa.array([parity(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            }
            rows = pa.StructArray.from_arrays(list(cols.values()), list(cols))
            block = zip_arrays(size.astype(np.int32), token.astype(np.uint32), word)
            yield pa.record_batch({"batch": pa.array([part << 24 | i], pa.int64()), "block": pa.array([block], pa.binary()), "rows": pa.ListArray.from_arrays([0, len(rows)], rows)})

    return run


def _chosen(block: bytes, rows: list[int], k: int) -> list[np.ndarray]:
    """The sets of some rows of a unit."""
    size, token, word = unzip_arrays(block, np.int32, np.uint32, np.uint64)
    size = size.astype(np.int64)
    start = (np.cumsum(size) - size)[rows]
    return shingle_sets(size[rows], token[ranges(start, size[rows])], word, k)


class Grams:
    """The distinct n-grams of a unit's representatives, by 48 bits of their hashes."""

    def __init__(self, sets: list[np.ndarray], n_parts: int):
        self.key, self.at, self.count = np.unique(np.concatenate(sets) >> np.uint64(16), return_inverse=True, return_counts=True)
        # parts are ranges of keys, which are hashes: a part's keys stay as close to each other as a unit's, however many parts there are
        self.parts = list(deal(((self.key >> np.uint64(16)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64), n_parts))


def _send(k: int, n_parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for batch, block, chosen in zip(*(rb[c].to_pylist() for c in ("batch", "block", "chosen")), strict=True):
                g = Grams(_chosen(block, sorted(chosen), k), n_parts)
                rows = [(i, zip_arrays(np.diff(g.key[x], prepend=np.uint64(0)), np.minimum(g.count[x], 255).astype(np.uint8))) for i, x in g.parts]
                yield pa.record_batch({"part": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([batch] * len(rows), pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _frequencies(t: pa.Table) -> pa.Table:
    """In how many sets (255 at most) each n-gram of one part stands, for each unit in its order."""
    cols = [unzip_arrays(x, np.uint64, np.uint8) for x in t["block"].to_pylist()]
    key = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in cols])
    count = np.concatenate([c[1] for c in cols]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    total = np.minimum(np.add.reduceat(count[order], np.flatnonzero(new)), 255).astype(np.uint8)
    all_of = np.empty(len(key), np.uint8)
    all_of[order] = total[np.cumsum(new) - 1]
    ends = np.cumsum([len(c[0]) for c in cols])
    return pa.table({"part": t["part"], "batch": t["batch"], "block": pa.array([zip_arrays(x) for x in np.split(all_of, ends[:-1])], pa.binary())})


def need(n: int, num: int, den: int) -> int:
    """Least overlap with any set that reaches the threshold."""
    return -(-n * num // den)


def prefix_keys(s: np.ndarray, c: np.ndarray, frequent: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set and the place of each in the set's order (of the first frequent one for combinations); c: frequencies."""
    order = np.argsort(c, kind="stable")
    n = len(s)
    p = n - need(n, num, den) + 1
    head, hc = s[order[:p]], c[order[:p]]
    alone, rare = (int(np.searchsorted(hc, x, "right")) for x in (1, frequent))
    keys, place = [head[alone:rare]], [np.arange(alone, rare)]
    low, high = need(n, num, den).bit_length() - 1, (n * den // num).bit_length() - 1
    for level in range(low, high + 1):
        m = max(1, (1 << level) * (den - num) // den)
        ext = order[: min(n, p + m)]
        f = s[ext[c[ext] > frequent]]
        if len(f) < 2:
            if len(f) == 1 and n == 1:
                keys.append(f)
                place.append(np.zeros(1, np.int64))
            continue
        cls = mix(f) % np.uint64(m)
        o = np.lexsort((f, cls))
        f, cls = f[o], cls[o]
        for d in range(1, len(f)):
            same = cls[d:] == cls[:-d]
            if not same.any():
                break
            keys.append(mix(f[:-d][same] * np.uint64(0x9E3779B97F4A7C15) + f[d:][same] + np.uint64(level)))
            place.append(np.full(int(same.sum()), int((c <= frequent).sum())))  # all that a pair shares is frequent then
    return np.concatenate(keys), np.concatenate(place)


def _index(k: int, num: int, den: int, n_parts: int, frequent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for block, chosen, told in zip(*(rb[c].to_pylist() for c in ("block", "chosen", "told")), strict=True):
                sets = _chosen(block, sorted(chosen), k)
                g = Grams(sets, n_parts)
                told = {x["part"]: unzip_arrays(x["block"], np.uint8)[0] for x in told}
                freq = np.zeros(len(g.key), np.uint8)
                for i, x in g.parts:
                    freq[x] = told[i]
                ends = np.cumsum([len(s) for s in sets])
                told = np.split(freq[g.at], ends[:-1])
                rows = [(s, prefix_keys(s, c, frequent, num, den)) for s, c in zip(sets, told, strict=True)]
                n = [len(x[1][0]) for x in rows]
                yield pa.record_batch({
                    "key": np.concatenate([x[1][0] for x in rows]).view(np.int64), "sig": np.repeat(np.array([signature(s) for s in sets], np.int64), n),
                    "n": np.repeat(np.array([len(s) for s in sets], np.int32), n), "place": np.concatenate([x[1][1] for x in rows]).astype(np.int32),
                    "rank": np.repeat(np.array([10_000 * c.mean() for c in told], np.int32), n),
                })

    return run


def _members(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for block, chosen in zip(rb["block"].to_pylist(), rb["chosen"].to_pylist(), strict=True):
                sets = _chosen(block, sorted(chosen), k)
                yield pa.record_batch({"sig": pa.array([signature(s) for s in sets], pa.int64()), "s": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _verify(num: int, den: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b["sa"], b["sb"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.record_batch({"a": b["a"], "b": b["b"], "ok": ok})

    return run


def meetings(part: DataFrame, marks: DataFrame, fits: Column, alike: Column) -> DataFrame:
    """Pairs (a, b, la, lb) of nodes of different components that share a key and pass the bounds, with their labels; part: key, sig, n, place, label.

    Two near copies share most of their keys, and are to be a row at one of them only: the first in the order of places, single keys before
    combinations, where the bound by places holds. A node takes along, of its LOW first keys and its LOW first combinations, those before
    the one it is at; two nodes that have one of them in common have met there or before. What stands in no such list suppresses
    nothing, so every pair is made at the first key that it shares, and seldom again.
    """
    mixed = part.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many")).filter("lo <> hi")
    # a key's nodes are dealt in blocks, and each two blocks meet in a task of their own
    mixed = mixed.select("key", F.ceil(F.col("many") / KEY_ROWS).cast("int").alias("blocks"))
    here = stored(part.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("sig"), "blocks").cast("int")), "meeting")
    keys = here.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("k"), F.max("place").alias("top"))  # combinations of a node have one place, the last
    low = keys.select("sig", F.array_union(F.slice("k", 1, LOW), F.slice(F.filter("k", lambda x: x["place"] == F.col("top")), 1, LOW)).alias("low"))
    some = here.join(low, "sig").join(marks, "sig").withColumn("low", F.transform(F.filter("low", lambda x: x < F.struct("place", "key")), lambda x: x["key"]))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = some.select("key", F.col("sig").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("label").alias("la"), F.col("mark").alias("ma"), F.col("low").alias("wa"), F.col("block").alias("i"), every.alias("j"))
    y = some.select("key", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("label").alias("lb"), F.col("mark").alias("mb"), F.col("low").alias("wb"), F.col("block").alias("j"), every.alias("i"))
    # the bounds are part of the join, so what cannot link is never a row
    first = ~F.arrays_overlap("wa", "wb")
    return x.join(y, ["key", "i", "j"]).filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & fits & first & alike).select("a", "b", "la", "lb")


def hubs(index: DataFrame) -> DataFrame:
    """Rows (key, many, a, na, pa): how many nodes each key of two or more has, and the one of the highest rank.

    One order holds for all keys, so of a group of near copies few nodes are hubs, and of two nodes always the same one.
    """
    top = index.groupBy("key").agg(F.max(F.struct("rank", "sig", "n", "place")).alias("c"), F.count("*").alias("many")).filter("many > 1")
    return top.select("key", "many", F.col("c.sig").alias("a"), F.col("c.n").alias("na"), F.col("c.place").alias("pa"))


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, frequent: int = FREQUENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, n_links): links are pairs of sets with |a & b| * den >= num * |a | b|.

    n_links counts the verified links of the document's set; links within a component that
    others already imply are not all looked for.
    """
    spark: SparkSession = lean(docs.sparkSession)
    own = docs.select("doc_id", "text")
    kind = dict(own.dtypes)["doc_id"]
    width = shuffle_width(spark)
    fields = f"doc_id:{kind},n:long,sig:long,mark:array<long>"
    units = bucketed(own.mapInArrow(_units(k), f"batch long, block binary, rows array<struct<{fields}>>"), "batch", width)
    n_parts = max(width, units.count() // 4)
    base = units.select("batch", F.posexplode("rows").alias("row", "r")).select("batch", "row", "r.*")
    nodes = base.filter("sig is not null").groupBy("sig").agg(
        F.min("doc_id").alias("d"), F.max("n").alias("n"), F.min(F.struct("batch", "row")).alias("at"), F.any_value("mark").alias("mark")
    )
    nodes = stored(nodes, "nodes")
    sigs = stored(base.select("doc_id", "n", "sig"), "sigs")

    def chosen(some: DataFrame) -> DataFrame:
        """Units with the rows that represent some nodes."""
        rows = some.select("at.batch", "at.row").groupBy("batch").agg(F.collect_list("row").alias("chosen"))
        return units.select("batch", "block").join(rows, "batch")

    sent = chosen(nodes).mapInArrow(_send(k, n_parts), "part int, batch long, block binary")
    told = stored(sent.groupBy("part").applyInArrow(_frequencies, "part int, batch long, block binary"), "frequencies")
    release(spark)
    told_of = told.groupBy("batch").agg(F.collect_list(F.struct("part", "block")).alias("told"))
    index = chosen(nodes).join(told_of, "batch").mapInArrow(_index(k, num, den, n_parts, frequent), "key long, sig long, n int, place int, rank int")
    index = stored(index.groupBy("key", "sig").agg(F.min("n").alias("n"), F.min("place").alias("place"), F.max("rank").alias("rank")), "index")
    forget(told)

    fits = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    total = F.col("na") + F.col("nb")
    fits = fits & ((den + num) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= num * total)
    alike = (den + num) * (total - differ(F.col("ma"), F.col("mb"))) >= 2 * num * total
    marks = lambda x: nodes.select(F.col("sig").alias(x), F.col("mark").alias(f"m{x}"))

    star = index.select("key", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb")).join(hubs(index), "key").filter((F.col("a") != F.col("b")) & fits)
    star = star.select("a", "b", "na", "nb").distinct().join(marks("a"), "a").join(marks("b"), "b").filter(alike)
    star = stored(star.select("a", "b"), "pairs")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that reach the threshold; only sets of nodes in pairs are gathered."""
        ids = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
        sets = stored(chosen(ids.join(nodes, "sig")).mapInArrow(_members(k), "sig long, s binary"), "members")
        p = pairs.join(sets.select(F.col("sig").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("sig").alias("b"), F.col("s").alias("sb")), "b")
        out = stored(p.select("a", "b", "sa", "sb").mapInArrow(_verify(num, den), "a long, b long, ok boolean").filter("ok").select("a", "b").distinct(), "verified")
        forget(sets)
        return out

    links = linked(star)
    label = components(links)
    part = index.drop("rank").join(label.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    part = stored(part, "labelled")
    rest = stored(meetings(part, nodes.select("sig", "mark"), fits, alike).distinct(), "pairs")
    if not rest.isEmpty():
        more = linked(rest.select("a", "b"))
        links = links.unionByName(more)
        # the new links join components, each two of them once: labels are joined to labels, and nodes follow
        over = components(more.join(rest, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        own = label.unionByName(over.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
        label = stored(own.join(over.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")

    ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("sig")).agg(F.count("*").alias("n_links"))
    node = nodes.join(label.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig")).join(ends, "sig", "left")
    least = node.groupBy("label").agg(F.min("d").alias("component_id"))
    node = stored(node.join(least, "label").select("sig", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    forget(units, nodes, index, part)
    out = sigs.join(node, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id (null last); rows without words stay.

    Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, are judged each by its own text.
    """
    own = docs.select(F.col("doc_id").alias("_own"), F.col("doc_id").cast("string").alias("doc_id"), "text").withColumn("_key", row_key("doc_id", "text"))
    c = jaccard_components(own.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    first = c.join(own.select("_key", "_own").distinct(), "_key").groupBy("component_id").agg(F.min(F.struct(F.col("_own").isNull().alias("none"), "_own", "_key")).alias("f"))
    kept = stored(first.select(F.col("f._key").alias("_kept")), "kept")
    release(docs.sparkSession)
    keyed = docs.withColumn("_keep_id", F.col("doc_id").cast("string")).withColumn("_keep_key", row_key("_keep_id", "text"))
    return keyed.join(kept, F.col("_keep_key") == F.col("_kept"), "left_semi").dropDuplicates(["_keep_key"]).select(*docs.columns)


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""

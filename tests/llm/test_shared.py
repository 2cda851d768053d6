"""Shared turns, spelling variants and shared lines against brute force and hard cases, on small inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlark.llm import lines, trie, variants

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, source string"


@pytest.fixture
def many_ranges(spark):
    """So many partitions that groups cross them."""
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


# conversations


def conversations():
    r = random.Random(5)
    rows = []
    for c in range(140):
        if c in (17, 40):  # 40: no conversation to begin with for 41 to 59
            continue
        common = [("system", "You are kind."), ("user", "Hi  there\tall")]
        n = r.choice([1, 1, 2, 3, 5])
        turns = common[: r.randint(0, 2)] + [(r.choice(["user", None]), r.choice(["a b", "c", "", None, "d e f g"])) for _ in range(n)]
        turns = common if c % 3 == 0 else turns
        rows += [(c, None if k == 0 and c % 4 else k, role, text) for k, (role, text) in enumerate(turns)]
    rows += [(7, k + 50, "user", f"turn {k % 3}") for k in range(300)]
    rows += [(None, 1, "user", "no conversation"), (5, 9, "user", "twice"), (5, 9, "user", "twice")]
    r.shuffle(rows)
    return rows


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((-1 if turn is None else turn, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(t)] for c, t in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def trie_by_definition(convs):
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def nodes(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("block_rows", [1, 4, 1 << 15])
def test_trie_by_definition(spark, many_ranges, block_rows):
    rows = conversations()
    want = trie_by_definition(rebuilt(rows))
    d = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("id", "key", "words", "part", "depth")}).repartition(5)
    got = nodes(trie.prefix_trie(trie.with_shared_start(trie.sequences(d)), block_rows, 3))
    assert got == want
    assert sum(want.values()) > 300


def test_trie_empty_and_one(spark):
    assert trie.prefix_trie(trie.with_shared_start(trie.sequences(spark.createDataFrame([], TURNS)))).isEmpty()
    one = spark.createDataFrame([(3, 1, None, None)], TURNS)  # crc32("3") % 4 turns give way to conversation 0, which is absent
    assert nodes(trie.prefix_trie(trie.with_shared_start(trie.sequences(one)))) == trie_by_definition(rebuilt([(3, 1, None, None)]))


def test_extents():
    r = np.random.default_rng(1)
    v = r.integers(0, 5, 200)
    v[0] = -1
    at, depth = np.repeat(np.arange(200), 6), np.tile(np.arange(6), 200)
    left, right = trie.extents(trie.sparse_table(v), at, depth)
    for i, d, a, b in zip(at.tolist(), depth.tolist(), left.tolist(), right.tolist(), strict=True):
        lo = hi = i
        while lo > 0 and v[lo] >= d:
            lo -= 1
        while hi + 1 < 200 and v[hi + 1] >= d:
            hi += 1
        assert (a, b) == (lo, hi)
    lo, hi = r.integers(0, 100, 50), r.integers(100, 200, 50)
    assert trie.range_min(trie.sparse_table(v), lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]


# words


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms_by_definition(words, ratio=2):
    out, form = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [n, len(others), form[w], words[form[w]] if form[w] is not None else None]
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w].append(root)
    return out


def test_forms_by_definition(spark, many_ranges):
    r = random.Random(8)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 6))): r.choice([1, 2, 3, 5, 9, 20, 41, 90]) for _ in range(400)} | {"zz" * 5000: 4, "zz" * 5000 + "z": 9, "": 7, "aaaa": 3, "aaaaa": 6, "aaaaaa": 13}
    rows = [(w, n, 1) for w, n in words.items()]
    d = spark.createDataFrame([*rows, (None, 5, 1)], "word string, n long, near int").repartition(3)
    got = {x.word: [x.n, x.n_near, x.form, x.form_n, x.root] for x in variants.spelling_forms(d).collect()}
    want = forms_by_definition(words)
    assert got == want
    assert max(x[1] for x in want.values()) > 5 and any(x[4] != x[2] for w, x in want.items() if x[2])
    pairs = variants.near_words(d).collect()
    assert sorted((x.word, x.near) for x in pairs) == sorted((a, b) for a, b in itertools.permutations(words, 2) if near(a, b))
    assert all((x.n, x.near_n) == (words[x.word], words[x.near]) for x in pairs)


def test_forms_hard_cases(spark):
    assert variants.spelling_forms(spark.createDataFrame([], "word string, n long")).isEmpty()
    rows = [("abcde", 2), ("abcde", 3), ("abcdf", None), ("ab\0cde", 9), ("abcdef", 10)]
    got = {x.word: (x.n, x.n_near, x.form, x.root) for x in variants.spelling_forms(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {"abcde": (5, 2, "abcdef", "abcdef"), "abcdf": (0, 2, "abcdef", "abcdef"), "ab\0cde": (9, 0, None, "ab\0cde"), "abcdef": (10, 2, None, "abcdef")}


def test_vocabulary(spark):
    texts = ["The CATHEDRAL, the cathedral; École ÉCOLE école", None, "", "x" * 300_000 + " cathedral-school schooL_school", "naïve×naïve naïve÷naïve\nnaïve×naïve"]
    rows = [(i, t, "s") for i, t in enumerate(texts * 30)] + [(None, "cathedral école", "s")] * 3
    want = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            want[run[:k] + run[k + 1 :] if h % 7 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    d = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit(1)).repartition(4)
    assert {x.word: x.n for x in variants.vocabulary(d, 5, 3, 7).collect()} == want
    assert variants.vocabulary(spark.createDataFrame([], DOCS)).isEmpty()


# lines


def texts_with_lines():
    r = random.Random(4)
    common = ["Home | About", "  home | about\t", "Copyright ©", "HOME | ABOUT\r", "All rights reserved. É", "", " ", "x"]
    out = []
    for i in range(60):
        own = [f"line {i} {k}" for k in range(r.randint(0, 3))] + [r.choice(common) for _ in range(r.randint(0, 6))]
        r.shuffle(own)
        out.append((None if i % 11 == 0 else i, "\n".join(own), "s"))
    out += [(200, None, "s"), (201, "", "s"), (202, "\n\n", "s"), (203, "y\n" * 5000 + "Home | About", None), (204, "z" * 200_000 + "\nx", None)]
    return out + [out[1], out[1], (5, "x\nfresh", "s"), (None, "Home | About", "s"), (None, "Home | About", "s")]


def lines_by_definition(rows, min_docs, min_chars=1, keep_first=False):
    def key(line):
        return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    ident = {(d, t): hashlib.md5(f"{'-' if d is None else d}:{t or ''}".encode()).digest() for d, t, _ in rows}
    where = defaultdict(set)
    first = {}
    for d, t in sorted(ident, key=lambda x: (x[0] is not None, x[0] or 0, ident[x])):
        for i, x in enumerate((t or "").split("\n")):
            if len(key(x)) >= min_chars:
                where[key(x)].add((d, t))
                first.setdefault(key(x), (d, t, i))
    out = []
    for d, t, _ in rows:
        every = (t or "").split("\n")
        kept = [x for i, x in enumerate(every) if len(where[key(x)]) < min_docs or keep_first and first[key(x)] == (d, t, i)]
        out.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize(("min_docs", "min_chars", "keep_first"), [(10, 1, False), (2, 3, False), (3, 1, True), (1, 1, True)])
def test_lines_by_definition(spark, many_ranges, min_docs, min_chars, keep_first):
    rows = texts_with_lines()
    d = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("key", "doc", "places", "keep", "n_lines")}).repartition(5)
    maps = lines.keep_bitmaps(d, min_docs, min_chars, keep_first)
    out = lines.apply_bitmaps(d, maps)
    assert set(d.columns) <= set(out.columns)
    got = Counter((x.doc_id, x._n_lines, x._n_dropped, x.text or "") for x in out.collect())
    want = lines_by_definition(rows, min_docs, min_chars, keep_first)
    assert got == want
    assert sum(x[2] for x in want) > 20
    for x in maps.collect():
        assert int(lines.bits(x.keep, x.n_lines).sum()) == x.n_lines - x.n_dropped


def test_lines_empty(spark):
    d = spark.createDataFrame([], DOCS)
    assert lines.keep_bitmaps(d).isEmpty() and lines.apply_bitmaps(d, lines.keep_bitmaps(d)).isEmpty()


def test_hot_line_is_spread(spark, many_ranges):
    """A line of a third of all rows is dealt over ranges, and counted over them."""
    rows = [(i, "hot line\n" + f"own {i}" if i % 3 == 0 else f"own {i}\nother {i}", "s") for i in range(3000)]
    d = spark.createDataFrame(rows, DOCS).repartition(4)
    sizes = [
        r.n for r in d.select("doc_id", lines.document().alias("doc"), "text").mapInArrow(lines._lines(1), "key binary, doc_id long, doc binary, places binary")
        .repartitionByRange("key", "doc_id", "doc").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    ]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
    got = lines.keep_bitmaps(d, 1000).agg(F.sum("n_dropped")).first()[0]
    assert got == 1000
    assert lines.keep_bitmaps(d, 1001).agg(F.sum("n_dropped")).first()[0] == 0


def test_stream_holds_few_rows():
    rows = [(b"k" * 16, i, bytes([i % 256, i // 256]), np.array([0], np.int32).tobytes()) for i in range(1000)]
    b = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "doc_id", "doc", "places"])
    out = pa.Table.from_batches(lines._stream(10, False)(iter([b.slice(0, 400), b.slice(400)]))).to_pylist()
    assert sum(x["kind"] == lines.DROPPED for x in out) == 1000 and [x["n"] for x in out if x["kind"] == lines.OPEN] == [1000]

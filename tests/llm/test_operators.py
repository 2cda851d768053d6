"""The training-data operators against brute force, libraries and hard cases, on small inputs."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridlark.llm import blocks, chaining, common, counts, decontaminate, jaccard, langid, licenses, pieces, quality, suffix, warc
from gridlark.llm import sentencepiece as sp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RND = random.Random(3)
WORDS = ["".join(RND.choice("abcdeghilmnorstu") for _ in range(RND.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    long = prose(300, 1)
    w = long.split()
    near = w[:]
    near[50], near[200] = "changed", "words"
    passage = prose(60, 9)
    texts = [
        long, " ".join(near), long, None, "", "   \n\t ", "one two", "one two", "one two three four", prose(120, 2) + "\n" + passage, passage + " " + prose(90, 3), "é😀 日本語 " + prose(30, 4),
        "a " * 100, prose(4000, 5), "x" * 3000, " ".join(reversed(w)), "Released under the MIT License.\n" + prose(40, 6), "Licensed under CC BY-NC 4.0. mit license, MIT License",
    ]
    return [(i, t, "en" if i % 2 else None, "s", len(t) if t else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """Names that the operators use themselves."""
    return docs.withColumns({c: F.lit(1) for c in ("sig", "key", "batch", "block", "ids", "score", "kept", "label", "n")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def dicts(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_suffix_dedup(spark, docs, clashing, empty):
    want = {r[0]: r for r in suffix.brute_force([(r[0], r[1]) for r in corpus()])}
    for d in (docs, clashing):
        out = suffix.remove_repeats(d).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
        assert {r.doc_id: tuple(r) for r in out.collect()} == want
    assert suffix.remove_repeats(empty).isEmpty()
    rows = [(None, "y" * 80, None, None, None), (1, "y" * 80, None, None, None), (1, "y" * 80, None, None, None), (2, "z" + "y" * 60, None, None, None)]
    out = suffix.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in out) == [(-1, 0), (1, 0), (1, 0), (2, 60)]


def test_column_wise():
    words = [b"banana", b"ananas", b"nab", b"a", b"banana"]
    size = np.array([len(w) for w in words])
    bwt, lcp, own, length = suffix.column_wise(np.frombuffer(b"".join(words), np.uint8), size)
    every = sorted(((w[len(w) - k :], i) for i, w in enumerate(words) for k in range(len(w) + 1)), key=lambda x: x[0])
    got = [words[o][len(words[o]) - n :] for o, n in zip(own, length, strict=True)]
    assert got == [x[0] for x in every]
    for a, b, n in zip(got, got[1:], lcp[1:], strict=False):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert all(c == 0 if n == len(words[o]) else c == words[o][len(words[o]) - n - 1] + 1 for c, o, n in zip(bwt, own, length, strict=True))


def jaccard_brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_join(spark, docs, clashing, empty):
    want = jaccard_brute([(r[0], r[1]) for r in corpus()])
    for d in (docs, clashing):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(d).collect()} == want
    assert jaccard.jaccard_components(empty).isEmpty()


def test_jaccard_many_near_copies(spark):
    base = prose(150, 21).split()
    rows = []
    for i in range(160):
        r = random.Random(i)
        w = base[:]
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(3000)}"
        rows.append((i, " ".join(w), None, None, None))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == jaccard_brute([(r[0], r[1]) for r in rows])


def test_jaccard_combinations_find_pairs(spark):
    """With few n-grams rare, combinations of frequent ones must find the pairs; blocks of a key meet each other."""
    base = [prose(90, k).split() for k in (31, 32, 33)]
    rows = []
    for i in range(90):
        r = random.Random(1000 + i)
        w = base[i % 3][:]
        for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = f"edit{r.randrange(3000)}"
        rows.append((i, " ".join(w), None, None, None))
    rows += [(200 + i, " ".join(base[i % 3][:4] if i % 2 else base[i % 3][:2]), None, None, None) for i in range(12)]
    want = jaccard_brute([(r[0], r[1]) for r in rows])
    texts = [r[1].encode() for r in rows]
    sets = jaccard.shingle_sets(*jaccard.tokens(texts), 4)
    kinds, count = np.unique(np.concatenate(list({s.tobytes(): s for s in sets}.values())), return_counts=True)
    for frequent in (1, 4):
        singles = combined = 0
        for s in sets:
            keys, _ = jaccard.prefix_keys(s, count[np.searchsorted(kinds, s)], frequent, 85, 100)
            singles, combined = singles + int(np.isin(keys, s).sum()), combined + int((~np.isin(keys, s)).sum())
        assert combined > 100 and (frequent > 1 or singles < 15)
        block, jaccard.KEY_ROWS = jaccard.KEY_ROWS, 7
        got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), frequent=frequent).collect()
        jaccard.KEY_ROWS = block
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_pairs_meet_once(spark):
    """Nodes that share many keys are a row at the first of them only, where the bound by places holds, and no pair is lost."""
    r = random.Random(5)
    nodes = {}
    for sig in range(-12, 12):
        single = sorted(r.sample(range(150), 30))  # by a common order, places count what lies before
        nodes[sig] = {k: 2 * i for i, k in enumerate(single)} | {1000 + k: 400 for k in r.sample(range(100), r.choice([0, 1, 80]))}
    part = spark.createDataFrame([(k, sig, 500, place, sig % 7) for sig, keys in nodes.items() for k, place in keys.items()], "key long, sig long, n int, place int, label long")
    marks = spark.createDataFrame([(sig, [sig]) for sig in nodes], "sig long, mark array<long>")
    order = {(a, b): min((max(nodes[a][k], nodes[b][k]) for k in nodes[a].keys() & nodes[b].keys()), default=None) for a in nodes for b in nodes if a < b and a % 7 != b % 7}
    block = jaccard.KEY_ROWS
    try:
        for jaccard.KEY_ROWS, most in ((4096, 12), (5, 12), (5, 400)):
            want = sorted(p for p, place in order.items() if place is not None and place <= most)
            assert 20 < len(want) and (most > 12 or len(want) < len(order))
            got = [(x.a, x.b) for x in jaccard.meetings(part, marks, F.greatest("pa", "pb") <= most, F.lit(True)).collect()]
            assert sorted(got) == want
    finally:
        jaccard.KEY_ROWS = block


def test_jaccard_pairs_grow_with_near_copies(spark, monkeypatch):
    """Copies with few edits of one text, of which most do not link with each other, make about as many pairs as there are copies, and lose no link."""
    r = random.Random(11)
    rows = [(1000, " ".join(base := prose(200, 41).split()), "en", "x", 0)]
    for i in range(180):
        w = list(base)
        for at in r.sample(range(5, 190), 1 + i % 4):
            w[at] = f"edit{i}at{at}"
        rows.append((i, " ".join(w), "en", "x", 0))
    made = []

    def stored(df, name):
        out = common.stored(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == jaccard_brute([(x[0], x[1]) for x in rows])
    assert len(made) == 2 and sum(made) <= 2 * len(rows)


def test_jaccard_default_makes_both_kinds():
    """With the default border, the given documents have single keys as well as combinations."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks().cast(pa.binary()).to_pylist()
    sets = list({s.tobytes(): s for s in jaccard.shingle_sets(*jaccard.tokens(texts), 4) if len(s)}.values())
    kinds, count = np.unique(np.concatenate(sets), return_counts=True)
    found = [(np.isin(jaccard.prefix_keys(s, count[np.searchsorted(kinds, s)], jaccard.FREQUENT, 85, 100)[0], s)) for s in sets]
    assert sum(int(x.sum()) for x in found) > 500 and sum(int((~x).sum()) for x in found) > 20


def test_parity_bounds_difference(spark):
    r = np.random.default_rng(1)
    rows = []
    for n in (120, 127, 128, 131, 600):
        for _ in range(10):
            a = np.unique(r.integers(0, 5000, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: r.integers(int(0.8 * len(a)), len(a))], r.integers(0, 5000, n // 12).astype(np.uint64)]))
            rows.append((jaccard.parity(a).tolist(), jaccard.parity(b).tolist(), len(np.setxor1d(a, b))))
    assert len({(len(a), len(b)) for a, b, _ in rows}) > 3
    d = spark.createDataFrame(rows, "a array<long>, b array<long>, d int")
    got = d.select("d", jaccard.differ(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(x.d * 0.5 <= x.x <= x.d for x in got)


def test_quality(spark, docs, clashing, empty):
    out = dicts(quality.quality(clashing))
    for i, t, *_ in corpus():
        w = (t or "").encode().split()
        seen, lines = set(), 0
        for line in (t or "").encode().split(b"\n"):
            lines += bool(line.split()) and line in seen
            seen.add(line)
        grams = {}
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), []).append(k)
        marked = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(8)}
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), lines, len(marked))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(marked) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(empty).isEmpty()


def perplexities_by_definition(rows):
    """{id: (log perplexity, that of the lower order)} of rows (id, text, lang), each given all others, one count at a time."""
    from collections import Counter

    from gridlark.llm.wordmodel import discounts

    out = {}
    for lang in {r[2] or "und" for r in rows}:
        docs = {r[0]: (r[1] or "").split() for r in rows if (r[2] or "und") == lang}
        has = Counter(w for d in docs.values() for w in set(d))
        seq = {i: [None] + [w if has[w] > 1 else "" for w in d] for i, d in docs.items()}
        pairs = {i: Counter(zip(s, s[1:], strict=False)) for i, s in seq.items()}
        total = sum(pairs.values(), Counter())
        kinds = Counter(b for _, b in total)
        disc = discounts([sum(c == i for c in total.values()) for i in (1, 2, 3, 4)])
        low_disc = discounts([sum(c == i for c in kinds.values()) for i in (1, 2, 3, 4)])
        spare = sum(low_disc[min(c, 3)] for c in kinds.values())
        rare = 1 + sum(c == 1 for c in has.values())
        for i, own in pairs.items():
            left = total - own
            k = Counter(b for _, b in left)
            logs, lows = [], []
            for a, b in zip(seq[i], seq[i][1:], strict=False):
                part = 1 if b else 1 / rare
                low = (max(k[b] - low_disc[min(k[b], 3)], 0) + spare / len(kinds)) / len(left) * part if left else 0
                of = {y: c for (x, y), c in left.items() if x == a}
                n = sum(of.values())
                c = of.get(b, 0)
                p = (max(c - disc[min(c, 3)], 0) * part + sum(disc[min(v, 3)] for v in of.values()) * low) / n if n else low
                logs.append(p)
                lows.append(low)
            out[i] = tuple(-np.mean(np.log(x)) if x and min(x) > 0 else None for x in (logs, lows))
    return out


def junk_and_prose():
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(WORDS[:60]) if r.random() < 0.7 else r.choice(WORDS) for _ in range(60 + i)), "en" if i % 3 else None, None, None) for i in range(60)]
    strange = " ".join("".join(r.choice("qxzkvj%$") for _ in range(7)) for _ in range(60))
    return [*rows, (60, strange, "en", None, None), (61, rows[4][1], "en", None, None), (62, rows[4][1], "en", None, None), (None, rows[7][1], "en", None, None), (64, "too short", "en", None, None), (65, None, "en", None, None), (66, prose(50, 77), "xx", None, None)]


def test_perplexity_by_definition(spark):
    rows = [r for r in junk_and_prose() if r[0] is not None]
    got = dicts(quality.quality(spark.createDataFrame(rows, DOCS).repartition(5)))
    passed = [r for r in rows if not got[r[0]]["base_failed"]]
    want = perplexities_by_definition([r[:3] for r in passed])
    for i, (p, low) in want.items():
        assert got[i]["log_perplexity"] == (None if p is None else pytest.approx(p, abs=2e-6)), i
        assert got[i]["word_log_perplexity"] == (None if low is None else pytest.approx(low, abs=2e-6)), i
    for lang in ("en", "und", "xx"):
        own = [r[0] for r in passed if (r[2] or "und") == lang]

        def quartile(k, column, own=own):
            v = sorted(round(got[i][column], 3) for i in own if got[i][column] is not None)
            return v[max(0, -(-k * len(v) // 4) - 1)] if v else np.nan

        a, b, c = (quartile(k, "word_log_perplexity") for k in (1, 2, 3))
        p2, p3 = (quartile(k, "log_perplexity") for k in (2, 3))
        for i in own:
            n, p, low = got[i]["n_words"], got[i]["log_perplexity"], got[i]["word_log_perplexity"]
            inside = p is None or (p <= p2 + 4 * (p3 - p2) + 4 / n**0.5 and a - 1.75 * (c - a) - 1.5 / n**0.5 <= low <= c + 2 * (c - a) + 3 / n**0.5)
            assert got[i]["kept"] == inside, i
    assert not got[60]["kept"] and got[4]["kept"] and got[61]["kept"] and got[66]["kept"]
    assert not got[64]["kept"] and not got[65]["kept"]


def test_language_id(spark, docs, empty):
    de = [(100 + i, "der die das und ist nicht mit schönen Häusern über Straßen Nummer " + str(i), "de", None, None) for i in range(12)]
    en = [(200 + i, "the and that with house streets over number which would have been " + str(i), "en", None, None) for i in range(12)]
    rows = [*de, *en, (300, None, "de", None, None), (301, "12 34 !?", "en", None, None), (302, "Straßen und Häuser", None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    out = dicts(langid.identify(d, d.filter(~langid.held_out())))
    assert all(out[i]["lang_pred"] == lang for i, _, lang, *_ in [*de, *en])
    assert (out[300]["lang_pred"], out[300]["score"], out[301]["lang_pred"], out[302]["lang_pred"]) == ("und", 0.0, "und", "de")
    held = dicts(d.select("doc_id", langid.held_out().alias("h")))
    assert all(held[i]["h"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in held)
    assert {r["lang_pred"] for r in dicts(langid.identify(docs, empty)).values()} == {"und"}
    assert langid.identify(empty, d).isEmpty()


def test_language_id_by_definition(spark):
    texts = {0: "Banane und Ananas", 1: "the banana", 2: "x", 3: None, 4: "la banane et les ananas"}
    learn = {"de": "und der die Banane", "en": "the and of banana", "fr": "la banane et les", "it": "la banana e le"}

    def ranked(text, k):
        c = {}
        for w in text.lower().split():
            s = "\0" + w + "\0"
            for n in (1, 2, 3):
                for i in range(len(s) - n + 1):
                    g = s[i : i + n]
                    if g.strip("\0"):
                        c[g] = c.get(g, 0) + 1
        code = lambda g: next(h for at, h in [langid._grams(np.array([ord(x) for x in g], np.uint32))[len(g) - 1]])[0]
        return sorted(c, key=lambda g: (-c[g], int(code(g))))[:k]

    prof = {x: ranked(t, 40) for x, t in learn.items()}
    train = spark.createDataFrame([(i, t, x, None, None) for i, (x, t) in enumerate(learn.items())], DOCS)
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOCS)
    for at_once in (1, 3, 4000):
        got = dicts(langid.identify(d, train, size=40, doc_size=30, profiles_at_once=at_once))
        for i, t in texts.items():
            own = ranked(t or "", 30)
            far = {x: sum(abs(k - p.index(g)) if g in p else 40 for k, g in enumerate(own)) for x, p in prof.items()}
            want = min(sorted(far), key=far.get) if own else "und"
            assert got[i]["lang_pred"] == want
            assert got[i]["score"] == pytest.approx(1 - far[want] / (40 * len(own)) if own else 0.0)


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "<p>same</p>"), (5, "http://b", "<p>same</p>"), (3, None, "<p>same</p>"), (7, "http://c", None), (8, "http://d", ""), (9, "u\r\nX: y", "ü" * 5000), (None, "n", "only"), (5, "http://b", "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(pages)
    got = {}
    for r in warc.read_archives(archives).collect():
        got.setdefault(r.page_id, []).append((r.payload_bytes, r.record_type, r.refers_to))
        want = {p: (h or "").encode() for p, _, h in rows}[r.page_id]
        import base64

        assert r.payload_digest == base64.b32encode(hashlib.sha1(want).digest()).decode()
        assert r.payload is None or bytes(r.payload) == want
    assert got[1] == got[3] == [(11, "revisit", 5)] and got[5] == [(11, "response", None)] * 2
    assert got[7] == [(0, "revisit", 8)] and got[8] == [(0, "response", None)] and got[None] == [(4, "response", None)]
    assert all(bytes(a.data[:4]) == b"\x5d\x2a\x4d\x18" for a in archives.collect())
    assert warc.read_archives(warc.write_archives(pages.limit(0))).isEmpty()
    assert all(r.record_type == "response" for r in warc.read_archives(warc.write_archives(pages, min_bytes=100)).collect())
    warc.export_archives(archives, str(tmp_path))
    assert list(tmp_path.glob("*.warc.zst"))


def test_license_scan(spark, docs, clashing, empty):
    out = dicts(licenses.scan(clashing))
    assert (out[16]["n_base"], out[16]["base_labels"], out[16]["first_word"]) == (1, "mit", 3)
    assert (out[17]["n_base"], out[17]["base_labels"], out[17]["last_word"]) == (3, "cc-by,mit", 9)
    assert (out[3]["n_words"], out[3]["first_word"], out[3]["labels"], out[3]["score"]) == (0, None, "", 0.0)
    assert licenses.scan(empty).isEmpty()
    text = prose(100, 8) + " Permission is hereby granted free of charge to any person obtaining a copy of this program and associated files to deal in the Software without any restriction " + prose(50, 7)
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, "mit license mit license", None, None, None)]
    got = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.labels, r.n_base) for r in got) == [("mit", 2), ("mit-notice", 0), ("mit-notice", 0)]


def test_decontamination(spark, docs, clashing, empty):
    items = [(1, "Where does " + prose(20, 31) + "? The answer is " + prose(15, 32)), (2, prose(150, 33)), (3, None), (4, ""), (5, "tiny item"), (6, prose(30, 34))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(200, 41), prose(90, 42) + " " + items[0][1].upper() + " " + prose(300, 43), prose(10, 44) + " " + items[1][1] + " " + prose(70, 45), None, "", prose(70, 46) + " " + " ".join(items[5][1].split()[:8]), "has a tiny item in it"]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(d, bench).collect()}
    assert {(a, b) for a, b, _ in got} == {(1, 1), (2, 2), (6, 5)} and (1, 1, "question and answer") in got
    assert decontaminate.leaks(empty, bench).isEmpty() and decontaminate.leaks(d, bench.limit(0)).isEmpty()
    assert decontaminate.leaks(clashing, bench).isEmpty()
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(d, bench).collect()) == [0, 3, 4, 5]


def test_wand_finds_all():
    r = random.Random(4)
    rows = [(u, 0, t, 1 / 8) for u in range(60) for t in r.sample(range(80), 8)]
    rows = pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["section", "unit", "term", "weight"])
    one = np.arange(60)
    sections = pa.table({"section": one, "item_id": one, "item": one, "size": one * 0 + 8, "question": one * 0, "words": pa.array([np.arange(8).tobytes()] * 60, pa.binary())})
    ix = decontaminate.Index(sections, rows, 0.5)
    for k in range(40):
        q = sorted(random.Random(k).sample(range(len(ix.vocab)), 20))
        want = {}
        for t in q:
            for u, w in zip(*ix.lists[t], strict=True):
                want[u] = want.get(u, 0) + w
        assert sorted(u for u, _ in ix.wand(q, 0.5)) == sorted(u for u, s in want.items() if s >= 0.5 - 1e-9)
        if any(s >= 0.5 for s in want.values()):
            assert ix.passages(np.zeros(len(q), np.int64), np.array(q), np.zeros(1, bool)).tolist() == [0]


def leaks_by_definition(docs, items, least=0.5, overlap=0.5):
    """{(doc, item, kind)} from every passage against every unit, without index, bounds or pruning; items of up to one section."""
    words = {i: decontaminate.words_of(t) for i, t in items}
    units = {(i, k): list(u) for i, w in words.items() if w for k, u in enumerate(np.array_split(np.array(w, object), max(1, -(-len(w) // 64))))}
    df = {}
    for u in units.values():
        for t in set(u):
            df[t] = df.get(t, 0) + 1
    mean = sum(map(len, units.values())) / len(units)
    weight = {}
    for key, u in units.items():
        w = {t: np.log(1 + (len(units) - df[t] + 0.5) / (df[t] + 0.5)) * u.count(t) * 2.2 / (u.count(t) + 1.2 * (0.25 + 0.75 * len(u) / mean)) for t in set(u)}
        weight[key] = {t: x / sum(w.values()) for t, x in w.items()}
    out = {}
    for d, text in docs:
        w = decontaminate.words_of(text)
        for (i, k), u in units.items():
            at = [a for a in range(0, len(w), 64) if sum(x for t, x in weight[i, k].items() if t in set(w[a : a + 128])) >= least - 1e-9]
            if not at:
                continue
            n, m = len(words[i]), 3 if len(words[i]) >= 8 else max(1, len(words[i]))
            grams = lambda x, m=m: {tuple(x[j : j + m]) for j in range(len(x) - m + 1)}
            near = sorted({p for a in at for p in range(max(0, a - n), min(len(w), a + 128 + n))})
            runs = np.split(near, np.flatnonzero(np.diff(near) > 1) + 1)
            have = set().union(*(grams([w[p] for p in x]) for x in runs))
            q, a = decontaminate.split_item(dict(items)[i])
            share = lambda g, have=have: len(g & have) / len(g) if g else None
            both = share(grams(q + a)) or 0.0
            q, a = (both if x is None else x for x in (share(grams(q)), share(grams(a))))
            enough = overlap if n >= 8 else 1.0
            kind = "question and answer" if q >= enough and a >= enough else "part" if both >= enough else "passage" if n > 64 and share(grams(u)) >= 0.8 else None
            if kind:
                out.setdefault((d, i), set()).add(kind)
    return out


def test_decontamination_by_definition(spark):
    r = random.Random(12)
    items = [(i, prose(r.randint(3, 200), 500 + i) + ("? yes " + prose(6, 900 + i) if i % 2 else ". No. ")) for i in range(40)]
    docs = []
    for d in range(60):
        w = prose(r.randint(20, 400), 2000 + d).split()
        for _ in range(r.randint(0, 2)):
            own = items[r.randrange(40)][1].split()
            a = r.randint(0, len(own) // 2) if r.random() < 0.5 else 0
            own = [x if r.random() > 0.05 else "changed" for x in own[a : a + r.randint(3, max(3, len(own)))]]
            k = r.randint(0, len(w))
            w[k:k] = own
        docs.append((d, " ".join(w)))
    want = leaks_by_definition(docs, items)
    assert len(want) > 20 and {k for x in want.values() for k in x} == {"question and answer", "part", "passage"}
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS).repartition(3)
    whole = decontaminate.SHARD_WORDS
    for shard_words in (whole, 900):  # one shard, and several
        decontaminate.SHARD_WORDS = shard_words
        got = decontaminate.leaks(frame, bench).collect()
        decontaminate.SHARD_WORDS = whole
        assert {(x.doc_id, x.item_id) for x in got} == set(want) and len(got) == len(want)
        assert all(x.kind in want[x.doc_id, x.item_id] for x in got)


def test_long_items(spark):
    """Items of several sections; the last sentence is the answer at any length."""
    body = " ".join(prose(9, 3000 + i) + "." for i in range(1500))
    q, a = decontaminate.split_item(body)
    assert len(a) == 9 and len(q) == 1499 * 9
    bench = spark.createDataFrame([(1, body), (2, "x" * 3_000_000 + " " + prose(30, 5))], "item_id long, text string")
    w = body.split()
    texts = [prose(50, 1), " ".join(w[6000:11000]), " ".join(w[40:140]), " ".join(w[100:130]), prose(40, 6) + " " + prose(30, 5)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS), bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 2)}


@pytest.mark.parametrize("shard_words", [decontaminate.SHARD_WORDS, 4096])
def test_long_items_are_judged_as_a_whole(spark, shard_words, monkeypatch):
    """One row for each document and item, however many sections and shards the item has; the answer counts only where it is found."""
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    question = prose(9000, 71) + "?"
    answer = prose(400, 72)
    long = prose(20_000, 73)
    bench = spark.createDataFrame([(1, question + " " + answer), (2, long)], "item_id long, text string")
    q = question.split()
    texts = [" ".join(q[:5000]), question, question + " " + answer, answer, long, prose(80, 74), " ".join(q[:5000])]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {}
    for r in decontaminate.leaks(spark.createDataFrame(rows, DOCS), bench).collect():
        assert (r.doc_id, r.item_id) not in got
        got[r.doc_id, r.item_id] = r
    assert {k: r.kind for k, r in got.items()} == {(0, 1): "part", (1, 1): "part", (2, 1): "question and answer", (3, 1): "passage", (4, 2): "question and answer", (6, 1): "part"}
    assert got[0, 1].answer_overlap == 0 and 0.5 < got[0, 1].question_overlap < 0.6 and got[1, 1].question_overlap > 0.99 and got[3, 1].question_overlap == 0


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    data = open(pieces.default_model(), "rb").read()
    k = data.rindex(b"tok_v0") + 6
    unigram = data[:k] + b"\x18\x01" + data[k + 2 :] if data[k : k + 2] == b"\x18\x02" else None
    return data, sentencepiece.SentencePieceProcessor(model_proto=data), unigram and sentencepiece.SentencePieceProcessor(model_proto=unigram)


HARD = ["", " ", "     ", "  a  b ", "a\n\n  b", "▁x ▁▁", "é😀  😀", "日本語 テキスト", "x" * 500 + " y", "aaaa aaa aa", "\t tab", " " * 40 + "b" + " " * 20, "<s> </s> <0x0A>"]


def test_sentencepiece(spark, docs, empty, library):
    data, lib, _ = library
    t = sp.tokenizer(data)
    texts = HARD + [r[1] or "" for r in corpus()]
    ids, n = t.encode(texts)
    cut = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == lib.encode(texts, num_threads=1)
    assert t.decode(ids, n) == lib.decode(lib.encode(texts))
    out = dicts(sp.decode(sp.encode(docs)))
    assert all(out[i]["decoded"] == (x or "") for i, x, *_ in corpus())
    assert sp.decode(sp.encode(empty)).isEmpty() and sp.encode_decode(empty).isEmpty()
    assert {i: r["ids"] for i, r in dicts(sp.encode_decode(docs)).items()} == {i: r["ids"] for i, r in out.items()}


def count_by_definition(text, score, unknown):
    """Pieces of the best path over the whole text, place by place: the rule that counts.py states."""
    s = (pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else ""
    best, longest = [(0.0, 0)] + [None] * len(s), max(map(len, score))
    for a in range(len(s)):
        for e in range(a + 1, min(len(s), a + longest) + 1):
            x = score.get(s[a:e])
            n = 1
            if x is None and e == a + 1:
                x, n = unknown, len(s[a:e].encode())
            if x is not None and (best[e] is None or best[a][0] + x > best[e][0]):
                best[e] = best[a][0] + x, best[a][1] + n
    return best[-1][1]


def test_token_counts(spark, docs, empty):
    """Whole texts against the rule by definition, and against a library that reads each text as one sentence."""
    data = open(pieces.default_model(), "rb").read()
    c, v = counts.counter(data), pieces.read_pieces(data)
    normal = np.flatnonzero(v.kind == pieces.NORMAL).tolist()
    score = {v.text[i]: float(v.score[i]) for i in normal}
    cjk = "吾輩は猫である。名前はまだ無い。" * 400
    texts = [*HARD, *[(r[1] or "")[:2000] for r in corpus()], cjk[:1500], "a\tb\nc  d\u00a0e " * 20]
    assert c.texts(texts).tolist() == [count_by_definition(t, score, min(score.values()) - 10) for t in texts]
    tokenizers = pytest.importorskip("tokenizers")
    vocab = [("<unk>", 0.0), *score.items(), *((v.text[i], 0.0) for i in np.flatnonzero(v.kind == pieces.BYTE).tolist())]
    lib = tokenizers.Tokenizer(tokenizers.models.Unigram(vocab, 0, True))
    whole = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    r = random.Random(2)
    words = [w for t in whole[:50] for w in (t or "").split()]
    million = " ".join(r.choice(words) for _ in range(180_000))
    texts = [t for t in [*whole, *HARD, *[r[1] for r in corpus()], cjk, "".join(words[:20_000]), million] if t and "<" not in t]
    want = [len(lib.encode(pieces.SPACE + t.replace(" ", pieces.SPACE), add_special_tokens=False).ids) for t in texts]
    assert len(texts) > 900 and c.texts(texts).tolist() == want
    out = dicts(counts.count_tokens(docs))
    assert out[3]["n_tokens"] == out[4]["n_tokens"] == 0
    assert counts.count_tokens(empty).isEmpty()


def test_decode_of_any_ids(spark):
    rows = [(1, [5000, None, 600, 99_999_999, -7, 700]), (2, None), (3, []), (4, [800])]
    out = dicts(sp.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")))
    t = sp.tokenizer(open(pieces.default_model(), "rb").read())
    for i, ids in rows:
        ids = np.array([x for x in ids or [] if x is not None and 0 <= x < 32_000], np.int64)
        assert out[i]["decoded"] == t.decode(ids, np.array([len(ids)]))[0]


def test_long_words(library):
    data, lib, _ = library
    t = sp.tokenizer(data)
    r = random.Random(3)
    texts = ["吾輩は猫である。名前はまだ無い。" * 700, "".join(r.choice(WORDS) for _ in range(3000)), "x" * 20_000, "ab" * 150 + " " + "é" * 199 + " " + "é" * 201]
    ids, n = t.encode(texts)
    cut = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == lib.encode(texts, num_threads=1)
    with pytest.raises(ValueError):
        pieces.check_model(data[: data.rindex(b"tok_v0") + 6] + b"\x18\x01" + data[data.rindex(b"tok_v0") + 8 :])


def test_fuzzy_repeats(spark, docs, clashing, empty):
    out = [r.asDict() for r in chaining.fuzzy_repeats(clashing).collect()]
    pairs = {(r["doc_id"], r["ref_doc_id"]) for r in out}
    assert {(1, 0), (2, 0), (10, 9)} <= pairs and all(a > b for a, b in pairs)
    assert not {3, 4, 5, 6, 7, 13, 15} & {r["doc_id"] for r in out}
    near = next(r for r in out if r["doc_id"] == 1)
    assert (near["first_word"], near["last_word"]) == (0, 299) and near["identity"] == pytest.approx(298 / 300)
    assert chaining.fuzzy_repeats(empty).isEmpty()


def chain_brute(p, q, n):
    best = [0.0] * len(p)
    for i in sorted(range(len(p)), key=lambda i: p[i]):
        best[i] = n[i] + max([0.0] + [best[j] - chaining.GAP * (p[i] - p[j] - n[j] + q[i] - q[j] - n[j]) for j in range(len(p)) if p[j] + n[j] <= p[i] and q[j] + n[j] <= q[i]])
    return max(best)


def test_chains_are_best():
    for seed in range(30):
        r = random.Random(seed)
        m = r.randint(2, 12)
        p, q, n = (np.array([r.randint(lo, hi) for _ in range(m)]) for lo, hi in ((0, 120), (0, 120), (5, 15)))
        top = chaining.chains(p, q, n)[0]
        score = sum(n[top]) - sum(chaining.GAP * (p[b] - p[a] - n[a] + q[b] - q[a] - n[a]) for a, b in zip(top, top[1:], strict=False))
        assert score == pytest.approx(chain_brute(p, q, n))


def kept_by_definition(rows):
    """Ids of rows (id, text, lang) that the quality rules keep."""

    def failed(text):
        w = (text or "").split()
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        again = {k + j for x in at.values() if len(x) > 1 for k in x for j in range(8)}
        return len(w) < 20 or 100 * len(again) > 30 * len(w)

    passed = [r for r in rows if not failed(r[1])]
    score = perplexities_by_definition(passed)
    out = set()
    for lang in {r[2] or "und" for r in passed}:
        own = [r for r in passed if (r[2] or "und") == lang]

        def quartile(k, i, own=own):
            v = sorted(round(round(score[r[0]][i], 6), 3) for r in own if score[r[0]][i] is not None)
            return v[max(0, -(-k * len(v) // 4) - 1)] if v else np.nan

        q1, q2, q3 = ([quartile(k, i) for i in (0, 1)] for k in (1, 2, 3))
        for i, text, _ in own:
            n, (p, low) = len(text.split()) ** -0.5, score[i]
            if p is None or p <= q2[0] + 4 * (q3[0] - q2[0]) + 4 * n and q1[1] - 1.75 * (q3[1] - q1[1]) - 1.5 * n <= low <= q3[1] + 2 * (q3[1] - q1[1]) + 3 * n:
                out.add(i)
    return out


def test_pipeline_by_definition(spark, tmp_path, library):
    """The whole pipeline against each stage by its definition, one after another."""
    import corpus_pipeline

    r = random.Random(23)
    passage, item = prose(45, 4000), prose(40, 4001)
    texts = {i: prose(60 + i % 40, 5000 + i) for i in range(60)}
    texts[10] += "\n" + passage
    texts[20] = passage + " é " + texts[20]
    texts[21] = texts[5] + " more"
    texts[22] = texts[6]
    texts[30] += " " + item
    texts |= {70: " ".join("".join(r.choice("qxzkvj%$") for _ in range(7)) for _ in range(60)), 71: None, 72: "too short", 73: "again and again " * 30}
    rows = [(i, t, "en" if i % 4 else None, "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: (x.n_pieces, x.ids, x.decoded_sha256, x.round_trip) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    docs = {i: texts[i] for i in kept_by_definition([x[:3] for x in rows])}
    group = jaccard_brute(docs.items())
    docs = {i: t for i, t in docs.items() if group[i][1] == i}
    least = {}
    for i, t in docs.items():
        b = t.encode()
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(i, least.get(b[k : k + 50], i))
    for i, t in list(docs.items()):
        b = t.encode()
        gone = {k + j for k in range(len(b) - 49) if least[b[k : k + 50]] < i for j in range(50)}
        docs[i] = bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore")
    leak = {d for d, _ in leaks_by_definition([(i, t) for i, t in docs.items() if t.strip()], [(1, item)])}
    docs = {i: t for i, t in docs.items() if t.strip() and i not in leak}
    assert len(docs) > 45 and not {21, 22, 30, 70, 71, 72, 73} & docs.keys() and passage not in docs[20]
    _, lib, _ = library
    want = {i: (len(x), " ".join(map(str, x)), hashlib.sha256(t.encode()).hexdigest(), True) for (i, t), x in zip(docs.items(), lib.encode(list(docs.values()), num_threads=1), strict=True)}
    assert got == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    for name, rows, schema in (("documents", corpus(), DOCS), ("benchmark", [(1, prose(40, 6))], "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 0 in ids and not ids & {1, 2, 3, 4, 5, 6, 7, 8, 12, 16}


def test_window_minima():
    for n, w, high in ((500, 31, 5), (500, 31, 1 << 62), (40, 8, 2), (8, 8, 3), (7, 8, 3)):
        h = np.random.default_rng(n + w).integers(0, high, n).astype(np.uint64)
        low, at = common.window_minima(h, w)
        assert list(zip(low.tolist(), at.tolist(), strict=True)) == [(int(h[i : i + w].min()), i + int(h[i : i + w].argmin())) for i in range(n - w + 1)]


def test_suffix_hard_cases(spark):
    """Limits of doc_id, runs of one character, and a passage far inside a very long text."""
    r = random.Random(5)
    line = prose(14, 900)
    rows = [(2**63 - 1, "y" * 70 + prose(20, 1)), (-(2**63), "y" * 60), (None, "y" * 90), (0, "y" * 500 + "z" * 400), (7, "x" * 5000), (3, "x" * 130)]
    rows += [(100 + i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 9))) + line + " ".join(r.choice(WORDS) for _ in range(r.randint(0, 9)))) for i in range(60)]
    want = sorted(suffix.brute_force(rows), key=str)
    out = suffix.remove_repeats(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(4)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert sorted((tuple(x) for x in out.collect()), key=str) == want
    passage = prose(40, 7)[:200]
    long = "".join(r.choice(WORDS) + str(r.randrange(10**9)) for _ in range(1_400_000))
    long = long[:17_500_000] + passage + long[17_500_000:]
    assert len(long) > 18 << 20
    rows = [(1, "a " + passage + " b", None, None, None), (2, long, None, None, None), (3, long[-300:], None, None, None)]
    got = dicts(suffix.remove_repeats(spark.createDataFrame(rows, DOCS)))
    assert (got[2]["n_bytes"], got[2]["n_removed"], got[2]["n_spans"], got[3]["n_removed"]) == (len(long), 200, 1, 300)


def test_longest_stretch():
    r = np.random.default_rng(6)
    for _ in range(200):
        same = r.random(r.integers(1, 40)) < 0.7
        a, e = chaining.longest(same, 0.8)
        every = [(j - i, i) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i:j].mean() >= 0.8]
        assert e - a == max((x for x, _ in every), default=0) and (a == e or same[a:e].mean() >= 0.8)


def repeats_by_definition(own, ref, min_words=40, similarity=0.8):
    """Whether some stretches of min_words words are equal in at least `similarity` of their words, place by place."""
    return any(sum(a == b for a, b in zip(own[i : i + min_words], ref[j : j + min_words], strict=True)) >= similarity * min_words for i in range(len(own) - min_words + 1) for j in range(len(ref) - min_words + 1))


def test_fuzzy_recall(spark):
    """Edits of passages, edits of edits, and passages whose halves stand in other documents, against all pairs compared."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    docs, want = {}, set()
    for k, equal in enumerate([0.8] * 40 + [0.85] * 40 + [0.9] * 40):
        p = some(r.randint(45, 70))
        q = p[:]
        for i in r.sample(range(len(q)), round(len(q) * (1 - equal) * 0.95)):
            q[i] = word()
        docs[2 * k], docs[2 * k + 1] = some(20) + p + some(20), some(25) + q + some(15)
        if repeats_by_definition(docs[2 * k + 1], docs[2 * k]):
            want.add((2 * k + 1, 2 * k))
    base = some(100)
    for i in range(5):  # each an edit of the one before
        docs[1000 + i] = base[:]
        for j in r.sample(range(100), 12):
            base[j] = word()
        if i:
            want.add((1000 + i, 999 + i))
    a, b = some(30), some(30)
    docs |= {2000: some(9) + a + some(9), 2001: some(9) + b + some(9), 2002: some(9) + a + b + some(9), 2003: some(12) + a + b + some(12)}
    want.add((2003, 2002))
    d = spark.createDataFrame([(i, " ".join(w), None, None, None) for i, w in docs.items()], DOCS).repartition(3)
    got = {size: {(x.doc_id, x.ref_doc_id) for x in chaining.fuzzy_repeats(d, group_bytes=size).collect()} for size in (1, chaining.GROUP)}
    assert got[1] == got[chaining.GROUP]
    got = got[1]
    assert {x for x in want if x[0] >= 1000} <= got
    share = lambda low, high: np.mean([x in got for x in want if low <= x[0] < high])
    recall = [share(low, low + 80) for low in (0, 80, 160)]
    print("recall at 0.8, 0.85 and 0.9:", recall, "of", [sum(low <= x[0] < low + 80 for x in want) for low in (0, 80, 160)])
    assert len(want) > 80 and all(x >= y for x, y in zip(recall, (0.9, 0.97, 0.97), strict=True)), recall
    assert all(set(docs[a]) & set(docs[b]) for a, b in got)


def test_stages_judge_rows_without_or_with_repeated_ids(spark):
    a, b, c, p = prose(80, 61), prose(80, 62), prose(80, 63), prose(30, 64)
    near = " ".join([*a.split()[:-1], "changed"])
    frame = lambda rows: spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOCS)
    pairs = lambda df: sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    assert pairs(quality.keep_good(frame([(None, a), (None, "one two"), (5, b), (5, "too short"), (6, c)]))) == sorted([(-1, a), (5, b), (6, c)])
    assert pairs(jaccard.keep_one(frame([(1, a), (5, near), (5, b), (None, a + " x"), (None, c), (None, None)]))) == sorted([(1, a), (5, b), (-1, c), (-1, "")])
    got = pairs(suffix.cut_repeats(frame([(1, p + " " + a), (5, b + " " + p), (5, c), (5, "left " + p), (None, p + " " + b)])))
    assert len(got) == 5 and (5, c) in got and (-1, p + " " + b) in got and p not in "".join(t for i, t in got if i == 5)
    bench = spark.createDataFrame([(1, p)], "item_id long, text string")
    assert pairs(decontaminate.drop_leaks(frame([(None, a + " " + p), (None, a), (7, p + " " + b), (7, b), (8, None)]), bench)) == sorted([(-1, a), (7, b), (8, "")])


def test_shuffled_words_are_rejected(spark):
    """Texts of one chain of words; the last ones have the same words in another order, which the words' letters cannot tell."""
    r = random.Random(8)
    follow = {w: r.sample(WORDS, 3) for w in WORDS}
    texts = []
    for _ in range(60):
        w = [r.choice(WORDS)]
        while len(w) < 120:
            w.append(r.choice(follow[w[-1]]))
        texts.append(w)
    for w in texts[55:]:
        r.shuffle(w)
    texts = [" ".join(w) for w in texts]
    d = spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = dicts(quality.quality(d))
    assert [i for i in got if not got[i]["kept"]] and {i for i in got if not got[i]["kept"]} == set(range(55, 60))


def test_whole_copies_are_left_out_of_the_collection(spark):
    """Copies of whole texts go as a whole and take no part in the search for repeats; a batch that is told nothing cuts its own repeats."""
    a, b, p = prose(80, 71), prose(80, 72), prose(30, 73)
    rows = [(4, a + " " + p), (9, a + " " + p), (2, a + " " + p), (2, a + " " + p), (None, a + " " + p), (1, p + " " + b), (7, "short"), (8, "short"), (3, ""), (5, None), (6, a), (11, b + " new " + a), (10, b + " new " + a)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    fields = lambda r: (r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
    want = sorted((x[0] or -1, *x[1:]) for x in suffix.brute_force(rows))
    assert all(sorted(map(fields, suffix.remove_repeats(d.repartition(n)).collect())) == want for n in (1, 4))
    b1 = suffix.Batch(blocks.zip_arrays(np.array([4, 9], np.int64), np.array([True, True]), np.array([60, 60], np.int64), np.full(120, 65, np.uint8)), [blocks.zip_arrays(np.array([1], np.int32))])
    assert len(b1.text) == 60 and [i for i, _ in b1.copies] == [9]
    # the texts of one batch repeat each other and nothing else
    got = {r.doc_id: r.text for r in suffix.cut_repeats(spark.createDataFrame([(1, p + " " + a, "en", None, None), (2, b + " left " + p, "en", None, None)], DOCS).coalesce(1)).collect()}
    assert got[1] == p + " " + a and p not in got[2] and got[2].startswith(b)

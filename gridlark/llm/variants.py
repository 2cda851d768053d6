"""Spelling variants: words at an edit of one code point, by sorted rotations, and the frequent form of each.

Every word x c y is marked with a terminator and rotated. The rotation y T x c sorts among those with the prefix y T x, which
skips the edited code point c: all words that have another code point there, and, first, the whole rotation y T x of the
word x y that lacks it. So a scan of the sorted rotations sees each range of neighbours once. A range has one row for each code
point of the alphabet at most, whatever the number of words. Of a word that lacks one of a run of like code points only
the first of the run counts, so no pair is seen twice.

Defined results: null texts have no words; a word is near by exactly one inserted, deleted or replaced code point; its form is the
near word of largest count (ties: smallest in code-point order) if that count is at least `ratio` times its own; roots follow forms to
the end, and counts at least double on the way, so the way is short. Words that hold the terminator, U+0000, have no near
words. Repeated rows of a word add up their counts; a null count counts as 0. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import arrow_batches, chunks, forget, stored

LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # after lower-casing: a-z and U+00C0 to U+00FF in UTF-8
END = "\0"
BATCH = 4 << 20
HELD = 400_000  # distinct words that a task counts before it hands them on


def clipped(word: bytes, h: int) -> bytes:
    """The word without its code point h % length."""
    w = word.decode()
    k = h % len(w)
    return (w[:k] + w[k + 1 :]).encode()


def _counts(min_chars: int, cut_every: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(w, n) for w, n in total.items() if len(w) - w.count(b"\xc3") >= min_chars]
            return pa.record_batch([pa.array([w for w, _ in rows], pa.binary()).cast(pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for t in chunks(it, "text", BATCH):
            for doc_id, text in zip(t["doc_id"].to_pylist(), t["text"].cast(pa.binary()).to_pylist(), strict=True):
                own = Counter(LETTERS.findall((text or b"").lower()))
                if cut_every:
                    state = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for w in [w for w in own if not zlib.crc32(w, state) % cut_every]:
                        total[clipped(w, zlib.crc32(w, state))] += own.pop(w)
                total.update(own)
                if len(total) > HELD:
                    yield flush()
                    total.clear()
        yield flush()

    return run


def vocabulary(docs: DataFrame, min_chars: int = 5, min_count: int = 3, cut_every: int = 0) -> DataFrame:
    """Words (word, n) of all texts: maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of at least `min_chars`
    code points and `min_count` occurrences.

    With `cut_every`, a run whose unsigned crc32 of `<doc_id>:<run>` it divides loses the code point crc32 % length first: noise
    whose true form is known. A document's equal runs share that number, so it is taken once for each distinct one.
    """
    words = docs.select("doc_id", "text").mapInArrow(_counts(min_chars, cut_every), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _rotations(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at in range(0, b.num_rows, 4096):
            prefix, edit, count = [], [], []
            for w, n in zip(b["word"][at : at + 4096].to_pylist(), b["n"][at : at + 4096].to_pylist(), strict=True):
                if w is None or END in w:
                    continue
                m = len(w)
                prefix.extend([w[i:] + END + w[:i] for i in range(m + 1)])
                edit.extend([""] * (m + 1))
                prefix.extend([w[i + 1 :] + END + w[:i] for i in range(m)])
                edit.extend(w)
                count.extend([n] * (2 * m + 1))
            yield pa.record_batch([pa.array(prefix, pa.string()), pa.array(edit, pa.string()), pa.array(count, pa.int64())], names=["prefix", "edit", "n"])


def _pairs_of(prefix: str, edits: list[str], counts: list[int]) -> list[tuple[str, int, list[tuple[int, str]]]]:
    """(word, its count, near words by falling count) of one range; the word without the code point, if any, is the first row."""
    y, _, x = prefix.partition(END)
    rows = [(-n, x + c + y, c) for c, n in zip(edits, counts, strict=True)]
    order = sorted(rows)
    skip = prefix[-1]  # what stands before the edited code point: after the same one it is not the first of its run
    return [(w, -n, [(-k, v) for k, v, d in order if d != c and (c or d != skip) and (d or c != skip)]) for n, w, c in rows]


def _scan(pairs: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def ranges(t: pa.Table, whole: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            p = t["prefix"].combine_chunks()
            cut = np.flatnonzero(np.concatenate([[True], pc.not_equal(p.slice(1), p.slice(0, len(p) - 1)).to_numpy(zero_copy_only=False)]))
            ends = np.append(cut[1:], len(p))
            if not whole:
                cut, ends = cut[:-1], ends[:-1]
            last = int(ends[-1]) if len(ends) else 0
            many = np.flatnonzero(ends - cut > 1)
            take = pa.array(np.concatenate([np.arange(cut[i], ends[i]) for i in many]) if len(many) else np.zeros(0, np.int64))
            keys, edits, counts = p.take(pa.array(cut[many])).to_pylist(), t["edit"].take(take).to_pylist(), t["n"].take(take).to_pylist()
            out, at = [], 0
            for key, size in zip(keys, (ends - cut)[many].tolist(), strict=True):
                for w, n, near in _pairs_of(key, edits[at : at + size], counts[at : at + size]):
                    if pairs:
                        out.extend((w, n, 1, k, v) for k, v in near)
                    elif near:
                        out.append((w, n, len(near), *near[0]))
                at += size
            cols = zip(*out, strict=True) if out else [[]] * 5
            kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["word", "n", "n_near", "near_n", "near"]), None if whole else t.slice(last)

        for t in chunks(it, "prefix", 1 << 20):
            t = t if rest is None else pa.concat_tables([rest, t])
            out, rest = ranges(t, False)
            yield out
        if rest is not None and rest.num_rows:
            yield ranges(rest, True)[0]

    return run


def _ranges(words: DataFrame, pairs: bool) -> DataFrame:
    rotations = words.mapInArrow(_rotations, "prefix string, edit string, n long")
    return rotations.repartitionByRange("prefix").sortWithinPartitions("prefix", "edit").mapInArrow(_scan(pairs), "word string, n long, n_near long, near_n long, near string")


def near_words(words: DataFrame) -> DataFrame:
    """All pairs (word, n, near, near_n) of words (word, n) at an edit of one code point, each in both directions."""
    words = stored(words.groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")), "words")
    return _ranges(words, True).select("word", "n", "near", "near_n")


def spelling_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """One row a word of words (word, n): word, n, n_near, form, form_n, root."""
    words = stored(words.filter("word is not null").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")), "words")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))))
    each = none.unionByName(_ranges(words, False)).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= ratio * F.col("n")
    each = stored(each.select("word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
    roots = _roots(each.filter("form is not null").select("word", F.col("form").alias("root")))
    return each.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(links: DataFrame) -> DataFrame:
    """Ends of the ways along links (word, root), by doubling: as many rounds as the logarithm of the longest way."""
    links = stored(links, "roots")
    while True:
        on = links.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = stored(links.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        forget(links)
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return links


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with arrow_batches(spark, 256, "4m"):
        words = stored(vocabulary(docs, min_chars=5, min_count=3, cut_every=97), "vocabulary")
    return spelling_forms(words, ratio=2).select("word", "form", "root", "n", "n_near", "form_n")


# DuckDB has no crc32, so it is spelled out: a list of bytes, each followed by eight shifts
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(hex(encode({0}))) // 2), lambda i:
 [('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)"""

OP12_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {CRC.format("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM d),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, (h % length(run)) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS MATERIALIZED (SELECT word, n, substr(word, 1, i) || '_' || substr(word, i + 2) AS key, i FROM w, unnest(range(0, length(word))) AS t(i)),
s AS MATERIALIZED (SELECT word, n, substr(word, 1, i) || substr(word, i + 2) AS key FROM w, unnest(range(0, length(word))) AS t(i)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
      UNION SELECT s.word, s.n, w.word, w.n FROM s JOIN w ON s.key = w.word UNION SELECT w.word, w.n, s.word, s.n FROM s JOIN w ON s.key = w.word),
b AS (SELECT word, count(*)::BIGINT AS n_near, max(near_n) AS near_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN (SELECT min(near) FROM p WHERE p.word = w.word AND p.near_n = b.near_n) END AS form,
      CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n FROM w LEFT JOIN b USING (word)),
way AS (SELECT word, word AS at FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f JOIN way ON way.word = f.word JOIN f AS e ON e.word = way.at WHERE e.form IS NULL
"""

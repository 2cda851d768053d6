"""Language identification by rank-order profiles.

A language's profile is the ranking of its `size` most frequent character n-grams (one to
three letters of lower-cased words, with word borders) over all training documents. A
document's own ranking of its `doc_size` most frequent n-grams is compared with each profile:
an n-gram adds the distance of its two ranks, one that the profile lacks adds `size`. The
language with the least sum wins; ties go to the language name that sorts first. Equal counts
are ranked by the n-gram's 40-bit hash, in profiles and documents alike.

Defined results: null text and text without letters give `und` with score 0, and so does any
text when there is no training row. Rows with null lang, text or doc_id are not learned from.
Repeated rows give repeated results; an empty table gives an empty table. lang, source and
doc_id play no part in a prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.common import MULT, chunks, lean, mix, ranges, stored

BITS = 40
BATCH = 2 << 20
PROFILES = 4_000  # languages in one broadcast; with 400 n-grams of 16 bytes each that is 26 MB
HELD = 400_000  # distinct words that a task holds, of all languages together
TABLE = 1 << 22  # sums of documents by languages that are held at once


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _points(texts: list[str]) -> np.ndarray:
    """Code points of lower-cased texts, 0 for all that is no letter; texts are set apart by 0."""
    flat = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[flat], flat, np.uint32(0))


def _grams(cp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3 the start places and hashes of n-grams that cross no word border."""
    c = cp.astype(np.uint64)
    z = cp == 0
    top = np.uint64(64 - BITS)
    one = np.flatnonzero(~z)
    two = np.flatnonzero(~(z[:-1] & z[1:]))
    three = np.flatnonzero(~z[1:-1])
    h1 = c[one]
    h2 = c[two] * np.uint64(1 << 21) + c[two + 1] + np.uint64(1 << 50)
    h3 = (c[three] * np.uint64(1 << 21) + c[three + 1]) * np.uint64(1 << 21) + c[three + 2] + np.uint64(1 << 63)
    return [(one, mix(h1 * MULT) >> top), (two, mix(h2 * MULT) >> top), (three, mix(h3 * MULT) >> top)]


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by_lang: dict[str, Counter] = {}

    def flush(lang: str, words: Counter) -> pa.RecordBatch:
        keys = list(words)
        weight = np.fromiter(words.values(), np.int64, len(keys))
        cp = _points([k.lower() for k in keys])
        own = np.searchsorted(np.cumsum(np.fromiter((len(k.lower()) + 1 for k in keys), np.int64, len(keys))), np.arange(len(cp)), "right")
        own = np.minimum(own, len(keys) - 1)
        h, w = [], []
        for at, x in _grams(cp):
            h.append(x)
            # a border before a word belongs to that word
            w.append(weight[own[np.minimum(at + (cp[at] == 0), len(cp) - 1)]])
        u, back = np.unique(np.concatenate(h), return_inverse=True)
        return pa.record_batch({"lang": [lang] * len(u), "gram": u.view(np.int64), "c": np.bincount(back, np.concatenate(w), len(u)).astype(np.int64)})

    held = 0
    for t in chunks(it, "text", BATCH):
        for lang, text in zip(t["lang"].to_pylist(), t["text"].to_pylist(), strict=True):
            if text:
                c = by_lang.setdefault(lang, Counter())
                held -= len(c)
                c.update(text.split())
                held += len(c)
            while held > HELD:
                most = max(by_lang, key=lambda x: len(by_lang[x]))
                held -= len(by_lang[most])
                yield flush(most, by_lang.pop(most))
    for lang, c in by_lang.items():
        if c:
            yield flush(lang, c)


def profiles(train: DataFrame, size: int) -> DataFrame:
    """Rows (lang, gram, rank) with the `size` most frequent n-grams of each language, rank from 0."""
    c = (
        train.filter("text is not null and lang is not null").select("text", "lang")
        .mapInArrow(_count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "gram"))
    return c.withColumn("rank", rank - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """Profiles of some languages: the n-grams in order, and the languages and ranks of each."""

    def __init__(self, langs: list[str], gram: np.ndarray, lang: np.ndarray, rank: np.ndarray):
        order = np.lexsort((lang, gram))
        self.langs, self.lang, self.rank = langs, lang[order].astype(np.int32), rank[order].astype(np.int32)
        self.grams, begin = np.unique(gram[order], return_index=True)
        self.begin = np.append(begin, len(gram))


def nearest(texts: list[str | None], p: Profiles, size: int, doc_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest language of each text, its distance, and how many n-grams the text's ranking has."""
    n = len(texts)
    low = [(t or "").lower() for t in texts]
    cp = _points(low)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, n))
    keys = []
    for at, h in _grams(cp):
        doc = np.searchsorted(ends, at + (cp[at] == 0), "right")
        keys.append((np.minimum(doc, n - 1).astype(np.uint64) << np.uint64(BITS)) | h)
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key))).astype(np.uint64)
    key = key[first]
    doc = (key >> np.uint64(BITS)).astype(np.int64)
    order = np.argsort(((doc.astype(np.uint64) << np.uint64(BITS)) | (np.uint64((1 << BITS) - 1) - count)), kind="stable")
    doc, key = doc[order], key[order]
    begin = np.searchsorted(doc, np.arange(n))
    rank = np.arange(len(doc)) - begin[doc]
    top = rank < doc_size
    doc, key, rank = doc[top], key[top] & np.uint64((1 << BITS) - 1), rank[top]
    i = np.minimum(np.searchsorted(p.grams, key), len(p.grams) - 1)
    hit = np.flatnonzero(p.grams[i] == key)
    total = np.bincount(doc, minlength=n)
    many = p.begin[i[hit] + 1] - p.begin[i[hit]]
    at = ranges(p.begin[i[hit]], many)
    doc, less = np.repeat(doc[hit], many), size - np.abs(p.rank[at] - np.repeat(rank[hit], many))
    lang = p.lang[at]
    # all n-grams at the full distance, less what the profiles' own n-grams are nearer
    m = len(p.langs)
    which, best = np.zeros(n, np.int64), np.full(n, np.inf)
    step = max(1, TABLE // m)
    for a in range(0, n, step):
        b = min(n, a + step)
        x, y = np.searchsorted(doc, (a, b))
        gain = np.bincount((doc[x:y] - a) * m + lang[x:y], less[x:y], (b - a) * m).reshape(b - a, m)
        which[a:b] = gain.argmax(1)  # langs are sorted, so ties stay with the first
        best[a:b] = size * total[a:b] - gain.max(1)
    return which, best, total


def identify(docs: DataFrame, train: DataFrame, size: int = 400, doc_size: int = 300, profiles_at_once: int = PROFILES) -> DataFrame:
    """docs with lang_pred and score; learned from the rows of train.

    Profiles are broadcast in groups of languages, and a text keeps the nearest language of all groups so far, so the
    number of languages has no limit.
    """
    sc = lean(docs.sparkSession).sparkContext
    p = stored(profiles(train, size), "profiles")
    langs = [r.lang for r in p.select("lang").distinct().orderBy("lang").collect()]  # names only, one a language
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text", F.lit("und").alias("lang_pred"), F.lit(float("inf")).alias("best"), F.lit(0).cast("long").alias("total"))
    schema = f"doc_id {kind}, text string, lang_pred string, best double, total long"
    for a in range(0, len(langs), profiles_at_once):
        some = langs[a : a + profiles_at_once]
        rows = p.filter(F.col("lang").between(some[0], some[-1])).toArrow()
        code = {x: i for i, x in enumerate(some)}
        lang = np.fromiter((code[x] for x in rows["lang"].to_pylist()), np.int64, rows.num_rows)
        bc = sc.broadcast(Profiles(some, rows["gram"].to_numpy().view(np.uint64), lang, rows["rank"].to_numpy()))

        def run(it: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pa.RecordBatch]:
            for t in chunks(it, "text", BATCH):
                which, best, total = nearest(t["text"].to_pylist(), bc.value, size, doc_size)
                had = t["best"].to_numpy()
                pred = [bc.value.langs[k] if n and x < y else z for k, n, x, y, z in zip(which.tolist(), total.tolist(), best.tolist(), had.tolist(), t["lang_pred"].to_pylist(), strict=True)]
                yield pa.record_batch({"doc_id": t["doc_id"].combine_chunks(), "text": t["text"].combine_chunks(), "lang_pred": pa.array(pred, pa.string()), "best": np.minimum(best, had), "total": total.astype(np.int64)})

        out = out.mapInArrow(run, schema)
    score = F.when((F.col("total") > 0) & (F.col("best") < float("inf")), 1 - F.col("best") / (size * F.col("total"))).otherwise(0.0)
    return out.select("doc_id", "lang_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

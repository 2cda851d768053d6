"""A word n-gram model of the collection, and each document's perplexity under all other documents.

Modified Kneser-Ney of order two, a model for each language. Texts become units of token numbers once;
then three exchanges, each of which sends a unit's distinct, counted keys to hash partitions, sums them
there in sorted hash arrays without a bound on their number, and answers each unit in its own order:

1. words: which of them more than one document has. The others are the one word RARE, of which the
   model knows how many kinds there are; a word that stands in one document only is unknown to all others.
   Known words get numbers, frequent ones small ones, so pairs of numbers compress well.
2. pairs of words: their counts, and the parts of the words' statistics. Pairs go by their first word,
   those of the most frequent first words by both words, so no word is one task's work.
3. words again: how often each is a context, how many kinds of words follow it once, twice, and more
   often, and how many kinds of words precede it.

A unit takes each document's own counts off before it is scored, so no text vouches for itself; copies
vouch for each other in the pairs, hardly in the lower order. A unit sends no empty blocks but one, so rows
are at most as many as distinct keys of units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.blocks import deal, part_of, unzip_arrays, zip_arrays
from gridlark.llm.common import bucketed, forget, release, shuffle_width, stored

RARE, MARK, FIRST = 0, 1, 2  # the word that one document has; the mark before a text; the first known word
HOT = 8  # in each part, so many of the most frequent words have their pairs dealt by both words
DROPPED = np.uint64(16)  # bits of a word's 64-bit hash that are dropped: 48 tell a billion words apart but for some 3 in a million
UNIT = 2 << 20  # tokens of one language in a unit
AT_ONCE = 1 << 18  # tokens whose own counts are taken off at once, or one document's
SENT = "lang string, part int, batch long, block binary"
COUNTED = "lang string, part int, batch long, kind int, block binary, sums array<long>"
ANSWER, PARTIAL, SUMS = 0, 1, 2


class Units:
    """Tokens of one task, gathered by language; a unit holds about UNIT tokens, or all held of its language."""

    def __init__(self):
        self.part, self.made = TaskContext.get().partitionId(), 0
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray, list]]] = {}
        self.size: dict[str, int] = {}

    def add(self, lang: str, sizes: np.ndarray, words: np.ndarray, rows: list) -> Iterator[tuple]:
        self.held.setdefault(lang, []).append((sizes, words, rows))
        self.size[lang] = self.size.get(lang, 0) + len(words) + len(rows)
        while self.size and (max(self.size.values()) >= UNIT or sum(self.size.values()) >= UNIT + (UNIT >> 1)):
            yield self.take(max(self.size, key=self.size.get))

    def take(self, lang: str) -> tuple:
        """(batch, lang, block, rows); numbers in the block are ranks by frequency in the unit."""
        held = self.held.pop(lang)
        del self.size[lang]
        words, at, n = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        block = zip_arrays(np.concatenate([h[0] for h in held]).astype(np.int64), rank[at], words[order] >> DROPPED)
        self.made += 1
        return self.part << 24 | self.made, lang, block, [r for h in held for r in h[2]]

    def rest(self) -> Iterator[tuple]:
        for lang in list(self.held):
            yield self.take(lang)


class Unit:
    """One unit: its words' hashes, and the word of each token."""

    def __init__(self, block: bytes, n_parts: int):
        self.size, self.token, self.hash = unzip_arrays(block, np.int64, np.uint32, np.uint64)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        by_hash = np.argsort(self.hash)
        self.dealt = [(i, by_hash[k]) for i, k in deal(part_of(self.hash[by_hash], n_parts), n_parts)]
        if len(self.hash) and self.dealt[0][0]:  # the first part is always asked: it keeps RARE and MARK
            self.dealt.insert(0, (0, by_hash[:0]))

    def number(self, answers: dict[int, np.ndarray], n_parts: int) -> None:
        """Numbers of the tokens' words; distinct numbers, and pairs of places among them."""
        ids = np.zeros(len(self.hash), np.uint64)
        for i, k in self.dealt:
            ids[k] = answers[i]
        self.ids = np.unique(np.concatenate([ids, np.array([RARE, MARK], np.uint64)]))
        self.word = np.searchsorted(self.ids, ids)[self.token]
        m = len(self.ids)
        first = (np.cumsum(self.size) - self.size)[self.size > 0]
        self.before = np.concatenate([[0], self.word[:-1]]) if len(self.word) else self.word
        self.before[first] = MARK  # RARE and MARK are the first two numbers
        pair, self.at, self.count = np.unique(self.before * m + self.word, return_inverse=True, return_counts=True)
        self.a, self.b = pair // m, pair % m
        first = self.ids[self.a]
        hot = (first < FIRST) | ((first - np.uint64(FIRST)) // np.uint64(n_parts) < HOT)
        self.pairs = list(deal(part_of(np.where(hot, first * np.uint64(0x9E3779B97F4A7C15) + self.ids[self.b], first), n_parts), n_parts))
        self.words = list(deal(word_part(self.ids, n_parts), n_parts))


def word_part(ids: np.ndarray, n_parts: int) -> np.ndarray:
    return np.where(ids < FIRST, 0, (ids - np.uint64(FIRST)) % np.uint64(n_parts)).astype(np.int64)


def _batch(lang: str, batch: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.record_batch({"lang": pa.array([lang] * n, pa.string()), "part": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([batch] * n, pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})


def _send_words(n_parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for batch, lang, block in zip(rb["batch"].to_pylist(), rb["lang"].to_pylist(), rb["block"].to_pylist(), strict=True):
                u = Unit(block, n_parts)
                m = len(u.hash)
                if not m:
                    continue
                count = np.bincount(u.token, minlength=m)
                low, high = np.full(m, len(u.size)), np.full(m, -1)
                np.minimum.at(low, u.token, u.doc)
                np.maximum.at(high, u.token, u.doc)
                many = low < high
                yield _batch(lang, batch, [(i, zip_arrays(np.diff(u.hash[k], prepend=np.uint64(0)), count[k], many[k])) for i, k in u.dealt])

    return run


def _number(n_parts: int):
    def run(t: pa.Table) -> pa.Table:
        lang, part = t["lang"][0].as_py(), t["part"][0].as_py()
        cols = [unzip_arrays(x, np.uint64, np.int64, np.bool_) for x in t["block"].to_pylist()]
        cols = [(np.cumsum(h, dtype=np.uint64), c, d) for h, c, d in cols]
        word, at = np.unique(np.concatenate([c[0] for c in cols]), return_inverse=True)
        count = np.bincount(at, np.concatenate([c[1] for c in cols])).astype(np.int64)
        known = np.bincount(at, np.concatenate([1 + c[2] for c in cols])) > 1
        order = np.lexsort((word, -count, ~known))[: int(known.sum())]
        ids = np.zeros(len(word), np.uint64)
        ids[order] = FIRST + np.arange(len(order), dtype=np.uint64) * np.uint64(n_parts) + np.uint64(part)
        ends = np.cumsum([len(c[0]) for c in cols])
        blocks = [zip_arrays(ids[x]) for x in np.split(at, ends[:-1])]
        n = len(cols)
        return pa.table({
            "lang": pa.array([lang] * (n + 1)), "part": pa.array([part] * (n + 1), pa.int32()), "batch": pa.array([*t["batch"].to_pylist(), None], pa.int64()),
            "block": pa.array([*blocks, None], pa.binary()), "n_rare": pa.array([None] * n + [int((~known).sum())], pa.int64()),
        })

    return run


def _answers(lists: list[dict], *kinds) -> dict[int, list[np.ndarray]]:
    return {x["part"]: unzip_arrays(x["block"], *kinds) for x in lists}


def _numbered(block: bytes, lists: list[dict], n_parts: int) -> Unit:
    u = Unit(block, n_parts)
    u.number({i: x[0] for i, x in _answers(lists, np.uint64).items()}, n_parts)
    return u


def _steps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs as steps: of a, and of b while a stays."""
    da = np.diff(a, prepend=np.uint64(0))
    return da, np.where(da == 0, np.diff(b, prepend=np.uint64(0)), b)


def _pairs(da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.cumsum(db, dtype=np.uint64)
    new = np.flatnonzero((da != 0) | (np.arange(len(da)) == 0))
    before = np.concatenate([np.zeros(1, np.uint64), total])[new]
    return np.cumsum(da, dtype=np.uint64), total - np.repeat(before, np.diff(np.append(new, len(da))))


def _send_pairs(n_parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for batch, lang, block, lists in zip(*(rb[c].to_pylist() for c in ("batch", "lang", "block", "numbers")), strict=True):
                u = _numbered(block, lists, n_parts)
                a, b = u.ids[u.a], u.ids[u.b]
                yield _batch(lang, batch, [(i, zip_arrays(*_steps(a[k], b[k]), u.count[k])) for i, k in u.pairs])

    return run


def _count_pairs(n_parts: int):
    """Sums of one part's pairs: answers to the units, partial statistics of words, and counts of counts."""

    def run(t: pa.Table) -> pa.Table:
        lang, part = t["lang"][0].as_py(), t["part"][0].as_py()
        cols = [unzip_arrays(x, np.uint64, np.uint64, np.int64) for x in t["block"].to_pylist()]
        both = [_pairs(c[0], c[1]) for c in cols]
        a, b = (np.concatenate([x[i] for x in both]) for i in (0, 1))
        count = np.concatenate([c[2] for c in cols])
        ends = np.cumsum([len(c[0]) for c in cols])
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        total = np.bincount(kind, count).astype(np.int64)
        a, b = a[order[new]], b[order[new]]
        rows = [(part, batch, ANSWER, zip_arrays(total[x]), None) for batch, x in zip(t["batch"].to_pylist(), np.split(kind, ends[:-1]), strict=True)]
        word, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        ia, ib, m = at[: len(a)], at[len(a) :], len(word)
        stats = [np.bincount(ia, w, m).astype(np.int64) for w in (total, total == 1, total == 2, total > 2)] + [np.bincount(ib, minlength=m)]
        rows += [(i, None, PARTIAL, zip_arrays(np.diff(word[k], prepend=np.uint64(0)), *(s[k] for s in stats)), None) for i, k in deal(word_part(word, n_parts), n_parts)]
        rows.append((part, None, SUMS, None, [int((total == i).sum()) for i in (1, 2, 3, 4)] + [len(total)]))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.table([pa.array([lang] * len(rows), pa.string()), *cols], names=["lang", "part", "batch", "kind", "block", "sums"])

    return run


def _merged(blocks: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    cols = [unzip_arrays(x, np.uint64, *[np.int64] * 5) for x in blocks]
    cols = cols or [[np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 5]]
    word, at = np.unique(np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in cols]), return_inverse=True)
    return word, [np.bincount(at, np.concatenate([c[i] for c in cols]), len(word)).astype(np.int64) for i in range(1, 6)]


def _lower_sums(t: pa.Table) -> pa.Table:
    """Counts of counts of the lower order."""
    _, s = _merged(t["block"].to_pylist())
    n = [int((s[4] == i).sum()) for i in (1, 2, 3, 4)] + [int((s[4] > 0).sum())]
    return pa.table({"lang": t["lang"][:1], "sums": pa.array([n], pa.list_(pa.int64()))})


def _tell_words(t: pa.Table) -> pa.Table:
    """The words' statistics, for each unit in the order of its numbers."""
    kind, blocks, batches = t["kind"].to_numpy(), t["block"].to_pylist(), t["batch"].to_pylist()
    word, stats = _merged([x for x, k in zip(blocks, kind, strict=True) if k == PARTIAL])
    out = []
    for batch, x, k in zip(batches, blocks, kind, strict=True):
        if k == ANSWER:
            ids = np.unique(unzip_arrays(x, np.uint64)[0])
            ids = ids[ids >= FIRST]
            if t["part"][0].as_py() == 0:
                ids = np.concatenate([np.array([RARE, MARK], np.uint64), ids])
            at = np.searchsorted(word, ids)
            hit = np.isin(ids, word)
            told = [np.zeros(len(ids), np.int64) for _ in stats]
            for v, s in zip(told, stats, strict=True):
                v[hit] = s[at[hit]]
            out.append((batch, zip_arrays(*told)))
    return pa.table({"part": pa.array([t["part"][0].as_py()] * len(out), pa.int32()), "batch": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.binary())})


def discounts(t: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the numbers of keys with counts 1 to 4."""
    d = [0.0]
    y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.0
    for i in (1, 2, 3):
        v = i - (i + 1) * y * t[i] / t[i - 1] if t[i - 1] and t[0] else 0.5 * i
        d.append(max(0.05, min(i - 0.05, v)))
    return np.array(d)


def perplexities(u: Unit, totals: dict[int, np.ndarray], told: dict[int, list[np.ndarray]], sums: dict, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative log probabilities of the documents' words by the model and by its lower order; NaN where nothing is known."""
    m, n_pairs = len(u.ids), len(u.a)
    total = np.zeros(n_pairs, np.int64)
    for i, k in u.pairs:
        total[k] = totals[i]
    ctx, f1, f2, f3, kinds = (np.zeros(m, np.int64) for _ in range(5))
    for i, k in u.words:
        for s, v in zip((ctx, f1, f2, f3, kinds), told[i], strict=True):
            s[k] = v
    upper, lower = discounts(sums["pairs"]), discounts(sums["words"])
    off = f1 * upper[1] + f2 * upper[2] + f3 * upper[3]
    t = sums["words"]
    spare = t[0] * lower[1] + t[1] * lower[2] + (t[4] - t[0] - t[1]) * lower[3]
    out = np.full((2, len(u.size)), np.nan)
    ends = np.cumsum(u.size)
    cut = np.flatnonzero(np.diff(ends // AT_ONCE, prepend=-1))
    for first, last in zip(cut, [*cut[1:], len(ends)][: len(cut)], strict=True):
        size = u.size[first:last]
        d = len(size)
        pairs = u.at[ends[first] - u.size[first] : ends[last - 1]]
        # each document's own counts go
        key, own = np.unique(np.repeat(np.arange(d), size) * n_pairs + pairs, return_counts=True)
        doc, pair = key // n_pairs, key % n_pairs
        left = total[pair] - own
        lost = left == 0
        x, at = np.unique(doc * m + u.a[pair], return_inverse=True)
        ctx_left = ctx[x % m] - np.bincount(at, own, len(x)).astype(np.int64)
        off_left = off[x % m] + np.bincount(at, upper[np.minimum(left, 3)] - upper[np.minimum(total[pair], 3)], len(x))
        c, o = ctx_left[at], np.maximum(off_left[at], 1e-9)
        x, at = np.unique(doc * m + u.b[pair], return_inverse=True)
        kinds_left = np.maximum(kinds[x % m] - np.bincount(at, lost, len(x)).astype(np.int64), 0)
        all_left = (sums["pairs"][4] - np.bincount(doc, lost, d))[x // m]
        rare = (x % m == RARE) / (1.0 + sums["rare"]) + (x % m != RARE)  # one of the words that one document has
        with np.errstate(divide="ignore", invalid="ignore"):
            low = (np.maximum(kinds_left - lower[np.minimum(kinds_left, 3)], 0) + spare / max(1, t[4])) / all_left * rare
            low, rare = low[at], rare[at]
            prob = np.where(c > 0, (np.maximum(left - upper[np.minimum(left, 3)], 0) * rare + o * low) / np.maximum(c, 1), low)
            for i, p in enumerate((prob, low)):
                out[i, first:last] = np.bincount(doc, -np.log(p) * own, d) / size
    out[~np.isfinite(out)] = np.nan
    return out[0], out[1]


def _score(n_parts: int, sums: dict[str, dict]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for i, (lang, block, numbers, totals, told) in enumerate(zip(*(rb[c].to_pylist() for c in ("lang", "block", "numbers", "totals", "told")), strict=True)):
                rows = rb["rows"][i].values
                both = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
                if numbers:
                    u = _numbered(block, numbers, n_parts)
                    totals = {k: x[0] for k, x in _answers(totals, np.int64).items()}
                    both = perplexities(u, totals, _answers(told, *[np.int64] * 5), sums[lang], n_parts)
                cols = {rows.type.field(k).name: rows.field(k) for k in range(rows.type.num_fields)}
                yield pa.record_batch({**cols, "lang": pa.array([lang] * len(rows), pa.string()), "log_perplexity": pa.array(both[0], from_pandas=True), "word_log_perplexity": pa.array(both[1], from_pandas=True)})

    return run


def scored(units: DataFrame, row: str) -> DataFrame:
    """The rows of units (batch, lang, block, rows), `row` their fields, with log_perplexity and word_log_perplexity."""
    spark = units.sparkSession
    width = shuffle_width(spark)
    units = bucketed(units, "batch", width)
    n_parts = max(width, units.count() // 4)

    def by_batch(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("batch").agg(F.collect_list(F.struct("part", "block")).alias(name))  # a block a part at most

    sent = units.select("batch", "lang", "block").mapInArrow(_send_words(n_parts), SENT)
    numbers = stored(sent.groupBy("lang", "part").applyInArrow(_number(n_parts), SENT + ", n_rare long"), "numbers")
    release(spark)
    rare = {r.lang: r.n for r in numbers.filter("batch is null").groupBy("lang").agg(F.sum("n_rare").alias("n")).collect()}  # a row a language
    numbers = numbers.filter("batch is not null").select("lang", "part", "batch", "block")
    numbered = units.join(by_batch(numbers, "numbers"), "batch")
    sent = numbered.select("batch", "lang", "block", "numbers").mapInArrow(_send_pairs(n_parts), SENT)
    counted = stored(sent.groupBy("lang", "part").applyInArrow(_count_pairs(n_parts), COUNTED), "pairs")
    release(spark)
    del sent
    partial = counted.filter(F.col("kind") == PARTIAL)
    add = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(5)]
    of_pairs = counted.filter(F.col("kind") == SUMS).groupBy("lang").agg(*add).collect()  # a row a language, as the next
    of_words = partial.groupBy("lang", "part").applyInArrow(_lower_sums, "lang string, sums array<long>").groupBy("lang").agg(*add).collect()
    sums = {r.lang: {"pairs": list(r[1:]), "rare": rare[r.lang]} for r in of_pairs}
    for r in of_words:
        sums[r.lang]["words"] = list(r[1:])
    release(spark)
    asked = numbers.withColumns({"kind": F.lit(ANSWER), "sums": F.lit(None).cast("array<long>")}).unionByName(partial)
    told = asked.groupBy("lang", "part").applyInArrow(_tell_words, "part int, batch long, block binary")
    totals = by_batch(counted.filter(F.col("kind") == ANSWER), "totals")
    full = units.join(by_batch(numbers, "numbers"), "batch", "left").join(totals, "batch", "left").join(by_batch(told, "told"), "batch", "left")
    out = stored(full.mapInArrow(_score(n_parts, sums), f"{row}, lang string, log_perplexity double, word_log_perplexity double"), "scored")
    forget(units, numbers, counted)
    return out

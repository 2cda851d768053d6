"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

Items are cut into units of at most 64 words. A unit's BM25 weights are divided by the score of
the unit against itself, so one threshold (a share of the own score) serves all. Every passage
of the training texts (128 words, one each 64 words) is a query. The lists of essential terms are
read for all passages of a batch at once: a passage that no unit's essential terms can bring to
the threshold is left out. The others walk the posting lists with WAND pivots and block maxima
and give every unit at or above the threshold. Hits are then verified on the words around them: the shares of
the 3-grams of the item's question and of its answer that occur there, both of which must reach the overlap ("question and answer"), else that of the
whole item or of a section of it ("part"), else, in an item of several units, that of one unit, of which UNIT_SHARE must occur ("passage").

The question of an item ends at its last question mark, else at its last but one sentence end,
else after two thirds of its words; the answer is the rest. Words are lower-cased, ASCII
punctuation is white space; they are compared by 64-bit hashes.

Items of more than SECTION words are looked up in sections of that many words; what a document holds of an item's sections is added up
before it is judged, so an item is judged as a whole and once. Postings carry numbers only. The index is built by Spark and used
in shards of about SHARD_WORDS words, which sections are dealt to; each shard is broadcast, one pass over the texts a
shard, so neither the number of items nor the length of one has a limit, and neither size changes the result.

Defined results: null or empty texts and items match nothing; items of fewer than 8 words must
occur whole; repeated item rows are one item, items that share an id are judged apart; repeated documents
give repeated rows; extra columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import chunks, lean, ranges, stored, table, word_hashes

TILE = 64
SECTION = 4096
SHARD_WORDS = 1 << 20
UNIT_SHARE = 0.8
BATCH = 4 << 20
K1, B = 1.2, 0.75
_PUNCT = bytes(32 if (c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128) else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PUNCT).split() if text else []


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    words = words_of(text)
    last = next((i for i in range(len(text) - 1, -1, -1) if not text[i].isascii() or text[i].isalnum()), 0)  # the last word's end
    cut = text.rfind("?")
    if not 0 <= cut < last:
        cut = max(text.rfind(c, 0, last) for c in ".!?")
    n = len(words_of(text[: cut + 1])) or len(words) * 2 // 3
    return words[:n], words[n:]


def _sections(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for item, text in zip(b["item_id"], b["text"].to_pylist(), strict=True):
            q, a = split_item(text)
            h = word_hashes(q + a)
            at = range(0, len(h), SECTION)
            yield pa.record_batch({
                "item_id": pa.array([item.as_py()] * len(at), b["item_id"].type), "item": pa.array([int(word_hashes([text.encode("utf-8", "replace")]).view(np.int64)[0])] * len(at), pa.int64()),
                "size": pa.array([len(h)] * len(at), pa.int64()), "question": pa.array([min(max(0, len(q) - i), SECTION) for i in at], pa.int64()),
                "words": pa.array([h[i : i + SECTION].tobytes() for i in at], pa.binary()),
            })


def units_of(h: np.ndarray) -> list[np.ndarray]:
    return np.array_split(h, max(1, -(-len(h) // TILE)))


def _terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for section, shard, words in zip(b["section"].to_pylist(), b["shard"].to_pylist(), b["words"].to_pylist(), strict=True):
            rows = [(i, t, n, len(u)) for i, u in enumerate(units_of(np.frombuffer(words, np.int64))) for t, n in Counter(u.tolist()).items()]
            unit, term, tf, size = (np.array(c) for c in zip(*rows, strict=True))
            n = len(rows)
            yield pa.record_batch({"section": pa.array([section] * n, pa.int64()), "shard": pa.array([shard] * n, pa.int32()), "unit": unit.astype(np.int32), "term": term.astype(np.int64), "tf": tf.astype(np.int32), "size": size.astype(np.int32)})


def postings(sections: DataFrame) -> DataFrame:
    """Rows (shard, section, unit, term, weight); weights of a unit sum to 1."""
    p = stored(sections.select("section", "shard", "words").mapInArrow(_terms, "section long, shard int, unit int, term long, tf int, size int"), "units")
    total = p.select("section", "unit", "size").distinct().agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    p = p.join(df, "term").crossJoin(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    p = p.withColumn("w", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean"))))
    own = p.groupBy("section", "unit").agg(F.sum("w").alias("own"))
    return p.join(own, ["section", "unit"]).select("shard", "section", "unit", "term", (F.col("w") / F.col("own")).alias("weight"))


class Index:
    """Posting lists by term with block maxima, and the essential postings of each unit."""

    BLOCK = 16

    def __init__(self, sections: pa.Table, rows: pa.Table, least: float):
        order = np.argsort(sections["section"].to_numpy())
        number = sections["section"].to_numpy()[order]
        self.item_id, self.item, self.size, self.question = (sections.column(c).take(order).to_pylist() for c in ("item_id", "item", "size", "question"))
        self.words = [np.frombuffer(x, np.uint64) for x in sections["words"].take(order).to_pylist()]
        many = np.array([max(1, -(-len(w) // TILE)) for w in self.words])
        self.section = np.repeat(np.arange(len(many)), many)  # of each unit
        self.first = np.cumsum(many) - many
        self.n_units = int(many.sum())
        term, weight = rows["term"].to_numpy().view(np.uint64), rows["weight"].to_numpy()
        unit = self.first[np.searchsorted(number, rows["section"].to_numpy())] + rows["unit"].to_numpy()
        self.vocab, term = np.unique(term, return_inverse=True)
        order = np.lexsort((unit, term))
        term, unit, weight = term[order], unit[order], weight[order]
        n_terms = len(self.vocab)
        self.begin = np.searchsorted(term, np.arange(n_terms + 1))
        cut = self.begin[1:-1]
        self.lists = list(zip((x.tolist() for x in np.split(unit, cut)), (x.tolist() for x in np.split(weight, cut)), strict=True))
        self.top = np.maximum.reduceat(weight, self.begin[:-1]).tolist()
        block = unit // self.BLOCK
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
        cut = np.searchsorted(term[new], np.arange(1, n_terms))
        self.block_max = [x.tolist() for x in np.split(np.maximum.reduceat(weight, new), cut)]
        self.blocks = [x.tolist() for x in np.split(block[new], cut)]
        # A unit's rarest terms are essential until what is left adds less than `spare` in all: a
        # passage that reaches the threshold has essential terms that add up to the difference.
        spare = 0.4 * least
        df = np.diff(self.begin)[term]
        order = np.lexsort((term, -df, unit))  # of each unit, the most frequent terms first
        left = np.cumsum(weight[order])
        start = np.searchsorted(unit[order], np.arange(self.n_units))
        left -= np.concatenate([[0.0], left])[start][unit[order]]
        easy = np.zeros(len(term), bool)
        easy[order] = left <= spare
        self.need = least - np.bincount(unit[easy], weight[easy], self.n_units) - 1e-9
        self.e_unit, self.e_weight = unit[~easy], weight[~easy]
        self.e_begin = np.searchsorted(term[~easy], np.arange(n_terms + 1))
        self.parts: dict[int, tuple] = {}

    def passages(self, tile: np.ndarray, term: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Tiles whose passage (the tile and the next one) may reach the threshold, by essential terms."""
        n = self.e_begin[term + 1] - self.e_begin[term]
        at = ranges(self.e_begin[term], n)
        t, u, w = np.repeat(tile, n), self.e_unit[at], self.e_weight[at]
        back = (t > 0) & pair[np.maximum(t - 1, 0)]
        key = np.concatenate([t, t[back] - 1]) * self.n_units + np.concatenate([u, u[back]])
        order = np.argsort(key, kind="stable")
        key, w = key[order], np.concatenate([w, w[back]])[order]
        if not len(key):
            return key
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ok = np.add.reduceat(w, new) >= self.need[key[new] % self.n_units]
        return np.unique(key[new][ok] // self.n_units)

    def _bound(self, t: int, b: int) -> float:
        i = bisect_left(self.blocks[t], b)
        return self.block_max[t][i] if i < len(self.blocks[t]) and self.blocks[t][i] == b else 0.0

    def wand(self, query: list[int], least: float) -> list[tuple[int, float]]:
        """All units whose weights of the query's terms sum to least or more."""
        least -= 1e-9
        cur = [[self.lists[t][0][0], 0, t] for t in query]  # unit, place in the list, term
        out = []
        while True:
            cur.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cur):
                bound += self.top[c[2]]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return out
            u = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == u:
                pivot += 1
            b = u // self.BLOCK
            if sum(self._bound(c[2], b) for c in cur[: pivot + 1]) < least:
                # no unit up to the block's end, or to the next list's place, can reach it
                to = (b + 1) * self.BLOCK
                if pivot + 1 < len(cur):
                    to = min(to, cur[pivot + 1][0])
                to = max(to, u + 1)
            elif cur[0][0] == u:
                s = sum(self.lists[c[2]][1][c[1]] for c in cur[: pivot + 1])
                if s >= least:
                    out.append((u, s))
                to = u + 1
            else:
                to = u
            for c in cur[: pivot + 1]:
                if c[0] < to:
                    units = self.lists[c[2]][0]
                    c[1] = bisect_left(units, to, c[1])
                    c[0] = units[c[1]] if c[1] < len(units) else -1
            cur = [c for c in cur if c[0] >= 0]

    def parts_of(self, s: int) -> tuple[set, set, set]:
        """3-grams of a section's question, answer and whole; shorter ones of items of fewer than 8 words."""
        if s not in self.parts:
            w, k = self.words[s].tolist(), gram_size(self.size[s])
            self.parts[s] = tuple(grams_of(x, k) for x in (w[: self.question[s]], w[self.question[s] :], w))
        return self.parts[s]

    def overlap(self, s: int, units: list[int], around: list[int]) -> tuple[int, int, int, float]:
        """How many 3-grams of a section's question, answer and whole are in these words (0 marks a gap), and the largest share of one of the units."""
        k = gram_size(self.size[s])
        have = grams_of(around, k)
        own = (grams_of(units_of(self.words[s])[u - int(self.first[s])].tolist(), k) for u in units)
        return *(len(x & have) for x in self.parts_of(s)), max((len(x & have) / len(x) for x in own if x), default=0.0)


def gram_size(words: int) -> int:
    return 3 if words >= 8 else max(1, words)


def grams_of(x: list[int], k: int) -> set[tuple]:
    return {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}


def leaks_in(index: Index, texts: list[str | None], least: float) -> list[tuple[int, int, float, int, int, int, float]]:
    """(text, section, score, 3-grams found of its question, its answer and all of it, share of a unit) of each section with a unit that reaches the threshold."""
    ids: dict[bytes, int] = {}
    flat: list[int] = []
    size = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words_of(t)
        size[i] = len(w)
        flat += [ids.setdefault(x, len(ids)) for x in w]
    hashes = word_hashes(list(ids))
    if not len(hashes):
        return []
    at = np.minimum(np.searchsorted(index.vocab, hashes), len(index.vocab) - 1)
    none = len(index.vocab)
    word = np.array(flat, np.int64)
    term = np.where(index.vocab[at] == hashes, at, none)[word]
    tiles = -(-size // TILE)
    base = np.cumsum(tiles) - tiles
    start = np.cumsum(size) - size
    tile = np.repeat(base, size) + (np.arange(len(term)) - np.repeat(start, size)) // TILE
    known = term < none
    key = np.unique(tile[known] << 32 | term[known])
    if not len(key):
        return []
    kt, kw = key >> 32, key & 0xFFFFFFFF
    n_tiles = int(tiles.sum())
    doc_of = np.repeat(np.arange(len(texts)), tiles)
    pair = np.concatenate([doc_of[1:] == doc_of[:-1], [False]])
    found: dict[tuple[int, int], list] = {}
    cut = np.searchsorted(kt, np.arange(n_tiles + 2))
    for i in index.passages(kt, kw, pair).tolist():
        end = cut[i + 2] if pair[i] else cut[i + 1]
        d = int(doc_of[i])
        p = i - int(base[d])
        for u, s in index.wand(np.unique(kw[cut[i] : end]).tolist(), least):
            f = found.setdefault((d, u), [0.0, []])
            f[0] = max(f[0], s)
            f[1].append(p)
    hits: dict[tuple[int, int], list] = {}
    for (d, u), (score, at) in found.items():
        h = hits.setdefault((d, int(index.section[u])), [0.0, [], []])
        h[0] = max(h[0], score)
        h[1].append(u)
        h[2] += at
    out = []
    for (d, k), (score, units, at) in hits.items():
        n = len(index.words[k])
        around: list[int] = []
        last = 0
        for p in sorted(set(at)):
            a, e = max(last, p * TILE - n), min(int(size[d]), (p + 2) * TILE + n)
            if a > last:
                around.append(0)  # no 3-gram spans a gap
            around += hashes[word[start[d] + a : start[d] + e]].tolist()
            last = max(last, e)
        out.append((d, k, score, *index.overlap(k, units, around)))
    return out


def _grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of distinct 3-grams of the question, the answer and the whole of each section."""
    for b in it:
        n = [[len(grams_of(x, gram_size(size))) for x in (w[:q], w[q:], w)] for size, q, w in zip(b["size"].to_pylist(), b["question"].to_pylist(), (np.frombuffer(x, np.uint64).tolist() for x in b["words"].to_pylist()), strict=True)]
        yield pa.record_batch([b["section"], *(pa.array([x[i] for x in n], pa.int64()) for i in range(3))], names=["section", "n_question", "n_answer", "n_all"])


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap, kind): one for each document and item of which it holds enough.

    What a document holds of an item is added up over all the item's sections, wherever they were looked up, before it is judged. Rows of
    docs alike in doc_id and text are one document.
    """
    sc = lean(docs.sparkSession).sparkContext
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    cut = items.filter("text is not null").select("item_id", "text").distinct().mapInArrow(_sections, f"item_id {kinds[1]}, item long, size long, question long, words binary")
    cut = stored(cut.withColumn("section", F.monotonically_increasing_id()), "sections")  # written, so the numbers stay
    shards = 1 + (cut.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // 8 // SHARD_WORDS
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("section"), F.lit(shards)).cast("int"))
    p = stored(postings(cut), "postings")
    texts = docs.select("doc_id", F.md5("text").alias("_row"), "text")
    schema = f"doc_id {kinds[0]}, _row string, section long, score double, question long, answer long, both long, own double"
    found = docs.sparkSession.createDataFrame([], schema)
    for shard in range(shards):
        rows = p.filter(F.col("shard") == shard).drop("shard").toArrow()
        if not rows.num_rows:
            continue
        mine = cut.filter(F.col("shard") == shard).drop("shard").toArrow()
        number = np.sort(mine["section"].to_numpy())
        bc = sc.broadcast((Index(mine, rows, least), number))

        def run(it: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pa.RecordBatch]:
            index, number = bc.value
            for t in chunks(it, "text", BATCH):
                hits = leaks_in(index, t["text"].to_pylist(), least)
                if hits:
                    d, k, *rest = zip(*hits, strict=True)
                    who = t.select(["doc_id", "_row"]).take(pa.array(d))
                    kind = [pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                    cols = [*(c.combine_chunks() for c in who.columns), pa.array(number[list(k)]), *(pa.array(c, x) for c, x in zip(rest, kind, strict=True))]
                    yield pa.record_batch(cols, names=["doc_id", "_row", "section", "score", "question", "answer", "both", "own"])

        found = found.unionByName(texts.mapInArrow(run, schema))
    size = cut.select("section", "item_id", "item", "size").join(cut.mapInArrow(_grams, "section long, n_question long, n_answer long, n_all long"), "section")
    whole = size.groupBy("item_id", "item").agg(*[F.sum(c).alias(f"i_{c}") for c in ("n_question", "n_answer", "n_all")])
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    by = found.distinct().join(size, "section").groupBy("doc_id", "_row", "item_id", "item").agg(
        F.max("score").alias("score"), *[F.sum(c).alias(c) for c in ("question", "answer", "both")], F.max("own").alias("own"), F.max(share("both", "n_all")).alias("part"), F.max("size").alias("size"),
    ).join(whole.withColumnsRenamed({"item_id": "_item_id", "item": "_item"}), F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("item") == F.col("_item")))
    of_all = F.coalesce(share("both", "i_n_all"), F.lit(0.0))
    enough = F.when(F.col("size") < 8, 1.0).otherwise(overlap)
    by = by.withColumns({"question_overlap": F.coalesce(share("question", "i_n_question"), of_all), "answer_overlap": F.coalesce(share("answer", "i_n_answer"), of_all)})
    kind = F.when((F.col("question_overlap") >= enough) & (F.col("answer_overlap") >= enough), "question and answer").when(F.greatest(of_all, F.coalesce("part", F.lit(0.0))) >= enough, "part")
    kind = kind.when((F.col("own") >= UNIT_SHARE) & (F.col("size") > TILE), "passage")
    return by.withColumn("kind", kind).filter("kind is not null").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "kind")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that hold a test item; each row is judged by its own text, whatever its doc_id."""
    texts = docs.select(F.sha2("text", 256).alias("doc_id"), "text")
    found = stored(leaks(texts, items).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(found, F.sha2(docs["text"], 256) == F.col("_leak"), "left_anti")


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})

"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct words are one concatenated text with a suffix array. Every piece is looked up
by binary search, which gives the range of its occurrences; all occurrences are edges, sorted by
the position where they end. Relaxing the edges in that order finds for each prefix of a word its
last piece: of the pieces that end there exactly one follows the last piece of the rest without
the merges ever crossing the border, and that is the tokenizer's own choice. So the result is the
merge order's, piece for piece. Pieces never run over a space; runs of spaces are taken from the
left, the longest piece first, as their pieces have the least score of all.

Defined results: null and empty texts have no pieces and decode to an empty text; a character
that no piece has becomes its UTF-8 bytes; U+2581 in a text is a space, as in the library; words of any
length go the same way; null ids and ids that the vocabulary does not have decode to nothing, null lists to
an empty text; a model that is no merge model, or that rewrites texts first, is rejected;
repeated rows give repeated results; extra columns stay as they are (an `ids` or `decoded` column
is replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import chunks, lean, ranges
from gridlark.llm.pieces import BYTE, CONTROL, NORMAL, SPACE, Parts, Pieces, check_model, default_model, read_pieces

BATCH = 3 << 20
BLOCK = 300_000  # characters in one suffix array
NEVER = np.iinfo(np.int64).max


class Tokenizer:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        usable = np.flatnonzero(pieces.kind == NORMAL)
        self.id = {pieces.text[i]: int(i) for i in usable}
        self.rank = {t: -float(pieces.score[i]) for t, i in self.id.items()}
        self.byte_ids = pieces.byte_ids
        words = [t for t in self.id if not (len(t) > 1 and not t.strip(SPACE))]
        self.run = max((len(t) for t in self.id if not t.strip(SPACE)), default=1)
        n = len(pieces.text)
        order = {t: i for i, t in enumerate(sorted(words, key=lambda t: (self.rank[t], t)))}
        self.made = np.full(n, NEVER, np.int64)  # when a piece's last merge happens, -1 for single characters
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        usable_ids, pair = [], {}
        for t in sorted(words, key=len):
            i = self.id[t]
            for k in range(1, len(t)):
                if t[:k] in self.id and t[k:] in self.id:
                    pair[self.id[t[:k]] << 32 | self.id[t[k:]]] = order[t]
            if len(t) == 1:
                self.made[i] = -1
                usable_ids.append(i)
            elif (last := self._merge(t)[1]) is not None:
                a, b = self.id[last[0]], self.id[last[1]]
                self.left[i], self.right[i] = a, b
                self.made[i] = max(order[t], self.made[a], self.made[b])
                usable_ids.append(i)
        keys = np.array(sorted(pair), np.int64)
        self.pair, self.pair_rank = keys, np.array([pair[k] for k in keys.tolist()], np.int64)
        self.usable = np.array(usable_ids, np.int64)
        self.alphabet = np.array(sorted({ord(c) for i in usable_ids for c in pieces.text[i]}), np.uint32)
        self.length = np.array([len(t) for t in pieces.text], np.int64)

    def _merge(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merges in order of rank, then from the left; and the last merge if one piece is left."""
        sym: list[str | None] = list(word)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list = []

        def push(i: int) -> None:
            j = nxt[i] if i >= 0 else len(sym)
            if i >= 0 and j < len(sym) and (r := self.rank.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            push(i)
        last = None
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j], last = a + b, None, (a, b)
            nxt[i] = nxt[j]
            if nxt[i] < len(sym):
                prv[nxt[i]] = i
            push(i)
            push(prv[i])
        out = [s for s in sym if s]
        return out, last if len(out) == 1 else None

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of pieces x and y: walk back through both merge trees."""
        ok = np.ones(len(x), bool)
        live = np.arange(len(x))
        x, y = x.astype(np.int64), y.astype(np.int64)
        limit = np.full(len(x), NEVER, np.int64)
        from_left = np.zeros(len(x), bool)  # the merge at the limit starts further left than the border's
        while len(live):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            mx, my = self.made[x], self.made[y]
            when = np.where(self.pair[at] == key, np.maximum(self.pair_rank[at], np.maximum(mx, my)), NEVER)
            bad = (when < limit) | ((when == limit) & ~from_left & (limit != NEVER))
            ok[live[bad]] = False
            more = ~bad & ((mx >= 0) | (my >= 0))
            live, x, y, mx, my = live[more], x[more], y[more], mx[more], my[more]
            from_left = mx > my
            limit = np.where(from_left, mx, my)
            x, y = np.where(from_left, self.right[x], x), np.where(from_left, y, self.left[y])
        return ok

    def edges(self, code: np.ndarray, bits: int, codes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of a piece in the text, by a suffix array."""
        per = 64 // bits
        longest = int(self.length[self.usable].max(initial=1))
        keys = []
        pad = np.concatenate([code, np.zeros(longest + per, code.dtype)]).astype(np.uint64)
        for k in range(0, longest, per):
            v = np.zeros(len(code), np.uint64)
            for j in range(per):
                v = (v << np.uint64(bits)) | pad[k + j : k + j + len(code)]
            keys.append(v)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        low_of, high_of = [[] for _ in keys], [[] for _ in keys]
        ids = []
        for i in self.usable.tolist():
            c = [codes.get(ord(ch), 0) for ch in self.pieces.text[i]]
            if 0 in c:
                continue
            ids.append(i)
            for k in range(len(keys)):
                part = c[k * per : (k + 1) * per]
                v = 0
                for z in part:
                    v = v << bits | z
                rest = bits * (per - len(part))
                low_of[k].append(v << rest)
                high_of[k].append((v << rest) | ((1 << rest) - 1))
        ids = np.array(ids, np.int64)
        lows, highs = ([np.array(v, np.uint64) for v in x] for x in (low_of, high_of))
        lo, hi = np.searchsorted(keys[0], lows[0], "left"), np.searchsorted(keys[0], highs[0], "right")
        for k in range(1, len(keys)):
            for p in np.flatnonzero((self.length[ids] > k * per) & (hi > lo)).tolist():
                a, b = lo[p], hi[p]
                lo[p], hi[p] = a + np.searchsorted(keys[k][a:b], lows[k][p], "left"), a + np.searchsorted(keys[k][a:b], highs[k][p], "right")
        n = np.maximum(hi - lo, 0)
        return suffixes[ranges(lo, n)], np.repeat(ids, n)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has; each word follows a space."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n) + 1
        out_ids, out_word = [], []
        order = np.argsort(size, kind="stable")  # words of like length together: a block has a round for each length
        cut = np.flatnonzero(np.diff(np.cumsum(size[order]) // BLOCK, prepend=-1))
        for a, b in zip(cut, [*cut[1:], n][: len(cut)], strict=True):
            w, ids = self._block(words, order[a:b])
            out_ids.append(ids)
            out_word.append(w)
        if not out_ids:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        word, ids = np.concatenate(out_word), np.concatenate(out_ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=n)

    def fallback(self, text: str) -> list[int]:
        out = []
        for s in self._merge(text)[0]:
            out += [self.id[s]] if s in self.id else self.byte_ids[list(s.encode("utf-8", "replace"))].tolist()
        return out

    def _block(self, words: list[str], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [words[i] for i in which.tolist()]
        cp = np.frombuffer("".join(f"{SPACE}{w}\0" for w in own).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, own), np.int64, len(own)) + 1
        begin = np.cumsum(size + 1) - size - 1
        at = np.minimum(np.searchsorted(self.alphabet, cp), len(self.alphabet) - 1)
        known = self.alphabet[at] == cp
        used = np.unique(at[known])
        bits = 8 if len(used) < 256 else 16
        code = np.zeros(len(cp), np.uint32)
        code[known] = np.searchsorted(used, at[known]) + 1
        start, piece = self.edges(code, bits, {int(self.alphabet[u]): k + 1 for k, u in enumerate(used.tolist())})
        # a character without a piece is an edge of its own, marked -1
        is_char = cp != 0
        single = np.zeros(len(cp), bool)
        single[start[self.length[piece] == 1]] = True
        bare = np.flatnonzero(is_char & ~single)
        start, piece = np.concatenate([start, bare]), np.concatenate([piece, np.full(len(bare), -1)])
        end = start + np.where(piece < 0, 1, self.length[piece])
        word_of = np.repeat(np.arange(len(own)), size + 1)
        depth = end - begin[word_of[start]]
        order = np.argsort(depth, kind="stable")
        start, piece, end, depth = start[order], piece[order], end[order], depth[order]
        cut = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
        last = np.full(len(cp) + 1, -2, np.int64)  # last piece of the prefix that ends here
        last[begin] = -3
        head = np.zeros(len(cp) + 1, np.int64)  # where that piece starts
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s, p = start[a:b], piece[a:b]
            prev = last[s]
            ok = prev != -2
            test = np.flatnonzero((prev >= 0) & (p >= 0))
            ok[test] &= self.compatible(prev[test], p[test])
            last[end[a:b][ok]] = p[ok]
            head[end[a:b][ok]] = s[ok]
        # walk back from the words' ends
        pos, w = begin + size, np.arange(len(own))
        lost = last[pos] == -2
        out_w, out_p, out_at = [], [], []
        live = np.flatnonzero(~lost)
        cur = pos[live]
        wl = w[live]
        while len(cur):
            out_w.append(wl)
            out_p.append(last[cur])
            out_at.append(head[cur])
            cur = head[cur]
            more = cur > begin[wl]
            cur, wl = cur[more], wl[more]
        for i in np.flatnonzero(lost).tolist():  # not seen with vocabularies made by merging
            ids = self.fallback(SPACE + own[i])
            out_w.append(np.full(len(ids), i))
            out_p.append(np.array(ids, np.int64))
            out_at.append(begin[i] + np.arange(len(ids)))
        w, p, at = np.concatenate(out_w), np.concatenate(out_p), np.concatenate(out_at)
        order = np.lexsort((at, w))
        w, p, at = w[order], p[order], at[order]
        bare = np.flatnonzero(p == -1)
        if len(bare):
            u, back = np.unique(cp[at[bare]], return_inverse=True)
            b = [self.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in u.tolist()]
            n = np.ones(len(p), np.int64)
            n[bare] = np.array([len(x) for x in b])[back]
            w, p = np.repeat(w, n), np.repeat(p, n)
            p[p == -1] = np.concatenate([b[k] for k in back.tolist()])
        return which[w], p

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        parts = Parts(texts)
        ids, count = self.words(parts.words)
        first = np.cumsum(count) - count
        space = self.id.get(SPACE, -1)
        part, text = parts.part, parts.text
        if not len(part):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        n = np.where(part > 0, count[np.maximum(part - 1, 0)] if len(count) else 0, 0)
        src = np.where(part > 0, first[np.maximum(part - 1, 0)] if len(count) else 0, 0)
        lone = np.zeros(len(part), bool)
        if len(ids):
            lone = (part > 0) & (ids[np.minimum(src, len(ids) - 1)] == space)
        # spaces: runs of empty parts, with the space of the next part if that stands alone
        if not (part == 0).any():
            return ids[ranges(src, n)], np.bincount(text, n, len(texts)).astype(np.int64)
        pieces: list[np.ndarray] = []
        total = np.zeros(len(texts), np.int64)
        at = np.flatnonzero(part == 0)
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])]))
        heads, sizes = at[cut], np.diff(np.append(cut, len(at)))
        done = 0
        for h, k in zip(heads.tolist(), sizes.tolist(), strict=True):
            pieces.append(ids[ranges(src[done:h], n[done:h])])
            total += np.bincount(text[done:h], n[done:h], len(texts)).astype(np.int64) if h > done else 0
            follow = h + k
            joined = follow < len(part) and text[follow] == text[h] and lone[follow]
            run = k + 1 if joined else k
            spaces = [self.id[SPACE * min(self.run, run - i)] for i in range(0, run, self.run)]
            total[text[h]] += len(spaces)
            if joined:  # its own space is in the run
                src[follow] += 1
                n[follow] -= 1
            pieces.append(np.array(spaces, np.int64))
            done = follow
        pieces.append(ids[ranges(src[done:], n[done:])])
        total += np.bincount(text[done:], n[done:], len(texts)).astype(np.int64) if done < len(part) else 0
        return np.concatenate(pieces), total

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces one after another, their starts and sizes."""
        if not hasattr(self, "_table"):
            p = self.pieces
            b = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == 2 else t.replace(SPACE, " ").encode() for t, k in zip(p.text, p.kind.tolist(), strict=True)]
            size = np.fromiter(map(len, b), np.int64, len(b))
            self._table = np.frombuffer(b"".join(b), np.uint8), np.cumsum(size) - size, size
        return self._table

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of id lists that stand one after another; the space put before each text goes."""
        flat, start, size = self.table
        known = (ids >= 0) & (ids < len(size))
        if not known.all():  # ids that the vocabulary does not have, or null, stand for nothing
            count = np.bincount(np.repeat(np.arange(len(count)), count)[known], minlength=len(count))
            ids = ids[known]
        out = flat[ranges(start[ids], size[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(count)])].tolist()
        res = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            t = out[a:b].decode("utf-8", "replace")
            res.append(t[1:] if t[:1] == " " else t)
        return res


@lru_cache(2)
def tokenizer(data: bytes) -> Tokenizer:
    check_model(data)
    return Tokenizer(read_pieces(data))


def encode(docs: DataFrame, column: str = "text", model: str | None = None) -> DataFrame:
    """docs with a column ids, the pieces of `column`."""
    bc = lean(docs.sparkSession).sparkContext.broadcast(Path(model or default_model()).read_bytes())
    docs = docs.drop("ids")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(it, column, BATCH):
            ids, n = tokenizer(bc.value).encode(t[column].to_pylist())
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), ids.astype(np.int32))
            yield pa.record_batch([*(c.combine_chunks() for c in t.columns), lists], names=[*t.column_names, "ids"])

    return docs.mapInArrow(run, docs.withColumn("ids", F.array().cast("array<int>")).schema)


def decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with a column decoded, the text of the column ids."""
    bc = lean(docs.sparkSession).sparkContext.broadcast(Path(model or default_model()).read_bytes())
    docs = docs.drop("decoded")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(it, "ids", BATCH):
            c = t["ids"].combine_chunks()
            n = np.array(c.value_lengths().fill_null(0), np.int64)
            texts = tokenizer(bc.value).decode(np.array(c.flatten().fill_null(-1), np.int64), n)
            yield pa.record_batch([*(c.combine_chunks() for c in t.columns), pa.array(texts, pa.string())], names=[*t.column_names, "decoded"])

    return docs.mapInArrow(run, docs.withColumn("decoded", F.lit("")).schema)


def encode_decode(docs: DataFrame, column: str = "text", model: str | None = None) -> DataFrame:
    """docs with both columns, ids and decoded, in one step: as decode(encode(docs)), with one tokenizer in memory a task."""
    bc = lean(docs.sparkSession).sparkContext.broadcast(Path(model or default_model()).read_bytes())
    docs = docs.drop("ids", "decoded")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(it, column, BATCH):
            ids, n = tokenizer(bc.value).encode(t[column].to_pylist())
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), ids.astype(np.int32))
            texts = pa.array(tokenizer(bc.value).decode(ids, n), pa.string())
            yield pa.record_batch([*(c.combine_chunks() for c in t.columns), lists, texts], names=[*t.column_names, "ids", "decoded"])

    return docs.mapInArrow(run, docs.withColumns({"ids": F.array().cast("array<int>"), "decoded": F.lit("")}).schema)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_decode(docs)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip"),
    )

"""Token counts of a unigram tokenizer, without the tokens.

An Aho-Corasick automaton over the vocabulary's UTF-8 bytes reads all distinct words of a batch in
step; its output links name every piece that ends at a byte, longest first. For each place of a
word only the best score so far and the number of its pieces are kept.

The tie rule: scores are summed in double precision from the left; of the paths to a place the first
one stays unless a later one's score is greater, and paths come in the order in which their last piece
begins, so of equal ones that with the longest last piece stays. A character without a piece of its own
scores ten less than the least score and counts as its UTF-8 bytes. A text begins with a space that
is put before it.

No piece has a space after another character, so a text's best path is the best paths of its words, a word
being a run of spaces and what follows up to the next space. Sums of whole numbers, such as the scores of
the default vocabulary, are exact in any order, so the counts are those of a tokenizer that reads the text
as one sentence. A vocabulary with pieces that do run over a space is rejected.

Defined results: null and empty texts have no tokens; U+2581 counts as a space; repeated rows
give repeated results; extra columns stay (an n_tokens column is replaced); an empty table gives an empty
table.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import chunks, lean, ranges
from gridlark.llm.pieces import NORMAL, SPACE, USER, Pieces, default_model, read_pieces

BATCH = 3 << 20
BLOCK = 1 << 19  # bytes of words that are read in step


class Counter:
    def __init__(self, pieces: Pieces):
        use = [i for i in range(len(pieces.text)) if pieces.kind[i] == NORMAL]
        normal = pieces.score[pieces.kind == NORMAL]
        if (pieces.kind == USER).any() or any(SPACE in pieces.text[i].lstrip(SPACE) for i in use):
            raise ValueError("a piece runs over a space, or is one that users defined")
        self.unknown = float(normal.min() if len(normal) else 0) - 10.0
        self.score = pieces.score.astype(np.float64)
        # goto table of the automaton: rows are states, columns the bytes that occur
        used = sorted({b for i in use for b in pieces.text[i].encode()})
        self.column = np.zeros(256, np.int64)
        self.column[used] = np.arange(1, len(used) + 1)  # column 0: any other byte, back to the root
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for i in use:
            s = 0
            for b in pieces.text[i].encode():
                c = int(self.column[b])
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    ends.append(-1)
                s = children[s][c]
            ends[s] = i
        go = np.zeros((len(children), width), np.int32)
        fail = np.zeros(len(children), np.int64)
        link = np.full(len(children), -1, np.int32)  # the next shorter state with a piece
        queue = deque([0])
        while queue:
            s = queue.popleft()
            if s:
                go[s] = go[fail[s]]
            for c, t in children[s].items():
                fail[t] = go[s, c] if s else 0
                link[t] = fail[t] if ends[fail[t]] >= 0 else link[fail[t]]
                queue.append(t)
            for c, t in children[s].items():
                go[s, c] = t
        self.go, self.width = go.reshape(-1), width
        self.piece = np.array(ends, np.int32)
        self.link = link
        self.first = np.where(self.piece >= 0, np.arange(len(ends), dtype=np.int32), link)
        self.size = np.array([len(t.encode()) for t in pieces.text], np.int64)

    def words(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each word."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        out = np.zeros(n, np.int64)
        order = np.argsort(size, kind="stable")
        a = 0
        while a < n:  # words of like length together
            longest = int(size[order[min(n - 1, a + 64)]])
            b = a + max(64, min(n - a, BLOCK // max(1, longest)))
            b = min(b, int(np.searchsorted(size[order], max(longest * 3 // 2, 16), "right")))
            b = max(b, a + 1)
            which = order[a:b]
            out[which] = self._block([words[i] for i in which.tolist()], size[which])
            a = b
        return out

    def _block(self, words: list[bytes], size: np.ndarray) -> np.ndarray:
        n, longest = len(words), int(size.max(initial=0))
        flat = np.zeros((n, longest + 1), np.uint8)
        rows = np.repeat(np.arange(n), size)
        flat[rows, ranges(np.zeros(n, np.int64), size)] = np.frombuffer(b"".join(words), np.uint8)
        best = np.full((longest + 1, n), -np.inf)
        count = np.zeros((longest + 1, n), np.int32)
        best[0] = 0
        state = np.zeros(n, np.int64)
        begin = np.zeros(n, np.int64)  # of the character that is being read
        for e in range(1, longest + 1):
            live = np.flatnonzero(size >= e)  # words are sorted by size, but a slice would need that
            byte = flat[live, e - 1]
            begin[live] = np.where((byte & 0xC0) != 0x80, e - 1, begin[live])
            s = self.go[state[live] * self.width + self.column[byte]].astype(np.int64)
            state[live] = s
            who, at = live, self.first[s]
            top = np.full(n, -np.inf)
            num = np.zeros(n, np.int32)
            single = np.zeros(n, bool)
            while True:
                keep = at >= 0
                who, at = who[keep], at[keep]
                if not len(who):
                    break
                p = self.piece[at]
                start = e - self.size[p]
                value = best[start, who] + self.score[p]
                single[who] |= start == begin[who]
                better = value > top[who]
                w = who[better]
                top[w] = value[better]
                num[w] = count[start[better], w] + 1
                at = self.link[at]
            # at the end of a character that is no piece
            whole = live[(flat[live, e] & 0xC0) != 0x80]
            bare = whole[~single[whole]]
            start = begin[bare]
            value = best[start, bare] + self.unknown
            better = value > top[bare]
            w = bare[better]
            top[w] = value[better]
            num[w] = count[start[better], w] + (e - start[better])
            best[e, live] = top[live]
            count[e, live] = num[live]
        return count[size, np.arange(n)]

    def texts(self, texts: list[str | None]) -> np.ndarray:
        ids: dict[str, int] = {}
        flat: list[int] = []
        size = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                t = t.replace(SPACE, " ") if SPACE in t else t
                if "  " in t or t[0] == " " or t[-1] == " ":
                    w = [x[1:] for x in re.findall(" +[^ ]*", " " + t)]  # each without its first space
                else:
                    w = t.split(" ")
                size[i] = len(w)
                flat += [ids.setdefault(x, len(ids)) for x in w]
        words = self.words([(SPACE + w.replace(" ", SPACE)).encode("utf-8", "replace") for w in ids])
        return np.bincount(np.repeat(np.arange(len(texts)), size), words[np.array(flat, np.int64)] if flat else None, len(texts)).astype(np.int64)


@lru_cache(2)
def counter(data: bytes) -> Counter:
    return Counter(read_pieces(data))


def count_tokens(docs: DataFrame, column: str = "text", model: str | None = None) -> DataFrame:
    """docs with a column n_tokens."""
    bc = lean(docs.sparkSession).sparkContext.broadcast(Path(model or default_model()).read_bytes())
    docs = docs.drop("n_tokens")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(it, column, BATCH):
            n = counter(bc.value).texts(t[column].to_pylist())
            yield pa.record_batch([*(c.combine_chunks() for c in t.columns), pa.array(n, pa.int64())], names=[*t.column_names, "n_tokens"])

    return docs.mapInArrow(run, docs.withColumn("n_tokens", F.lit(0).cast("long")).schema)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs)
    return out.select("doc_id", "n_tokens", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))

"""Substring dedup by a suffix array of the collection, built column-wise.

Exact repeats of `span` bytes across documents are found in four steps.

1. Texts are packed into batches of a few MB, once, and kept bucketed by batch, so joins move only what is sent to them.
   A text that a smaller document has as a whole goes as a whole; batches learn which from 128-bit digests, and such copies take no part in the rest.
2. Each window of `span` bytes belongs to its minimizer (its `seed`-byte string of least hash),
   and windows in a row with one minimizer form a segment of less than 2 * span bytes. Equal
   windows have equal minimizers, so minimizers that only one document has are left out.
3. The remaining segments are dealt by minimizer. In each part equal segments are merged (equal means equal minimizers,
   lengths and 64-bit hashes of all bytes), and the
   distinct ones that have a side of their minimizer in common with another form a collection whose Burrows-Wheeler transform is built column-wise: round j puts the j-th symbol
   from the end of every segment in its place, which its rank among equal symbols of the
   transform gives, and updates the common-prefix array from range minima. Transform, prefixes
   and the rows' origins are sequential files that each round reads and writes anew. Rows that
   share a prefix of at least `span` symbols are equal windows; the smallest doc_id of each goes
   back to the batches as runs.
4. Each batch removes the bytes of windows that start in a smaller document as well.

Work for one key is bounded by the number of distinct segments, not of documents: a batch sends
equal segments once, with the smallest doc_id.

Defined results: null text counts as empty; texts shorter than `span` stay whole; rows that repeat
a doc_id do not remove each other; rows without doc_id are neither sources nor changed; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.blocks import deal, part_of, unzip_arrays, zip_arrays
from gridlark.llm.common import MIX1, MIX2, MULT, bucketed, chunks, forget, lean, mix, ranges, shuffle_width, stored, window_minima

SPAN = 50
SEED = 20
SIDE = SEED + (SPAN - SEED) // 2  # every window has its minimizer with that many bytes on one side, the minimizer included
BATCH = 2 << 20
COLLECTION = 40_000  # segments that one Burrows-Wheeler transform holds, groups of one minimizer stay whole
NO_DOC = np.iinfo(np.int64).max  # sorts behind; whether a row has a doc_id is kept beside


def _at(b: np.ndarray, offset: int, n: int) -> np.ndarray:
    """Eight bytes from each place on, as numbers."""
    return np.ndarray((n,), np.uint64, b, offset, (1,))


def segments(text: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimizer hash and place, and identity hash of each segment.

    text: the concatenated texts; doc: the texts' ends. Windows over an end are left out.
    """
    n = len(text) - SPAN + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint8), empty.astype(np.uint64)
    pad = np.concatenate([text, np.zeros(SPAN + 16, np.uint8)])
    m = len(text) - SEED + 1
    h = _at(pad, 0, m) * MULT
    h += _at(pad, 8, m) * MIX1
    h += _at(pad, SEED - 8, m) * MIX2
    h ^= h >> np.uint64(32)
    h *= MIX1
    low, least = window_minima(h, SPAN - SEED + 1)
    ok = np.zeros(len(text) + 1, np.int32)
    starts = np.concatenate([[0], doc[:-1]])
    full = doc - starts >= SPAN
    np.add.at(ok, starts[full], 1)
    np.add.at(ok, doc[full] - SPAN + 1, -1)
    ok = np.cumsum(ok)[:n] > 0
    change = np.concatenate([[True], least[1:] != least[:-1]])
    change[1:] |= ok[1:] & ~ok[:-1]
    first = np.flatnonzero(change)
    size = np.diff(np.append(first, n))
    live = ok[first]
    # a run of windows with one minimizer may leave its text
    end = np.searchsorted(doc, first, "right")
    size = np.minimum(size, doc[np.minimum(end, len(doc) - 1)] - SPAN + 1 - first)
    first, size = first[live], size[live]
    seed = low[first] >> np.uint64(16)
    place = (least[first] - first).astype(np.uint8)
    return first, size, seed, place, identity(pad, first, size)


def identity(pad: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of whole segments: their first and last windows overlap, so these tell all bytes."""
    n = len(pad) - 8
    ident = size.astype(np.uint64)
    for at in (first, first + size - 1):
        for o in (0, 8, 16, 24, 32, 40, SPAN - 8):
            ident = ident * MULT + _at(pad, 0, n)[at + o]
            ident ^= ident >> np.uint64(29)
    return mix(ident)


def flank(pad: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the SIDE bytes from each place on."""
    n = len(pad) - 8
    h = np.zeros(len(at), np.uint64)
    for o in (*range(0, SIDE - 8, 8), SIDE - 8):
        h = h * MULT + _at(pad, 0, n)[at + o]
        h ^= h >> np.uint64(29)
    return mix(h)


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for i, t in enumerate(chunks(it, "text", BATCH)):
        texts = [x or b"" for x in t["text"].cast(pa.binary()).to_pylist()]
        ids = t["doc_id"].to_pylist()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        block = zip_arrays(np.array([NO_DOC if x is None else x for x in ids], np.int64), np.array([x is not None for x in ids]), size, flat)
        yield pa.record_batch({"batch": pa.array([part << 20 | i], pa.int64()), "block": pa.array([block], pa.binary())})


class Batch:
    """The texts of a batch without its copies, and their segments; the copies (doc_id, text) beside."""

    def __init__(self, block: bytes, copies: list[bytes] | None = None):
        self.ids, self.has_id, self.size, self.text = unzip_arrays(block, np.int64, np.bool_, np.int64, np.uint8)
        self.copies: list[tuple[int, np.ndarray]] = []
        if copies:
            begin = np.cumsum(self.size) - self.size
            at = np.concatenate([unzip_arrays(x, np.int32)[0] for x in copies])
            self.copies = [(int(self.ids[i]), self.text[begin[i] : begin[i] + self.size[i]]) for i in at.tolist()]
            live = np.ones(len(self.ids), bool)
            live[at] = False
            self.text = self.text[np.repeat(live, self.size)]
            self.ids, self.has_id, self.size = self.ids[live], self.has_id[live], self.size[live]
        self.ends = np.cumsum(self.size)

    def cut(self) -> Batch:
        """Find the segments."""
        self.first, self.count, self.seed, self.place, self.ident = segments(self.text, self.ends)
        row = np.searchsorted(self.ends, self.first, "right")
        self.owner = self.ids[row] if len(row) else np.zeros(0, np.int64)
        self.known = self.has_id[row] if len(row) else np.zeros(0, bool)  # rows without doc_id are no sources
        return self

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first of each kind of segment (by doc_id, place), and the kind of each segment."""
        order = np.lexsort((self.first, self.owner, ~self.known, self.seed, self.ident))
        x, y = self.ident[order], self.seed[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(order) else np.zeros(0, bool)
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        return order[new], kind


def _digests(n_parts: int):
    """Digests of each batch's texts of at least one window, with their doc_ids and rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for batch, block in zip(rb["batch"].to_pylist(), rb["block"].to_pylist(), strict=True):
                b = Batch(block)
                at = np.flatnonzero(b.has_id & (b.size >= SPAN))
                if not len(at):
                    continue
                begin = b.ends - b.size
                told = b"".join(hashlib.blake2b(b.text[begin[i] : b.ends[i]], digest_size=16).digest() for i in at.tolist())
                key = np.frombuffer(told, np.uint64).reshape(-1, 2)
                rows = [(i, zip_arrays(key[k, 0], key[k, 1], b.ids[at[k]], at[k].astype(np.int32))) for i, k in deal(part_of(key[:, 0], n_parts), n_parts)]
                yield pa.record_batch({"part": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([batch] * len(rows), pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _copied(t: pa.Table) -> pa.Table:
    """For each batch its rows whose whole text a smaller document has."""
    batches = t["batch"].to_numpy()
    cols = [unzip_arrays(x, np.uint64, np.uint64, np.int64, np.int32) for x in t["block"].to_pylist()]
    who = np.repeat(np.arange(len(cols)), [len(c[0]) for c in cols])
    high, low, doc, row = (np.concatenate([c[i] for c in cols]) for i in range(4))
    order = np.lexsort((doc, low, high))
    new = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
    copy = np.empty(len(order), bool)
    copy[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
    rows = [(int(batches[i]), zip_arrays(row[at[copy[at]]])) for i, at in deal(who, len(cols)) if copy[at].any()]
    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})


def _seeds(n_parts: int):
    """Distinct minimizers of each batch, marked where more than one document has them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for batch, block, copies in zip(rb["batch"].to_pylist(), rb["block"].to_pylist(), rb["copies"].to_pylist(), strict=True):
                b = Batch(block, copies).cut()
                seed, owner = b.seed[b.known], b.owner[b.known]
                order = np.argsort(seed, kind="stable")
                seed, owner = seed[order], owner[order]
                if not len(seed):
                    continue
                new = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
                many = np.maximum.reduceat(owner, new) != np.minimum.reduceat(owner, new)
                seed = seed[new]
                rows = [(i, zip_arrays(np.diff(seed[at], prepend=np.uint64(0)), many[at])) for i, at in deal(part_of(seed, n_parts), n_parts)]
                yield pa.record_batch({"part": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([batch] * len(rows), pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _shared(t: pa.Table) -> pa.Table:
    """Minimizers of one part that more than one document has, for each batch."""
    batches = t["batch"].to_numpy()
    seeds, many = zip(*(unzip_arrays(x, np.uint64, np.bool_) for x in t["block"].to_pylist()), strict=True)
    seeds = [np.cumsum(s, dtype=np.uint64) for s in seeds]
    who = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
    seed, many = np.concatenate(seeds), np.concatenate(many)
    order = np.argsort(seed, kind="stable")
    s = seed[order]
    same = s[1:] == s[:-1]
    twice = many[order].copy()
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(seed), bool)
    hit[order] = twice
    rows = [(int(batches[i]), zip_arrays(np.diff(seed[at][hit[at]], prepend=np.uint64(0)))) for i, at in deal(who, len(seeds)) if hit[at].any()]
    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})


def _candidates(n_parts: int):
    """Distinct segments with a shared minimizer, with the smallest doc_id of the batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for batch, block, copies, lists in zip(*(rb[c].to_pylist() for c in ("batch", "block", "copies", "lists")), strict=True):
                b = Batch(block, copies).cut()
                shared = np.sort(np.concatenate([np.cumsum(unzip_arrays(x, np.uint64)[0], dtype=np.uint64) for x in lists]))
                rep, _ = b.distinct()
                at = np.minimum(np.searchsorted(shared, b.seed[rep]), len(shared) - 1)
                rep = rep[(shared[at] == b.seed[rep]) & b.known[rep]]
                rows = []
                for i, k in deal(part_of(b.seed[rep], n_parts), n_parts):
                    r = rep[k]
                    r = r[np.argsort(b.seed[r], kind="stable")]
                    size = b.count[r] + SPAN - 1
                    flat = b.text[ranges(b.first[r], size)]
                    rows.append((i, zip_arrays(b.seed[r], b.owner[r], b.first[r], b.place[r], size.astype(np.uint8), flat)))
                if rows:
                    yield pa.record_batch({"part": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([batch] * len(rows), pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})

    return run


class Column:
    """The files of a collection's transform: symbols, common prefixes, and origin of each row."""

    KINDS = (("bwt", np.uint8), ("lcp", np.uint8), ("own", np.int32), ("len", np.uint8))

    def __init__(self, folder: str):
        self.folder, self.round = Path(folder), 0

    def read(self) -> list[np.ndarray]:
        return [np.fromfile(self.folder / f"{name}.{self.round}", kind) for name, kind in self.KINDS]

    def write(self, arrays: list[np.ndarray]) -> None:
        for (name, _), a in zip(self.KINDS, arrays, strict=True):
            a.tofile(self.folder / f"{name}.{self.round + 1}")
            if self.round:
                (self.folder / f"{name}.{self.round}").unlink()
        self.round += 1


def _least(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of lcp[low..high], both ends included, from minima of blocks of 2**k entries."""
    out = np.zeros(len(low), np.uint8)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    cur, k = lcp, 0
    order = np.argsort(level, kind="stable")
    cut = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
    for k in range(len(cut) - 1):
        if k:
            half = 1 << (k - 1)
            cur = np.minimum(cur[:-half], cur[half:])
        q = order[cut[k] : cut[k + 1]]
        if len(q):
            out[q] = np.minimum(cur[low[q]], cur[high[q] - (1 << k) + 1])
    return out


def column_wise(text: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Burrows-Wheeler transform, common prefixes, string and suffix length of all sorted suffixes.

    Round j inserts the suffixes of length j, one for each string that is so long. Symbol 0 is
    the place before a string; others are bytes plus 1. Prefixes are cut at 255.
    """
    n = len(size)
    ends = np.cumsum(size)
    starts = ends - size
    sym = text + np.uint8(1)
    with tempfile.TemporaryDirectory() as folder:
        col = Column(folder)
        col.write([np.where(size > 0, sym[np.maximum(ends - 1, 0)], 0).astype(np.uint8), np.zeros(n, np.uint8), np.arange(n, dtype=np.int32), np.zeros(n, np.uint8)])
        for j in range(1, int(size.max(initial=0)) + 1):
            bwt, lcp, own, length = col.read()
            rank = np.argsort(bwt, kind="stable")  # rows by symbol: a row's place is that of the suffix one symbol longer
            rank = rank[int((bwt == 0).sum()) :]
            fresh = np.flatnonzero(length[rank] == j - 1)
            new = np.zeros(n + len(rank), bool)
            new[n + fresh] = True
            r = rank[fresh]
            who = own[r]
            left = ends[who] - j - 1
            before = np.where(left >= starts[who], sym[np.maximum(left, 0)], 0).astype(np.uint8)
            out = []
            for old, value in ((bwt, before), (lcp, 0), (own, who), (length, j)):
                a = np.empty(len(new), old.dtype)
                a[~new] = old
                a[new] = value
                out.append(a)
            # common prefixes of inserted rows and of the rows behind them
            k = np.concatenate([fresh, fresh + 1])
            k = k[k < len(rank)]
            tie = (k > 0) & (bwt[rank[k]] == bwt[rank[np.maximum(k - 1, 0)]])
            value = np.zeros(len(k), np.uint8)
            t = k[tie]
            m = _least(lcp, rank[t - 1] + 1, rank[t])
            value[tie] = np.minimum(m, 254) + 1
            out[1][n + k] = value
            col.write(out)
        return col.read()


def window_docs(text: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each string: the string, its offset and the smallest doc of all equal windows."""
    _, lcp, own, length = column_wise(text, size)
    group = np.cumsum(lcp < SPAN)
    full = length >= SPAN
    own, length, group = own[full], length[full].astype(np.int64), group[full]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(doc[own], first), np.diff(np.append(first, len(own)))) if len(group) else np.zeros(0, np.int64)
    return own, size[own] - length, least


def _resolve(t: pa.Table) -> pa.Table:
    """Smallest documents of the windows of one part's segments, as runs for each batch."""
    batches = t["batch"].to_numpy()
    cols = [unzip_arrays(x, np.uint64, np.int64, np.int64, np.uint8, np.uint8, np.uint8) for x in t["block"].to_pylist()]
    who = np.repeat(np.arange(len(cols)), [len(c[0]) for c in cols])
    seed, owner, place = (np.concatenate([c[i] for c in cols]) for i in range(3))
    inner = np.concatenate([c[3] for c in cols]).astype(np.int64)
    size = np.concatenate([c[4] for c in cols]).astype(np.int64)
    flat = np.concatenate([*(c[5] for c in cols), np.zeros(SPAN + 16, np.uint8)])
    begin = np.cumsum(size) - size
    span = size - SPAN + 1
    ident = identity(flat, begin, span)
    order = np.lexsort((ident, seed))
    s, i = seed[order], ident[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])])
    at = np.flatnonzero(new)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    rep = order[at]  # distinct segments, by minimizer
    doc = np.minimum.reduceat(owner[order], at)
    # a segment that shares a window with another one shares one of its minimizer's sides
    off, n = inner[rep], size[rep]
    right, left = np.flatnonzero(off + SIDE <= n), np.flatnonzero(off >= SIDE - SEED)
    sides = np.concatenate([flank(flat, begin[rep[right]] + off[right]), flank(flat, begin[rep[left]] + off[left] - (SIDE - SEED)) ^ np.uint64(1)])
    _, back, many = np.unique(sides, return_inverse=True, return_counts=True)
    near = np.zeros(len(rep), bool)
    near[np.concatenate([right, left])[many[back] > 1]] = True
    near = np.flatnonzero(near)
    base = np.cumsum(span[rep]) - span[rep]
    least_of = np.repeat(doc, span[rep])
    # collections of whole minimizer groups
    lead = np.flatnonzero(np.concatenate([[True], seed[rep[near]][1:] != seed[rep[near]][:-1]])) if len(near) else []
    cuts = [0]
    for g, e in zip(lead, [*lead[1:], len(near)][: len(lead)], strict=True):
        if e - cuts[-1] > COLLECTION and g > cuts[-1]:
            cuts.append(int(g))
    for a, e in zip(cuts, [*cuts[1:], len(near)], strict=True):
        k = near[a:e]
        r = rep[k]
        own, off, least = window_docs(flat[ranges(begin[r], size[r])], size[r], doc[k])
        least_of[base[k[own]] + off] = least
    rows = []
    for b, mine in deal(who, len(cols)):
        k = kind[mine]
        n = span[mine]
        g = least_of[ranges(base[k], n)]
        seg = np.repeat(np.arange(len(mine)), n)
        off = ranges(np.zeros(len(mine), np.int64), n)
        run = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (g[1:] != g[:-1])]))
        length = np.diff(np.append(run, len(g)))
        tell = g[run] < owner[mine][seg[run]]
        run, length = run[tell], length[tell]
        if len(run):
            rows.append((int(batches[b]), zip_arrays(place[mine][seg[run]], off[run].astype(np.uint8), length.astype(np.uint8), g[run])))
    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.binary())})


def _cut(b: Batch, lists: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes of a batch go, and how many bytes and runs each text loses."""
    rep, kind = b.distinct()
    base = np.cumsum(b.count[rep]) - b.count[rep]
    least = np.repeat(np.where(b.known[rep], b.owner[rep], NO_DOC), b.count[rep])
    by_place = np.argsort(b.first[rep])
    for x in lists:
        place, off, n, doc = unzip_arrays(x, np.int64, np.uint8, np.uint8, np.int64)
        k = by_place[np.searchsorted(b.first[rep][by_place], place)]
        least[ranges(base[k] + off, n.astype(np.int64))] = np.repeat(doc, n)
    at = ranges(b.first, b.count)
    gone = (least[ranges(base[kind], b.count)] < np.repeat(b.owner, b.count)) & np.repeat(b.known, b.count)
    mark = np.zeros(len(b.text) + SPAN + 1, np.int32)
    s = at[gone]
    np.add.at(mark, s, 1)
    np.add.at(mark, s + SPAN, -1)
    cut = np.cumsum(mark)[: len(b.text)] > 0
    runs = cut & ~np.concatenate([[False], cut[:-1]])
    begin = b.ends - b.size
    runs[begin[b.size > 0]] = cut[begin[b.size > 0]]
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], b.ends])])
    return cut, total(cut), total(runs)


def _remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in it:
        for block, copies, lists in zip(*(rb[c].to_pylist() for c in ("block", "copies", "lists")), strict=True):
            b = Batch(block, copies)
            cut, removed, spans = _cut(b.cut(), lists or [])
            kept = [b.text[x:y][~cut[x:y]].tobytes() if n else b.text[x:y].tobytes() for n, x, y in zip(removed, b.ends - b.size, b.ends, strict=True)]
            ids = pa.array(b.ids, pa.int64(), mask=~b.has_id)
            yield pa.record_batch({"doc_id": ids, "n_bytes": b.size, "n_removed": removed.astype(np.int64), "n_spans": spans.astype(np.int64), "kept": pa.array(kept, pa.binary())})
            if b.copies:
                n = pa.array([len(t) for _, t in b.copies], pa.int64())
                yield pa.record_batch({"doc_id": pa.array([i for i, _ in b.copies], pa.int64()), "n_bytes": n, "n_removed": n, "n_spans": pa.array([1] * len(n), pa.int64()), "kept": pa.array([b""] * len(n), pa.binary())})


def _changed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that lost bytes: doc_id, the digest of the text as it was, and what is left of it."""
    for rb in it:
        for block, copies, lists in zip(*(rb[c].to_pylist() for c in ("block", "copies", "lists")), strict=True):
            b = Batch(block, copies)
            cut, removed, _ = _cut(b.cut(), lists or [])  # a batch that is told nothing may have repeats of its own
            rows = [(int(b.ids[i]), b.text[x:y], cut[x:y]) for i, (n, x, y) in enumerate(zip(removed, b.ends - b.size, b.ends, strict=True)) if n]
            rows += [(i, t, np.ones(len(t), bool)) for i, t in b.copies]
            text = [t[~c].tobytes().decode("utf-8", "ignore") for _, t, c in rows]  # a cut may leave part of a character
            yield pa.record_batch({"_id": pa.array([r[0] for r in rows], pa.int64()), "_sha": pa.array([hashlib.sha256(r[1].tobytes()).hexdigest() for r in rows], pa.string()), "_text": pa.array(text, pa.string())})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept): each text without what smaller documents have."""
    _, texts, runs = _found(docs)
    return texts.join(runs, "batch", "left").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The packed texts, the same with the rows that are copies, and the runs of repeated windows (batch, lists)."""
    spark = lean(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = shuffle_width(spark)
    packed = bucketed(own.mapInArrow(_pack, "batch long, block binary"), "batch", width)
    n_parts = max(width, packed.count() // 2)
    row = "part int, batch long, block binary"
    digests = packed.select("batch", "block").mapInArrow(_digests(width), row)
    copies = digests.groupBy("part").applyInArrow(_copied, "batch long, block binary").groupBy("batch").agg(F.collect_list("block").alias("copies"))
    texts = packed.join(stored(copies, "copies"), "batch", "left")
    seeds = texts.mapInArrow(_seeds(n_parts), row)
    lists = seeds.groupBy("part").applyInArrow(_shared, "batch long, block binary").groupBy("batch").agg(F.collect_list("block").alias("lists"))
    found = texts.join(lists, "batch").mapInArrow(_candidates(n_parts), row)
    runs = found.groupBy("part").applyInArrow(_resolve, "batch long, block binary").groupBy("batch").agg(F.collect_list("block").alias("lists"))
    return packed, texts, runs


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeats cut from their texts; those of which nothing is left go. Rows that share a doc_id have each their own text."""
    packed, texts, runs = _found(docs)
    cut = texts.join(runs, "batch", "left").mapInArrow(_changed, "_id long, _sha string, _text string").dropDuplicates(["_id", "_sha"])
    cut = stored(cut, "cut")
    forget(packed)
    both = docs.join(cut, (docs["doc_id"] == F.col("_id")) & (F.sha2(docs["text"], 256) == F.col("_sha")), "left").filter("_text is null or length(trim(_text)) > 0")
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col("_text").isNull(), F.col("n_chars")).otherwise(F.length("_text").cast("long")))
    return both.withColumn("text", F.coalesce("_text", "text")).select(*docs.columns)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same by definition, for small inputs."""
    least: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        if i is not None:
            for k in range(len(t) - SPAN + 1):
                w = t[k : k + SPAN]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        cut = np.zeros(len(t), bool)
        for k in range(len(t) - SPAN + 1):
            if i is not None and least[t[k : k + SPAN]] < i:
                cut[k : k + SPAN] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~cut])
        spans = int((cut & ~np.concatenate([[False], cut[:-1]])).sum()) if len(t) else 0
        out.append((i, len(t), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out

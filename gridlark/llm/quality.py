"""Quality rules: base statistics and perplexity bands of a modified Kneser-Ney word model.

The model (see wordmodel) is counted by Spark over all documents that pass the base rule, is kept in
sorted hash arrays in hash partitions, and grows with the input; each document is judged by what all
others say. Two perplexities are banded for each language, q1 to q3 its quartiles over the documents that
pass the base rule, n a document's number of words (few words vary more):

* by the model, an upper bound: q2 + 4 (q3 - q2) + 4 / sqrt(n). It has no lower bound, since copies, which
  later stages remove, vouch for each other and score low.
* by its lower order, which copies hardly move: from q1 - 1.75 (q3 - q1) - 1.5 / sqrt(n) to
  q3 + 2 (q3 - q1) + 3 / sqrt(n). Menus and lists of few common words lie below, strange words above.

Defined results: null or empty text has no words and fails the base rule; a null language
is the language `und`; repeated rows give repeated results and vouch for each other; an empty table gives
an empty table; columns other than doc_id, text and lang are ignored. Words are split on ASCII white
space only. A document is kept if it passes the base rule and lies within the bands; perplexities are null
for documents that fail the base rule and where a language has no other document, and then decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm import wordmodel
from gridlark.llm.common import chunks, lean, mix, quartiles, ranges, release, row_key, stored, word_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
BATCH = 2 << 20
LANGUAGES = 10_000  # so many rows of bands are broadcast at most

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_stats(texts: list[bytes | None]) -> tuple[dict[str, np.ndarray], np.ndarray, list[bytes], np.ndarray]:
    """The base statistics of a batch; also word ids, the distinct words, and words of each text."""
    ids: dict[bytes, int] = {}
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    flat: list[int] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        words = text.split()
        out["n_words"][i] = len(words)
        for w in words:
            flat.append(ids.setdefault(w, len(ids)))
        out["n_symbols"][i] = len(text) - len(text.translate(None, SYMBOLS))
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    size = out["n_words"]
    word_of = np.array(flat, np.int64)
    names = list(ids)
    points = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in names), np.int64, len(names))
    doc = np.repeat(np.arange(n), size)
    out["word_chars"] = np.bincount(doc, points[word_of] if len(names) else None, n).astype(np.int64)
    k = 8
    many = np.flatnonzero(size >= k)
    starts = (np.cumsum(size) - size)[many]
    count = size[many] - k + 1
    at = ranges(starts, count)
    if len(at):
        h = mix(doc[at].astype(np.uint64) + np.uint64(1 << 40))
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mix(word_of[at + j].astype(np.uint64))
        h = mix(h)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        mark = np.zeros(len(word_of) + 1, np.int64)
        s = at[twice]
        np.add.at(mark, s, 1)
        np.add.at(mark, s + k, -1)
        covered = np.cumsum(mark)[:-1] > 0
        out["n_repeat_words"] = np.bincount(doc[covered], minlength=n).astype(np.int64)
    return out, word_of, names, doc


def _units(min_words: int, repeat_percent: int):
    """Units of the word model with the documents' statistics; documents that fail the base rule have no tokens in them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = wordmodel.Units()
        kind = None

        def batch(batch: int, lang: str, block: bytes, rows: list) -> pa.RecordBatch:
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [kind, *[pa.int64()] * len(STATS), pa.bool_()], strict=True)]
            rows = pa.StructArray.from_arrays(cols, ["doc_id", *STATS, "base_failed"])
            return pa.record_batch({"batch": pa.array([batch], pa.int64()), "lang": pa.array([lang]), "block": pa.array([block], pa.binary()), "rows": pa.ListArray.from_arrays([0, len(rows)], rows)})

        for t in chunks(it, "text", BATCH):
            kind = t["doc_id"].type
            stats, word_of, names, _ = base_stats(t["text"].cast(pa.binary()).to_pylist())
            n = stats["n_words"]
            failed = (n < min_words) | (100 * stats["n_repeat_words"] > repeat_percent * n)
            token = word_hashes(names)[word_of]
            start = np.cumsum(n) - n
            used = np.where(failed, 0, n)
            rows = list(zip(t["doc_id"].to_pylist(), *(stats[c].tolist() for c in STATS), failed.tolist(), strict=True))
            of: dict[str, list[int]] = {}
            for i, x in enumerate(t["lang"].to_pylist()):
                of.setdefault(x or "und", []).append(i)
            for lang, at in of.items():
                for u in units.add(lang, used[at], token[ranges(start[at], used[at])], [rows[i] for i in at]):
                    yield batch(*u)
        for u in units.rest():
            yield batch(*u)

    return run


def quality(docs: DataFrame, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """One row for each document: base statistics, log perplexities, their bands, base_failed and kept."""
    lean(docs.sparkSession)
    own = docs.select("doc_id", "text", "lang")
    row = f"doc_id {dict(own.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean"
    inner = ", ".join(x.replace(" ", ":", 1) for x in row.split(", "))
    units = own.mapInArrow(_units(min_words, repeat_percent), f"batch long, lang string, block binary, rows array<struct<{inner}>>")
    p, lower = "log_perplexity", "word_log_perplexity"
    scored = wordmodel.scored(units, row).withColumns({c: F.round(c, 6) for c in (p, lower)})
    q = quartiles(scored.filter("not base_failed"), "lang", p, lower)
    spread = F.col(f"q3_{lower}") - F.col(f"q1_{lower}")
    q = stored(q.select(
        "lang", (F.col(f"q2_{p}") + 4 * (F.col(f"q3_{p}") - F.col(f"q2_{p}"))).alias("high"),
        (F.col(f"q1_{lower}") - 1.75 * spread).alias("word_low"), (F.col(f"q3_{lower}") + 2 * spread).alias("word_high"),
    ), "bands")
    few = F.sqrt(F.col("n_words"))
    inside = (F.col(p) <= F.col("high") + 4 / few) & F.col(lower).between(F.col("word_low") - 1.5 / few, F.col("word_high") + 3 / few)
    q = F.broadcast(q) if q.count() <= LANGUAGES else q
    return scored.join(q, "lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns: each row by its own text and language, whatever its doc_id."""
    own = docs.select(row_key("text", "lang").alias("doc_id"), "text", "lang")
    ok = stored(quality(own).filter("kept").select(F.col("doc_id").alias("_kept_key")).distinct(), "good")
    release(docs.sparkSession)
    return docs.join(ok, row_key("text", "lang") == F.col("_kept_key"), "left_semi")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_perplexity", "word_log_perplexity", "high", "word_low", "word_high")

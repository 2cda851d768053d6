"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A template of n words is sought in blocks of w words, w the least power of two from 64 on that is at least 2 n, one
block each half block: so an occurrence lies whole in some block, however long the template is. A block meets
a template when at least `share` of the template's distinct words are in it. The words of all templates are ordered by
their frequency over all documents. A template that needs o of its n distinct words must have one of its
n - o + 1 rarest ones in the block (prefix filter), the block must have o template words (length
filter), and from the first common word on both must have enough words left (position filter);
what is left is verified on the whole sets. DataFrame functions only.

Defined results: null or empty text has no words, null places and empty labels; equal places are
counted once per phrase; repeated rows give repeated results, also with null or equal doc_id;
extra columns are ignored; an empty table gives an empty table. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import forget, stored

BLOCK = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {
    "apache license": "apache",
    "cc by": "cc-by",
    "gnu general public license": "gpl",
    "mit license": "mit",
}

# Public license texts and notices, with their labels.
TEMPLATES = [
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0-notice", (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    )),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    )),
    ("boost-1.0", (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    )),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-notice", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see http://www.gnu.org/licenses/."
    )),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies."
    )),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit-text", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    )),
    ("zlib", (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    )),
]


def normal(text: Column) -> Column:
    """The words, lower-cased, with one space between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, " "))


def template_words(text: str) -> list[str]:
    return re.sub(BETWEEN, " ", "".join(c.lower() if c.isascii() else c for c in text)).split(" ")


def block_words(n: int) -> int:
    """Words in the blocks in which a template of n words is sought."""
    return max(BLOCK, 1 << (2 * n - 1).bit_length())


def _phrases(s: Column) -> dict[str, Column]:
    """Places of the phrases in s, which has a space before and after each word."""
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    count, first, last, label = [], [], [], []
    for phrase, name in PHRASES.items():
        p = f" {phrase} "
        has = F.contains(s, F.lit(p))
        count.append(F.when(has, F.regexp_count(s, F.lit(f"(?={p})"))).otherwise(0))
        first.append(F.when(has, spaces(F.substr(s, F.lit(1), F.instr(s, p))) - 1))
        end = F.instr(F.reverse(s), p[::-1])
        last.append(F.when(has, spaces(F.substr(s, F.lit(1), F.length(s) - end + 1 - len(p) + 1)) - 1))
        label.append(F.when(has, F.lit(name)))
    return {
        "n_base": reduce(lambda a, b: a + b, count).cast("long"), "first_word": F.least(*first).cast("long"), "last_word": F.greatest(*last).cast("long"),
        "base": F.array_compact(F.array(*label)),
    }


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, share: float = 0.8) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    spark = docs.sparkSession
    own = [(label, [w for w in template_words(t) if w]) for label, t in (TEMPLATES if templates is None else templates)]
    sets = [(label, sorted(set(w)), block_words(len(w))) for label, w in own if w]
    vocab = sorted({w for _, ws, _ in sets for w in ws})  # bounded by the templates, not by the data
    words = stored(docs.select("doc_id", normal(F.col("text")).alias("s")), "words").withColumn("w", F.split("s", " "))
    freq = words.select(F.explode("w").alias("w")).filter(F.col("w").isin(vocab)).groupBy("w").agg(F.count("*").alias("n"))
    seen = {r.w: r.n for r in freq.collect()}
    order = {w: i for i, w in enumerate(sorted(vocab, key=lambda w: (seen.get(w, 0), w)))}
    rows = []
    for i, (label, ws, width) in enumerate(sets):
        ranks = sorted(order[w] for w in ws)
        need = math.ceil(share * len(ranks) - 1e-9)
        rows.append((i, label, width, ranks, len(ranks), need, ranks[: len(ranks) - need + 1]))
    ts = spark.createDataFrame(rows, "t int, label string, width int, ranks array<int>, n int, need int, prefix array<int>")
    at = sorted(order, key=order.get)
    rare = sorted({k for r in rows for k in r[6]})

    padded = F.concat(F.lit(" "), F.col("s"), F.lit(" "))
    hit = F.arrays_overlap("w", F.array(*[F.lit(at[k]) for k in rare])) if rare else F.lit(False)
    base = words.withColumn("p", padded).select(
        "doc_id", F.when(F.col("s") == "", 0).otherwise(F.size("w")).cast("long").alias("n_words"),
        *[c.alias(k) for k, c in _phrases(F.col("p")).items()], F.when(hit, F.col("w")).alias("w"),
    )
    base = stored(base.withColumn("row", F.monotonically_increasing_id()), "scan")  # written, so the row numbers stay
    forget(words)

    ranks = F.create_map(*[x for w, k in order.items() for x in (F.lit(w), F.lit(k))]) if order else F.create_map().cast("map<string,int>")
    wide = F.array(*[F.lit(x) for x in sorted({x for _, _, x in sets})]).cast("array<int>")
    half = F.shiftright("width", 1)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - half), half)
    blocks = base.filter("w is not null").select("row", "w", F.explode(wide).alias("width"))
    blocks = blocks.select("row", "width", F.posexplode(F.transform(starts, lambda i: F.slice("w", i, F.col("width")))).alias("block", "bw"))
    own = F.array_sort(F.array_distinct(F.filter(F.transform("bw", lambda x: F.try_element_at(ranks, x)), lambda x: x.isNotNull())))
    blocks = blocks.select("row", "width", "block", own.alias("b")).withColumn("size", F.size("b"))
    index = ts.select("t", "label", "width", "ranks", "n", "need", F.posexplode("prefix").alias("i", "rank"))
    found = blocks.select("row", "width", "block", "b", "size", F.posexplode("b").alias("j", "rank")).join(F.broadcast(index), ["width", "rank"])  # as many rows as the templates' prefixes have words
    found = found.filter((F.col("size") >= F.col("need")) & (F.least(F.col("n") - F.col("i"), F.col("size") - F.col("j")) >= F.col("need")))
    common = F.size(F.array_intersect("b", "ranks"))
    found = found.withColumn("common", common).filter(F.col("common") >= F.col("need"))
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("common") / F.col("n")).alias("best"))
    out = base.drop("w").join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).cast("double").alias("score"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    own = [(label, [w for w in template_words(t) if w]) for label, t in TEMPLATES]
    ts = ",\n".join("('{}', {}, {})".format(label, block_words(len(w)), str(sorted(set(w)))) for label, w in own)
    ps = ",\n".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH t(label, width, ws) AS (VALUES {ts}),
p(phrase, k, label) AS (VALUES {ps}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
hits AS (SELECT doc_id, i - 1 AS pos, p.label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE list_contains(w, 'license') OR list_contains(w, 'cc')) x, p
         WHERE array_to_string(w[i:i + k - 1], ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id),
v AS (SELECT list(DISTINCT x) AS vs FROM (SELECT unnest(ws) AS x FROM t)),
tw AS (SELECT doc_id, w FROM w, v WHERE len(list_intersect(w, vs)) >= 5),
bl AS (SELECT doc_id, width, w[i:i + width - 1] AS bw FROM (SELECT doc_id, w, width, unnest(range(1, greatest(1, len(w) - width // 2) + 1, width // 2)) AS i FROM tw, (SELECT DISTINCT width FROM t))),
m AS (SELECT doc_id, t.label, len(list_intersect(bw, ws)) / len(ws)::DOUBLE AS s FROM bl JOIN t ON bl.width = t.width WHERE len(list_intersect(bw, ws)) >= ceil(0.8 * len(ws) - 1e-9)),
g AS (SELECT doc_id, list(DISTINCT label) AS labels, max(s) AS s FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ','), '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(g.s, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = w.doc_id
"""


OP4_SQL = _sql()

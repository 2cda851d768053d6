"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns;
the last returns pieces and their round trip. Every stage's result is written as Parquet into the
shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import stored
from gridlark.llm.decontaminate import drop_leaks
from gridlark.llm.jaccard import keep_one
from gridlark.llm.quality import keep_good
from gridlark.llm.sentencepiece import encode_decode
from gridlark.llm.suffix import cut_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the perplexity band of their language."""
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller doc_id has."""
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text."""
    out = encode_decode(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", jaccard_join),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("ids", F.array_join("ids", " "))


# Counts of a language model and encodings by a tokenizer are not expressible in SQL.
ORACLE_SQL = None

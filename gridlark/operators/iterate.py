"""Scratch tables for driver loops: cutting lineage in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a fresh one for a single machine; an error on a cluster, whose
    executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_gridlark_scratch", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.sparkContext._gridlark_scratch = "file://" + tempfile.mkdtemp(prefix="spark-")
    return base.rstrip("/")


def saved(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back; `instead` is a saved table that it takes the place of, which goes."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead is not None:
        for old in {f.rsplit("/", 1)[0] for f in instead.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(old)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return spark.read.schema(df.schema).parquet(path)

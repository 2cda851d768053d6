"""Evaluation: errors, correlations, quantiles, shares, partial dependence."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.operators.iterate import saved


def error_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, target mean, MAE, relative MAE and R2, in all or by group; one pass, with moments taken from the mean."""
    y, p = F.col(actual), F.col(predicted)
    aggs = [
        F.count("*").alias("n_rows"), F.avg(y).alias("target_mean"), F.avg(F.abs(y - p)).alias("mae"), F.sum(F.pow(y - p, 2)).alias("_res"),
        (F.var_pop(y) * F.count(y)).alias("_tot"),
    ]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return out.select(
        *by, "n_rows", "target_mean", "mae", F.when(F.col("target_mean") > 0, F.col("mae") / F.col("target_mean")).alias("relative_mae"),
        F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.col("_tot")).alias("r2"),
    )


def pearson(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation of each column with the target, as rows."""
    one = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns])).alias("x")).select("x.*")


def range_rank(df: DataFrame, column: str, name: str, weight: str | None = None) -> DataFrame:
    """Rank of each row by a column of distinct values, from 1; with a weight the sum of the weights up to and with the row.

    Rows are dealt by value ranges and written once with the number of their part, so the parts' totals and the ranks
    inside them come from the same dealing; no task sorts all rows.
    """
    one = F.col(weight) if weight else F.lit(1)
    v = saved(df.repartitionByRange(column).withColumn("_p", F.spark_partition_id()), "ranges")
    parts = v.groupBy("_p").agg(F.sum(one).alias("_t"))
    parts = parts.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_b"))  # a row a part
    inside = Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    return v.withColumn("_s", F.sum(one).over(inside)).join(parts, "_p").withColumn(name, F.col("_b") + F.col("_s")).drop("_p", "_s", "_b")


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks with ties averaged, from counts of distinct values."""
    v = range_rank(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_k")), column, "_r", "_k")
    return df.join(v.select(column, (F.col("_r") - (F.col("_k") - 1) / 2).alias(name)), column)


def spearman(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    out = df.select(*columns, target)
    for c in (*columns, target):
        out = average_rank(out, c, f"_r_{c}")
    one = out.agg(*[F.corr(f"_r_{c}", f"_r_{target}").alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns])).alias("x")).select("x.*")


def quantile_grid(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95, n: int = 10, accuracy: int = 10_000) -> DataFrame:
    """Exact linear-interpolation quantiles (bin, value) at n even shares; repeats stay. Without values there is no row.

    A sketch first brackets each quantile, wide enough for its bound on the error; then only values inside the brackets are counted, and
    ranked with what lies below them. So no pass shuffles or writes the rows.
    """
    v = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    total = v.count()
    if not total:
        return df.sparkSession.createDataFrame([], "bin int, value double")
    at = [(low + (high - low) * i / (n - 1)) * (total - 1) for i in range(n)]
    slack = 2 + 2 * total / accuracy  # ranks
    ends = [min(1.0, max(0.0, (math.floor(x) + side) / total)) for x in at for side in (-slack, 2 + slack)]
    cut = v.agg(F.percentile_approx("v", ends, accuracy)).first()[0]
    bins = [(i, cut[2 * i], cut[2 * i + 1], math.floor(at[i]), at[i] - math.floor(at[i])) for i in range(n)]
    inside = lambda lo, hi: (F.col("v") >= lo) & (F.col("v") <= hi)
    below = v.agg(*[F.count_if(F.col("v") < lo).alias(f"b{i}") for i, lo, *_ in bins])
    below = below.select(F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.col(f"b{i}").alias("b"), F.lit(k).alias("k"), F.lit(part).alias("part")) for i, _, _, k, part in bins])).alias("x")).select("x.*")
    near = v.select("v", F.explode(F.filter(F.array(*[F.when(inside(lo, hi), F.lit(i)) for i, lo, hi, *_ in bins]), lambda x: x.isNotNull())).alias("bin"))
    near = near.groupBy("bin", "v").agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy("bin").orderBy("v"))  # a few thousandths of the rows
    rank = near.withColumn("r", up_to).join(F.broadcast(below), "bin").withColumn("r", F.col("r") + F.col("b"))  # n rows
    holds = lambda k: (F.col("r") > k) & (F.col("r") - F.col("c") <= k)
    one = F.max(F.when(holds(F.col("k")), F.col("v"))) * (1 - F.first("part")) + F.coalesce(F.max(F.when(holds(F.col("k") + 1), F.col("v"))) * F.first("part"), F.lit(0.0))
    return rank.groupBy("bin").agg(one.alias("value"))


def partial_dependence(sample: DataFrame, grid: Sequence[tuple], score: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows (ix, iy, x, y, value): the mean clipped score(x, y) over the sample for each cell (ix, iy, x, y) of a fixed grid.

    All cells are aggregates of one pass, so rows are never multiplied by the grid.
    """
    cells = [F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score(F.lit(x), F.lit(y))))).alias(f"c{i}") for i, (_, _, x, y) in enumerate(grid)]
    told = F.array(*[F.struct(F.lit(ix).alias("ix"), F.lit(iy).alias("iy"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("value")) for i, (ix, iy, x, y) in enumerate(grid)])
    return sample.agg(*cells).select(F.explode(told).alias("g")).select("g.*")


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    total = df.agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("_total") != 0, F.col(value) / F.col("_total"))).drop("_total")  # one row


def mean_abs_by_position(df: DataFrame, vector: str) -> DataFrame:
    """Mean absolute value of each place of an array column, as attribution importances are summed up."""
    return df.select(F.posexplode(vector).alias("feature", "v")).groupBy("feature").agg(F.avg(F.abs("v")).alias("mean_abs"))

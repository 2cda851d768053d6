"""Small relational operators: ranges, keep-first, pivots, random splits, and joins to a dimension."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.timefn import ceil_hour


def between_closed(df: DataFrame, time: str, start: Column, end: Column) -> DataFrame:
    """Rows from start to end, both included."""
    return df.filter(F.col(time).between(start, end))


def within_hours(df: DataFrame, time: str, start: Column, end: Column) -> DataFrame:
    """Rows of the whole hours that a range touches: from its first hour's begin to its last hour's end."""
    return df.filter((F.col(time) >= F.date_trunc("hour", start).cast("timestamp_ntz")) & (F.col(time) <= ceil_hour(end)))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an order."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def pivot_mean(df: DataFrame, row: str, column: str, values: Sequence, value: str) -> DataFrame:
    """Means of a value by row and column, the stated column values as columns."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(value))


def random_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Column `part`: test for about this share of the rows, by a multiplicative hash of an integer key; runs repeat."""
    prime = 2_147_483_647
    at = F.pmod((F.pmod(F.col(key), F.lit(prime)) + seed) * 48_271, F.lit(prime))
    return df.withColumn("part", F.when(at < F.lit(int(share * prime)), "test").otherwise("train"))


def with_dimension(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """All facts with their dimension's columns, null where it has no row; the dimension's first row of a key counts."""
    return facts.join(keep_first(dimension, [key], [c for c in dimension.columns if c != key]), key, "left")


def has_columns(df: DataFrame, columns: Iterable[str]) -> bool:
    return set(columns) <= set(df.columns)


def parse_time(c: Column) -> Column:
    """The timestamp of a text; null stays null, a text that is no timestamp fails the query and is named."""
    t = c.try_cast("timestamp_ntz")
    return F.when(c.isNull() | t.isNotNull(), t).otherwise(F.raise_error(F.concat(F.lit("not a timestamp: "), c)).cast("timestamp_ntz"))


def half_even(c: Column, digits: int) -> Column:
    """Rounded to the nearest, halves to the even neighbour."""
    return F.bround(c, digits)


def typed_params(params: dict, whole: Iterable[str], real: Iterable[str]) -> dict:
    """Parameters with some as whole numbers and some as real ones, others as they are; a nested best_params is taken out."""
    params = params.get("best_params", params)
    whole, real = set(whole), set(real)
    return {k: int(v) if k in whole else float(v) if k in real else v for k, v in params.items()}


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a multiplicative hash of an integer key: a per-task top-n and a merge; runs repeat."""
    prime = 2_147_483_647
    at = F.pmod((F.pmod(F.col(key), F.lit(prime)) + seed) * 48_271, F.lit(prime))
    return df.orderBy(at, key).limit(n)


def fill_chain(df: DataFrame, column: str, others: Sequence[str], default=None, zero_is_missing: bool = False) -> DataFrame:
    """A column's missing values from other columns in turn, then a constant; zeros may count as missing."""
    own = F.when(F.col(column) != 0, F.col(column)) if zero_is_missing else F.col(column)
    return df.withColumn(column, F.coalesce(own, *[F.col(c) for c in others], *([] if default is None else [F.lit(default)])))


def adjacency(edges: DataFrame) -> DataFrame:
    """Rows (u, near): each node's neighbours (v, w) as one array in order of v; a node's edges are few."""
    return edges.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("v", "w"))).alias("near"))


def joined_paths(left: Column, right: Column) -> Column:
    """Two node lists that meet in a node, as one list; the second may run from its far end."""
    return F.when(F.element_at(left, -1) == right[0], F.concat(left, F.slice(right, 2, F.greatest(F.size(right) - 1, F.lit(0))))).otherwise(F.concat(left, F.slice(F.reverse(right), 2, F.greatest(F.size(right) - 1, F.lit(0)))))


def json_or(c: Column, path: str, default: str) -> Column:
    """The text at a path of a JSON text, or a default."""
    return F.coalesce(F.get_json_object(c, path), F.lit(default))


def mask_rings(rings: DataFrame, margin: float = 1.0) -> DataFrame:
    """Rows (polygon, ring, points) of the area outside: a box around all rings with the outer rings as its holes."""
    at = rings.select(F.explode("points").alias("p")).agg(F.min("p.lon").alias("w"), F.max("p.lon").alias("e"), F.min("p.lat").alias("s"), F.max("p.lat").alias("n"))
    place = lambda x, dx, y, dy: F.struct((F.col(x) + dx).alias("lon"), (F.col(y) + dy).alias("lat"))
    box = F.array(place("w", -margin, "s", -margin), place("e", margin, "s", -margin), place("e", margin, "n", margin), place("w", -margin, "n", margin))
    holes = rings.filter("ring = 0").select(F.lit(0).alias("polygon"), (F.col("polygon") + 1).cast("int").alias("ring"), "points")
    return at.select(F.lit(0).alias("polygon"), F.lit(0).alias("ring"), box.alias("points")).unionByName(holes)

"""Output helpers: both sides of a comparison round and format alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "%Y-%m-%d %H:%M:%S"


def r6(name: str, c: Column | str | None = None) -> Column:
    c = F.col(name) if c is None else F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name)  # no negative zero


def stamp(name: str, c: Column | None = None) -> Column:
    return F.date_format(F.col(name) if c is None else c, "yyyy-MM-dd HH:mm:ss").alias(name)


def big(name: str, c: Column | str | None = None) -> Column:
    c = F.col(name) if c is None else F.col(c) if isinstance(c, str) else c
    return c.cast("long").alias(name)


def s6(expr: str, name: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0.0::DOUBLE) AS {name}"


def st(expr: str, name: str) -> str:
    return f"strftime({expr}, '{STAMP}') AS {name}"


def sb(expr: str, name: str) -> str:
    return f"({expr})::BIGINT AS {name}"

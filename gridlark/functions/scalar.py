"""Small column functions: safe numbers, clips, parsing, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(c: Column, default: float = 0.0) -> Column:
    """Parse or default; never fails."""
    return F.coalesce(F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double"), F.lit(float(default)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    """Within low and high; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def is_close(a: Column, b: Column, rel: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.lit(rel) * F.greatest(F.abs(a), F.abs(b))


def balanced_score(drive_min: Column, max_drive_min: float, occupancy: Column, weight: float = 1.0) -> Column:
    """Lower is better; null if either part is."""
    return drive_min / F.lit(float(max_drive_min)) + F.lit(float(weight)) * occupancy


def occupancy_badge(c: Column) -> Column:
    return F.when(c.isNull(), "Unknown").when(c < 0.35, "Low").when(c <= 0.7, "Medium").otherwise("High")


def list_literal(c: Column) -> Column:
    """Values of "['a', 'b']" or of a plain scalar, lower-cased and trimmed."""
    inner = F.regexp_replace(c, r"[\[\]'\"]", "")
    return F.transform(F.split(inner, ","), lambda x: F.lower(F.trim(x)))


def parse_coordinates(c: Column) -> tuple[Column, Column]:
    """(lat, lon) of "a, b" with a comma of either width or a space; swapped when only that is in range."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*[,，\s]\s*(-?\d+(?:\.\d+)?)\s*$"
    a, b = (F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("double") for i in (1, 2))
    straight = (F.abs(a) <= 90) & (F.abs(b) <= 180)
    swapped = (F.abs(b) <= 90) & (F.abs(a) <= 180)
    return F.when(straight, a).when(swapped, b), F.when(straight, b).when(swapped, a)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_runtime(seconds: Column) -> Column:
    """Milliseconds below one second, else seconds with two digits; a dash where there is no number."""
    return F.when(seconds.isNull(), "-").when(seconds < 1, F.format_string("%.0f ms", seconds * 1000)).otherwise(F.format_string("%.2f s", seconds))


def format_fixed(c: Column, unit: str = "") -> Column:
    """Two digits after the point; a dash where there is no number."""
    return F.when(c.isNull(), "-").otherwise(F.format_string(f"%.2f{unit}", c))


def format_percent(c: Column) -> Column:
    """A share as a percentage with one digit; a dash where there is no number."""
    return F.when(c.isNull(), "-").otherwise(F.format_string("%.1f%%", c * 100))

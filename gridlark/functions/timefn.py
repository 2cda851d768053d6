"""Calendar and clock expressions over naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public holidays.
HOLIDAYS = [
    "2022-09-10", "2022-09-11", "2022-09-12", "2022-10-01", "2022-10-02", "2022-10-03", "2022-10-04", "2022-10-05", "2022-10-06", "2022-10-07",
    "2022-12-31", "2023-01-01", "2023-01-02", "2023-01-21", "2023-01-22", "2023-01-23", "2023-01-24", "2023-01-25", "2023-01-26", "2023-01-27",
]


def floor_minutes(t: Column, minutes: int) -> Column:
    """Start of the time's slot of so many minutes within its hour."""
    m = F.minute(t)
    return F.date_trunc("hour", t).cast("timestamp_ntz") + F.make_dt_interval(mins=m - m % minutes)


def add_minutes(t: Column, minutes: Column) -> Column:
    """Fractional minutes allowed."""
    return t + F.make_dt_interval(secs=(minutes * 60).cast("decimal(18,6)"))


def ceil_hour(t: Column) -> Column:
    h = F.date_trunc("hour", t).cast("timestamp_ntz")
    return F.when(h == t, h).otherwise(h + F.make_dt_interval(hours=F.lit(1)))


def calendar(df: DataFrame, time: str = "time", prefix: str = "", holidays: list[str] | None = None) -> DataFrame:
    """hour, weekday (Monday 0), cyclic hour, holiday and peak flags of a time column."""
    t, h = F.col(time), F.hour(time)
    angle = F.lit(2.0) * F.pi() * h / 24
    return df.withColumns({
        f"{prefix}hour": h, f"{prefix}weekday": F.weekday(t), f"{prefix}hour_sin": F.sin(angle), f"{prefix}hour_cos": F.cos(angle),
        f"{prefix}is_holiday": F.date_format(t, "yyyy-MM-dd").isin(HOLIDAYS if holidays is None else holidays).cast("int"),
        f"{prefix}is_morning_peak": h.between(7, 9).cast("int"), f"{prefix}is_evening_peak": h.between(17, 19).cast("int"),
    })


# The week that a wall clock is mapped onto.
REPLAY_MONDAY, REPLAY_LAST = "2023-02-06", "2023-02-12 23:55:00"


def replay_clock(t: Column, monday: str = REPLAY_MONDAY, last: str = REPLAY_LAST) -> Column:
    """Map a wall clock onto a fixed week by weekday, hour and five-minute slot."""
    base = F.lit(monday).cast("timestamp_ntz")
    minute = F.minute(t)
    out = base + F.make_dt_interval(days=F.weekday(t), hours=F.hour(t), mins=minute - minute % 5)
    return F.least(out, F.lit(last).cast("timestamp_ntz"))

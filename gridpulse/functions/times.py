"""Time expressions on naive (NTZ) hourly stamps.

Nothing here goes through the session time zone, so results do not change
with it.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hours(n: int) -> Column:
    return F.lit(timedelta(hours=n))


def literal(stamp: datetime) -> Column:
    """A wall-clock stamp as a literal; text avoids a detour over a zoned timestamp."""
    return F.lit(stamp.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def at_hour(day: Column, hour: Column) -> Column:
    return day.cast("timestamp_ntz") + hour * hours(1)


def hour_floor(ts: Column) -> Column:
    """Start of the hour, as TIMESTAMP_NTZ (``date_trunc`` would return a zoned stamp)."""
    return at_hour(F.to_date(ts), F.hour(ts))


def hour_index(ts: Column) -> Column:
    """Whole hours since 1970-01-01, for step arithmetic and numeric ranking."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(
        ts
    )


def from_hour_index(idx: Column) -> Column:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(idx / 24).cast("int"))
    return at_hour(day, F.pmod(idx, F.lit(24)).cast("int"))


def add_time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """``date``, ``hour`` and ``day_of_week`` (Sunday = 1)."""
    return df.withColumns(
        {"date": F.to_date(ts), "hour": F.hour(ts), "day_of_week": F.dayofweek(ts)}
    )


def day_of_week_monday0(ts: Column) -> Column:
    return F.weekday(ts)


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def time_key(ts: Column) -> Column:
    """yyyyMMddHH as a long."""
    day = F.to_date(ts)
    return (
        F.year(day).cast("long") * 1_000_000
        + F.month(day) * 10_000
        + F.dayofmonth(day) * 100
        + F.hour(ts)
    )


def shift_zone(ts: Column, target: str, source: str = "UTC") -> Column:
    """The same instant on another zone's wall clock."""
    return F.convert_timezone(F.lit(source), F.lit(target), ts)

"""Activity expressions: totals, shares, null policy, reason texts."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.schemas import ACTIVITY


def zero_nulls(df: DataFrame, columns: list[str] = ACTIVITY) -> DataFrame:
    """Curated null policy: a missing measurement counts as 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def null_cells(columns: list[str] = ACTIVITY) -> Column:
    """Number of missing measurements in the row."""
    return reduce(add, [F.col(c).isNull().cast("int") for c in columns])


def any_negative(columns: list[str] = ACTIVITY) -> Column:
    """TRUE or FALSE, never NULL: a missing measurement is not negative."""
    return reduce(or_, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in columns])


def maybe_round(value: Column, decimals: int | None) -> Column:
    return value if decimals is None else F.round(value, decimals)


def quick_round(value: Column, decimals: int) -> Column:
    """``F.round`` of a double, with the same result but no decimal number per value.

    A product below 2^42 is off by less than 2^-10, so the nearest whole number
    is certain unless the fraction is close to a half; such values, large ones
    and NaN go to ``F.round``.
    """
    scale = 10.0**decimals
    product = F.abs(value) * scale
    down = F.floor(product)
    fraction = product - down
    whole = F.when(fraction < 0.5, down).otherwise(down + 1)
    certain = (product < 2.0**42) & (F.abs(fraction - 0.5) > 0.002)
    return F.when(certain, F.signum(value) * whole / scale + 0.0).otherwise(F.round(value, decimals))


def add_totals(df: DataFrame, decimals: int | None = None) -> DataFrame:
    sms = F.col("sms_in") + F.col("sms_out")
    calls = F.col("call_in") + F.col("call_out")
    return df.withColumns(
        {
            "total_sms": maybe_round(sms, decimals),
            "total_calls": maybe_round(calls, decimals),
            "total_activity": maybe_round(sms + calls + F.col("internet_activity"), decimals),
        }
    )


def share(part: Column, whole: Column) -> Column:
    """part / whole to 6 decimals; 0 where the whole is 0."""
    return F.when(whole != 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def number_text(value: Column, decimals: int) -> Column:
    """Shortest text of a rounded double with at least one decimal: 36.0, 36.5, 36.51.

    Rounds the scaled value half to even, as array libraries do. A plain cast
    to string would switch to exponents from 1e7 on.
    """
    scale = 10.0**decimals
    text = F.format_string(f"%.{decimals}f", F.rint(value * scale) / scale)
    return text if decimals == 1 else F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def lookup(mapping: dict, key: Column) -> Column:
    """CASE chain over a small fixed dictionary; NULL for unknown keys."""
    pairs = iter(mapping.items())
    first, value = next(pairs)
    chain = F.when(key == first, F.lit(value))
    for k, v in pairs:
        chain = chain.when(key == k, F.lit(v))
    return chain


def whole_number(column: str) -> Column:
    """Text as an int: any spelling of a whole number (``7``, ``7.0``); else NULL."""
    number = F.expr(f"try_cast({column} as double)")
    return F.when(number == F.floor(number), F.expr(f"try_cast(try_cast({column} as double) as int)"))

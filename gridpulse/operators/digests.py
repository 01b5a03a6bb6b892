"""Order-independent digests of tables: rows are compared without being shuffled.

A row's digest is two 64-bit hashes over all columns; a table's is its row
count with the sums of both. Equal tables have equal digests in any order
and partitioning, and a row that is there twice counts twice (unlike with an
exclusive or). Only sums leave a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.functions.sizing import broadcast_if_small

_FIRST, _SECOND = "_digest_a", "_digest_b"


def _parts(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns as hash inputs: -0.0 is 0.0, and a null differs from no column."""
    out = []
    for name in names:
        column = F.col(name)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            column = column + F.lit(0.0)
        out += [column, F.col(name).isNull()]
    return out


def row_digests(df: DataFrame, names: list[str] | None = None) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row over ``names`` (all columns, in order of name)."""
    parts = _parts(df, sorted(df.columns) if names is None else names)
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *reversed(parts))


def digest_columns(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Aggregates ``digest_a`` and ``digest_b``: exact sums of the row digests, 0 for no rows."""
    sums = [F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)") for h in row_digests(df, names)]
    return [c.alias(n) for c, n in zip(sums, ("digest_a", "digest_b"))]


def table_digest(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row: rows, digest_a, digest_b."""
    return df.agg(F.count("*").alias("rows"), *digest_columns(df, names))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables with the same columns hold the same rows equally often."""
    if sorted(left.columns) != sorted(right.columns):
        return False
    return table_digest(left).first() == table_digest(right).first()


def repeated_rows(df: DataFrame) -> DataFrame:
    """Columns of ``df`` and ``n``: the rows that are there more than once.

    Digests of 16 bytes are counted first; whole rows are grouped only where
    a digest repeats, so that equal digests of different rows change nothing.
    """
    a, b = row_digests(df)
    keyed = df.withColumns({_FIRST: a, _SECOND: b})
    keys = [_FIRST, _SECOND]
    again = keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    suspects = keyed.join(broadcast_if_small(again), keys, "left_semi")
    return suspects.groupBy(*df.columns).agg(F.count("*").alias("n")).filter("n > 1")

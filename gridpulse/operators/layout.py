"""Partitioning helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def by_date(df: DataFrame) -> DataFrame:
    """Layout by date: heavy days are split over as many tasks as their bytes need."""
    return df.hint("rebalance", F.col("date"))


def sample_rows(df: DataFrame, fraction: float, seed: int, key: Column) -> DataFrame:
    """Seeded sample without replacement, by a digest of ``key``: the same rows in any partitioning."""
    bound = f"{min(int(fraction * 16**8), 16**8 - 1):08x}" if fraction < 1 else "g"
    return df.filter(F.md5(F.concat_ws("|", F.lit(str(seed)), key)) < bound)


@contextmanager
def reused(df: DataFrame, columns: list[str]) -> Iterator[DataFrame]:
    """A narrow projection kept in memory and on disk for the length of the block."""
    kept = df.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def lookup_of(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key; the keys determine the columns, so any row of a key will do."""
    return df.select(*keys, *columns).dropDuplicates(keys)

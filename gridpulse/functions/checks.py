"""Data-quality checks as rows: (check, value, passed).

A check suite is one aggregate pass; its single result row is unfolded with
``inline``. Raising on a failed check is left to the caller (``require``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rows(
    one_row: DataFrame, checks: dict[str, tuple[Column, Column]], listed: dict[str, Column] | None = None
) -> DataFrame:
    """Unfold a one-row frame into check rows; ``checks`` maps name -> (value, passed).

    A check in ``listed`` has a row only where its condition holds.
    """
    structs = [
        F.struct(
            F.lit(name).alias("check"),
            value.cast("double").alias("value"),
            F.coalesce(passed, F.lit(False)).alias("passed"),
        )
        for name, (value, passed) in checks.items()
    ]
    if not listed:
        return one_row.select(F.inline(F.array(*structs)))
    structs = [F.when(listed[name], row) if name in listed else row for name, row in zip(checks, structs)]
    return one_row.select(F.inline(F.array_compact(F.array(*structs))))


def zero(column: str) -> tuple[Column, Column]:
    return F.col(column), F.col(column) == 0


def unfold(one_row: DataFrame, label: str, rows: dict[str, dict[str, Column]]) -> DataFrame:
    """General form: one output row per entry of ``rows``, ``label`` holding its key."""
    structs = [
        F.struct(F.lit(key).alias(label), *[c.alias(n) for n, c in columns.items()])
        for key, columns in rows.items()
    ]
    return one_row.select(F.inline(F.array(*structs)))


def require(checks: DataFrame) -> None:
    """Raise if any check row failed (a handful of rows by construction)."""
    failed = [f"{r['check']}={r['value']}" for r in checks.filter(~F.col("passed")).collect()]
    if failed:
        raise ValueError("failed checks: " + ", ".join(failed))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Schema contract; looks at the plan only, runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df

"""Casting, quarantine, null policy, derived columns of activity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.activity import (
    add_totals,
    any_negative,
    null_cells,
    whole_number,
    zero_nulls,
)
from gridpulse.functions.checks import check_rows, require, require_columns, zero
from gridpulse.functions.times import add_time_features
from gridpulse.schemas import ACTIVITY, CANONICAL_COLUMNS, GRID_RANGE

# Quarantine reasons, in order of precedence.
REASONS = ["missing_timestamp", "missing_grid_id", "invalid_grid_id", "negative_activity"]


def cast_columns(df: DataFrame) -> DataFrame:
    """Text columns to their types; malformed text becomes NULL instead of raising."""
    require_columns(df, CANONICAL_COLUMNS)
    casts: dict[str, Column] = {
        "timestamp": F.expr("try_cast(timestamp as timestamp_ntz)"),
        "grid_id": whole_number("grid_id"),
        "country_code": whole_number("country_code"),
    }
    casts.update({c: F.expr(f"try_cast({c} as double)") for c in ACTIVITY})
    return df.withColumns(casts)


def rejection_reason(grids: tuple[int, int] = GRID_RANGE) -> Column:
    """First matching reason, or NULL for a valid row; ``grids`` is the range of valid cell ids."""
    grid = F.col("grid_id")
    rules = [
        F.col("timestamp").isNull(),
        grid.isNull(),
        (grid < grids[0]) | (grid > grids[1]),
        any_negative(),
    ]
    chain = F.when(rules[0], F.lit(REASONS[0]))
    for rule, reason in zip(rules[1:], REASONS[1:]):
        chain = chain.when(rule, F.lit(reason))
    return chain


def classify(df: DataFrame, grids: tuple[int, int] = GRID_RANGE) -> DataFrame:
    return df.withColumn("rejection_reason", rejection_reason(grids))


def rejected_rows(df: DataFrame, grids: tuple[int, int] = GRID_RANGE) -> DataFrame:
    return classify(df, grids).filter(F.col("rejection_reason").isNotNull())


def valid_rows(df: DataFrame, grids: tuple[int, int] = GRID_RANGE) -> DataFrame:
    """Rows without a rejection reason.

    Written as simple comparisons of single columns, which a Parquet scan can
    take over, instead of testing the reason expression.
    """
    kept = F.col("timestamp").isNotNull() & F.col("grid_id").between(*grids)
    for c in ACTIVITY:
        kept = kept & (F.col(c).isNull() | (F.col(c) >= 0))
    return df.filter(kept)


def clean_activity(df: DataFrame, grids: tuple[int, int] = GRID_RANGE) -> DataFrame:
    """Valid rows with nulls as 0, time features and totals; grain unchanged."""
    return add_totals(add_time_features(zero_nulls(valid_rows(df, grids))))


def null_profile(df: DataFrame, columns: list[str] = ACTIVITY) -> DataFrame:
    """Missing values per measure as rows (column_name, null_count)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "null_count")


def nulls_handled(df: DataFrame) -> DataFrame:
    """One row: rows, rows with a missing measure, cells set to 0."""
    cells = null_cells()
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(cells > 0).alias("rows_with_null"),
        F.coalesce(F.sum(cells), F.lit(0)).alias("nulls_handled"),
    )


def cleaning_counts(df: DataFrame, grids: tuple[int, int] = GRID_RANGE) -> DataFrame:
    """Rows per verdict plus the reconciliation, from one aggregate over the raw rows."""
    reason = F.col("rejection_reason")
    return classify(df, grids).agg(
        F.count("*").alias("input_rows"),
        F.count_if(reason.isNotNull()).alias("rejected_rows"),
        F.count_if(reason.isNull()).alias("clean_rows"),
        *[F.count_if(reason == r).alias(r) for r in REASONS],
        F.coalesce(F.sum(F.when(reason.isNull(), null_cells())), F.lit(0)).alias("nulls_handled"),
    )


def reconcile(df: DataFrame, clean: DataFrame, grids: tuple[int, int] = GRID_RANGE) -> DataFrame:
    """Input - rejected = clean, with the clean side counted from the clean table."""
    produced = clean.agg(F.count("*").alias("n")).scalar()
    counts = cleaning_counts(df, grids).withColumn("clean_rows", produced)
    expected = F.col("input_rows") - F.col("rejected_rows")
    return counts.select(
        "input_rows",
        "rejected_rows",
        expected.alias("expected_rows"),
        "clean_rows",
        (expected == F.col("clean_rows")).alias("reconciled"),
    )


def fail_fast_checks(df: DataFrame, grids: tuple[int, int] = GRID_RANGE) -> DataFrame:
    reason = F.col("rejection_reason")
    counts = classify(df, grids).agg(*[F.count_if(reason == r).alias(r) for r in REASONS])
    return check_rows(counts, {r: zero(r) for r in REASONS})


def clean_or_raise(df: DataFrame, grids: tuple[int, int] = GRID_RANGE) -> DataFrame:
    """Cleaning that refuses bad rows instead of quarantining them."""
    require(fail_fast_checks(df, grids))
    return add_totals(add_time_features(zero_nulls(df)))

"""Leave-one-out median baseline.

For a bucket of n values sorted ascending, dropping the value of rank r leaves
n - 1 values whose median lies at ranks n div 2 and (n + 1) div 2 of the rest,
that is at those ranks of the full bucket, moved up by one when r is at or
below them. So one sort per bucket serves every row; no row is compared with
another.

Scale: buckets live on the grid-hour table, where a cell has one row per hour
(checked by ``quality.alert_input_checks``), so a bucket is bounded by the
length of the calendar no matter how the raw rows are distributed over cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridpulse.functions.activity import maybe_round


def leave_one_out_median(
    hourly: DataFrame,
    bucket: list[str],
    value: str = "total_activity",
    order: str = "timestamp",
    decimals: int | None = None,
) -> DataFrame:
    """Adds ``baseline_activity`` and ``history_count`` (the bucket size).

    A bucket of one row has no other value: its baseline is NULL. All columns
    come from one exchange and one sort by the bucket.
    """
    if not bucket:
        raise ValueError("bucket must name at least one column")
    whole = Window.partitionBy(*bucket)
    # The rank comes first: its sort also serves the windows over whole buckets.
    ranked = hourly.withColumn("_r", F.row_number().over(whole.orderBy(value, order))).withColumn(
        "history_count", F.count("*").over(whole)
    )
    n, r = F.col("history_count"), F.col("_r")
    low = F.floor(n / 2)
    high = F.floor((n + 1) / 2)

    def at(rank):
        return F.max(F.when(r == rank, F.col(value))).over(whole)

    lower = F.when(r <= low, at(low + 1)).otherwise(at(low))
    upper = F.when(r <= high, at(high + 1)).otherwise(at(high))
    baseline = F.when(n > 1, maybe_round((lower + upper) / 2.0, decimals))
    return ranked.withColumn("baseline_activity", baseline).drop("_r")


def require_history(baseline: DataFrame) -> DataFrame:
    """Strict mode: fails at run time on a bucket with fewer than two rows."""
    checked = F.assert_true(
        F.col("history_count") > 1, "leave-one-out median needs two rows per bucket"
    )
    return baseline.filter(checked.isNull())

"""Cumulative daily snapshots, so that an as-of request reads one snapshot and one day.

Sums are decimals: they do not depend on the order of addition, and adding
or taking away a day is exact.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridpulse.functions.times import hour_index, literal

SUMS = ("total_sms", "total_calls", "internet_activity", "total_activity")
EXACT = "decimal(38,6)"


def cell_days(hourly: DataFrame) -> DataFrame:
    """Per date and cell: exact sums, rows, and whether an hour was above 0."""
    return hourly.groupBy("date", "grid_id").agg(
        *[F.sum(F.col(c).cast("decimal(28,6)")).cast(EXACT).alias(c) for c in SUMS],
        F.count("*").alias("active_hours"),
        F.max(F.col("total_activity") > 0).alias("active"),
    )


def network_days(hourly: DataFrame) -> DataFrame:
    """Per date: exact total, and the busiest hour (the earliest of equals)."""
    hours = hourly.groupBy("date", "timestamp").agg(F.sum(F.col("total_activity").cast("decimal(28,6)")).cast(EXACT).alias("t"))
    return hours.groupBy("date").agg(F.sum("t").cast(EXACT).alias("total_activity"), F.max(_busiest("t")).alias("peak"))


def _busiest(total: str) -> Column:
    """Ordered by total, then the earliest hour."""
    return F.struct(F.col(total).alias("t"), (-hour_index(F.col("timestamp"))).alias("o"), "timestamp")


def cell_snapshots(days: DataFrame, base: DataFrame, dates: list[date]) -> DataFrame:
    """(date, grid_id, total_activity, active): totals of every cell up to the end of each of ``dates``.

    ``dates`` are all dates from the first new one, in order; ``days`` are
    their cell_days and ``base`` the snapshot before them (may be empty). One
    exchange by cell; a cell's total stands until its next day.
    """
    calendar = F.array(*[F.lit(d) for d in dates])
    rows = base.select("grid_id", F.lit(-1).alias("at"), "total_activity", "active").unionByName(
        days.select("grid_id", (F.array_position(calendar, F.col("date")) - 1).cast("int").alias("at"), "total_activity", "active")
    )
    by_day = Window.partitionBy("grid_id").orderBy("at")
    running = rows.select(
        "grid_id", "at",
        F.lead("at", 1, len(dates)).over(by_day).alias("until"),
        F.sum("total_activity").over(by_day).cast(EXACT).alias("total_activity"),
        F.max("active").over(by_day).alias("active"),
    )
    stands = F.filter(F.sequence(F.greatest("at", F.lit(0)), F.col("until") - 1), lambda k: k >= 0)
    filled = running.filter("until > greatest(at, 0)").withColumn("k", F.explode(stands))
    return filled.select(F.get(calendar, F.col("k")).alias("date"), "grid_id", "total_activity", "active")


def network_snapshots(days: DataFrame, base: DataFrame) -> DataFrame:
    """(date, total_activity, peak) up to the end of each date; ``base`` is the row before (may be empty).

    One row a date, so a single window is as long as the calendar.
    """
    by_day = Window.partitionBy(F.lit(0)).orderBy("date")
    return (
        base.withColumn("old", F.lit(True)).unionByName(days.withColumn("old", F.lit(False)))
        .select("date", F.sum("total_activity").over(by_day).cast(EXACT).alias("total_activity"), F.max("peak").over(by_day).alias("peak"), "old")
        .filter("not old").drop("old")
    )


def network_summary_at(cells: DataFrame, network: DataFrame, day: DataFrame, as_of: datetime) -> DataFrame:
    """The network summary up to ``as_of`` from the snapshots of the date before (both may be empty) and the day's hourly rows."""
    begun = day.filter(F.col("timestamp") <= literal(as_of))
    total = F.col("total_activity")
    per_cell = (
        cells.select("grid_id", "total_activity", "active")
        .unionByName(begun.select("grid_id", total.cast("decimal(28,6)").cast(EXACT).alias("total_activity"), (total > 0).alias("active")))
        .groupBy("grid_id").agg(F.sum("total_activity").cast(EXACT).alias("t"), F.max("active").alias("active"))
    )
    top = per_cell.agg(
        F.count_if("active").alias("active_grids"),
        F.max_by("grid_id", F.struct("t", (-F.col("grid_id")).alias("o"))).alias("top_grid"),
    )
    hours = network_days(begun).select("total_activity", "peak")
    peak = network.select("total_activity", "peak").unionByName(hours).agg(
        F.coalesce(F.sum("total_activity").cast("double"), F.lit(0.0)).alias("total_activity"), F.max("peak")["timestamp"].alias("peak_hour")
    )
    row = top.select(
        peak.select("total_activity").scalar().alias("total_activity"), "active_grids",
        peak.select("peak_hour").scalar().alias("peak_hour"), "top_grid", literal(as_of).alias("as_of"),
    )
    return row

"""Grid-hour aggregation and the KPIs over it.

Every grouping here uses sums, counts and extrema that combine map-side, so a
cell holding a third of the raw rows reaches its reducer as one partial row
per task. After ``grid_hour`` a cell has at most one row per hour.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridpulse.functions.activity import add_totals, maybe_round, share
from gridpulse.functions.checks import require_columns
from gridpulse.functions.times import add_time_features, hour_index, hours, literal
from gridpulse.schemas import ACTIVITY, GRID_RANGE, HOURLY_COLUMNS, MEASURES


def grid_hour(clean: DataFrame, decimals: int | None = None) -> DataFrame:
    """Country rows summed to one row per (timestamp, grid_id), with derived columns.

    ``decimals`` rounds the sums, which makes later threshold comparisons
    independent of summation order.
    """
    require_columns(clean, ["timestamp", "grid_id", *ACTIVITY])
    sums = clean.groupBy("timestamp", "grid_id").agg(
        *[maybe_round(F.sum(c), decimals).alias(c) for c in ACTIVITY]
    )
    derived = add_totals(sums, decimals).withColumn(
        "internet_share", share(F.col("internet_activity"), F.col("total_activity"))
    )
    return add_time_features(derived).select(*HOURLY_COLUMNS)


def _sums(*names: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


_TRAFFIC = ("total_sms", "total_calls", "internet_activity", "total_activity")


def daily_traffic(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("date").agg(
        *_sums(*_TRAFFIC), F.count_distinct("grid_id").alias("active_grids")
    )


def daily_summary(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("date").agg(*_sums(*_TRAFFIC), F.count("*").alias("active_grid_hours"))


def grid_summary(hourly: DataFrame) -> DataFrame:
    """Per cell; its rows are its distinct hours, as the grain is one row per cell and hour."""
    return hourly.groupBy("grid_id").agg(
        *_sums(*_TRAFFIC), F.count("*").alias("active_hours")
    )


def dashboard(hourly: DataFrame, with_share: bool = True) -> DataFrame:
    """Network-wide row per timestamp; its rows are its distinct cells, by the grain."""
    df = hourly.groupBy("timestamp").agg(
        *_sums(*_TRAFFIC), F.count("*").alias("active_grids")
    )
    if not with_share:
        return df
    return df.withColumn(
        "internet_share", share(F.col("internet_activity"), F.col("total_activity"))
    )


def summary_stats(hourly: DataFrame) -> DataFrame:
    return hourly.agg(
        F.sum("total_activity").alias("total_activity"),
        F.avg("total_activity").alias("average_activity"),
        F.max("total_activity").alias("maximum_grid_hour_activity"),
        F.count_distinct("grid_id").alias("unique_grids"),
        F.count_distinct("timestamp").alias("distinct_timestamps"),
    )


def hotspots(hourly: DataFrame, limit: int = 10) -> DataFrame:
    """Cells with the most activity over the whole period; ties by grid_id."""
    totals = hourly.groupBy("grid_id").agg(*_sums("total_activity"))
    return totals.orderBy(F.desc("total_activity"), F.asc("grid_id")).limit(limit)


def peak_hour(hourly: DataFrame) -> DataFrame:
    totals = hourly.groupBy("timestamp").agg(*_sums("total_activity"))
    return totals.orderBy(F.desc("total_activity"), F.asc("timestamp")).limit(1)


def busiest(hourly: DataFrame) -> DataFrame:
    """Busiest hour and busiest cell with their measure breakdown."""

    def top(key: str, kind: str) -> DataFrame:
        totals = hourly.groupBy(key).agg(*_sums(*ACTIVITY, "total_activity"))
        first = totals.orderBy(F.desc("total_activity"), F.asc(key)).limit(1)
        stamp = F.col(key) if key == "timestamp" else F.lit(None).cast("timestamp_ntz")
        grid = F.col(key) if key == "grid_id" else F.lit(None).cast("int")
        return first.select(
            F.lit(kind).alias("kind"),
            stamp.alias("timestamp"),
            grid.alias("grid_id"),
            *ACTIVITY,
            "total_activity",
        )

    return top("timestamp", "hour").unionByName(top("grid_id", "grid"))


def hourly_trend(fact: DataFrame) -> DataFrame:
    return fact.groupBy("date", "hour").agg(*_sums("total_activity"))


def internet_heavy(fact: DataFrame, limit: int = 10) -> DataFrame:
    """Timestamps with the largest internet share of a positive total."""
    totals = fact.groupBy("timestamp").agg(
        F.sum("internet_activity").alias("i"), F.sum("total_activity").alias("t")
    )
    shares = totals.filter(F.col("t") > 0).select(
        "timestamp", F.try_divide("i", "t").alias("internet_share")
    )
    return shares.orderBy(F.desc("internet_share"), F.asc("timestamp")).limit(limit)


def effective_as_of(df: DataFrame, as_of: datetime | None, column: str = "timestamp") -> Column:
    """The requested cutoff, or the newest stamp as a scalar subquery.

    A given cutoff is a literal and reaches the Parquet scan.
    """
    if as_of is not None:
        return literal(as_of)
    return df.agg(F.max(column).alias("as_of")).scalar()


def network_summary(fact: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """One row: total activity, active cells, peak hour, top cell, as_of.

    A cell is active when some hour is above 0. Both groupings (per hour, per
    cell) come from one scan; peak and top take the maximum with the earliest
    hour, the lowest id.
    """
    scoped = fact
    if as_of is not None:
        scoped = fact.filter(F.col("timestamp") <= literal(as_of))
    sets = scoped.groupingSets([["timestamp"], ["grid_id"]], "timestamp", "grid_id").agg(
        F.sum("total_activity").alias("t"),
        F.max(F.col("total_activity") > 0).alias("active"),
        F.grouping("grid_id").alias("per_hour"),
    )
    per_hour = F.col("per_hour") == 1
    earliest = F.struct("t", (-hour_index(F.col("timestamp"))).alias("o"))
    lowest = F.struct("t", (-F.col("grid_id")).alias("o"))
    newest = F.max("timestamp") if as_of is None else literal(as_of)
    return sets.agg(
        F.coalesce(F.sum(F.when(per_hour, F.col("t"))), F.lit(0.0)).alias("total_activity"),
        F.count_if(~per_hour & F.col("active")).alias("active_grids"),
        F.max_by("timestamp", F.when(per_hour, earliest)).alias("peak_hour"),
        F.max_by("grid_id", F.when(~per_hour, lowest)).alias("top_grid"),
        newest.alias("as_of"),
    )


def grid_history(
    fact: DataFrame,
    grid_id: int,
    date=None,
    hour: int | None = None,
    as_of=None,
    times: DataFrame | None = None,
) -> DataFrame:
    """Hourly measures of one cell: the last 24 stamps, or a given date and/or hour.

    The newest stamp comes from the time dimension ``times`` where it is given.
    A stamp that stands twice raises.
    """
    cutoff = effective_as_of(fact if times is None else times, as_of)
    df = fact.filter((F.col("grid_id") == grid_id) & (F.col("timestamp") <= cutoff))
    if date is not None:
        df = df.filter(F.to_date("timestamp") == F.lit(date).cast("date"))
    if hour is not None:
        df = df.filter(F.hour("timestamp") == hour)
    if date is None and hour is None:
        df = df.filter(F.col("timestamp") >= cutoff - hours(23))
    repeats = F.count("*").over(Window.partitionBy("timestamp")) > 1
    unique = F.assert_true(~repeats, "several rows for one stamp of the cell")
    return (
        df.select("timestamp", *MEASURES).withColumn("_unique", unique)
        .filter(F.col("_unique").isNull()).drop("_unique").orderBy("timestamp")
    )


def grid_exists(
    requested: DataFrame, dim_grid: DataFrame, grids: tuple[int, int] = GRID_RANGE
) -> DataFrame:
    """Requested ids that are in range and in the dimension."""
    in_range = requested.filter(F.col("grid_id").between(*grids))
    return in_range.join(dim_grid.select("grid_id"), "grid_id", "left_semi")

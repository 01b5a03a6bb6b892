"""Trailing-window features, next-hour label, chronological split.

Windows are keyed by cell and ordered by hour. The grid-hour table has one row
per cell and hour, so a window partition is as long as the calendar, not as
the raw data; one exchange by cell serves gap filling, features and label.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from gridpulse.functions.checks import require_columns
from gridpulse.functions.times import from_hour_index, hour_index, hours, literal
from gridpulse.schemas import (
    FEATURES,
    FEATURE_COLUMNS,
    GRID_RANGE,
    HISTORY_HOURS,
    RECENT_HOURS,
    TARGET_THRESHOLD,
    TRAIN_RATIO,
)


def fill_hours(hourly: DataFrame) -> DataFrame:
    """Zero rows for the missing hours between a cell's first and last hour.

    Each row is followed by fillers up to the cell's next row, so no calendar
    is joined and the cell partitioning is kept. The exchange by cell is given
    the session's shuffle width: adaptive coalescing would size the partitions
    by the rows before they are expanded.
    """
    width = int(hourly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_time = Window.partitionBy("grid_id").orderBy("timestamp")
    upcoming = F.lead("timestamp").over(by_time)
    last_filler = F.greatest(upcoming - hours(1), F.col("timestamp"))
    spans = (
        hourly.select("grid_id", "timestamp", "total_activity", "internet_activity")
        .repartition(width, "grid_id")
        .withColumn("until", F.coalesce(last_filler, F.col("timestamp")))
    )
    return spans.select(
        "grid_id",
        F.col("timestamp").alias("seen"),
        "total_activity",
        "internet_activity",
        F.explode(F.sequence("timestamp", "until", hours(1))).alias("timestamp"),
    ).select(
        "grid_id",
        "timestamp",
        *[
            F.when(F.col("timestamp") == F.col("seen"), F.col(c)).otherwise(0.0).alias(c)
            for c in ("total_activity", "internet_activity")
        ],
    )


def _or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


# Figures of a block of rows, and their value where no row is: activity not null, active hours,
# highest, sums, and squared deviations from the block's mean.
_BLOCK = {"_n": 0, "_hours": 0, "_peak": None, "_sum": None, "_net": None, "_squares": 0.0}


def _merged(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Figures of two blocks taken together."""
    n = a["_n"] + b["_n"]
    apart = F.try_divide(a["_sum"], a["_n"]) - F.try_divide(b["_sum"], b["_n"])
    between = F.coalesce(F.try_divide(apart * apart * (a["_n"] * b["_n"]), n), F.lit(0.0))
    return {
        "_n": n,
        "_hours": a["_hours"] + b["_hours"],
        "_peak": F.greatest(a["_peak"], b["_peak"]),
        **{c: F.coalesce(a[c] + b[c], a[c], b[c]) for c in ("_sum", "_net")},
        "_squares": a["_squares"] + b["_squares"] + between,
    }


def _lags(names: list[str], behind: list[int], by_time: WindowSpec) -> dict[str, Column]:
    """The figures ``names`` that many rows ago, as columns name_rows."""
    return {f"{c}_{k}": F.lag(c, k, _BLOCK.get(c)).over(by_time) for k in behind for c in names}


def _block(lag: int = 0) -> dict[str, Column]:
    return {c: F.col(f"{c}_{lag}" if lag else c) for c in _BLOCK}


def _row(lag: int = 0) -> dict[str, Column]:
    """Figures of one row; a row that is not there has a null total."""
    end = f"_{lag}" if lag else ""
    total = F.col(f"total_activity{end}")
    return {
        "_n": total.isNotNull().cast("int"),
        "_hours": F.when(total > 0, 1).otherwise(0),
        "_peak": total,
        "_sum": total,
        "_net": F.col(f"internet_activity{end}"),
        "_squares": F.coalesce(total * 0.0, F.lit(0.0)),  # NaN for NaN and infinity
    }


def _trailing(rows: DataFrame, by_time: WindowSpec, marks: dict[str, Column], later: dict[str, Column]) -> DataFrame:
    """Adds the figures of each row's last 24 rows, and ``_before``, the sum of the 24 rows before those.

    Blocks of 4, 8 and 24 rows are joined from the blocks that end where they
    begin: a handful of lags a row instead of 24 updates of every figure, and
    three windows over the rows. Nulls are left out, as aggregates do. Other
    columns over the same window share them: ``marks`` the first, ``later``,
    which may read the marks, the second.
    """
    df = rows.withColumns(marks | _lags(["total_activity", "internet_activity"], [1, 2, 3], by_time))
    df = df.withColumns(_merged(_merged(_row(3), _row(2)), _merged(_row(1), _row())))
    df = df.drop(*[f"{c}_{k}" for c in ("total_activity", "internet_activity") for k in (1, 2, 3)])
    lags = _lags(list(_BLOCK), [4], by_time)
    df = df.withColumns(later | lags).withColumns(_merged(_block(4), _block())).drop(*lags)
    whole, before = range(8, RECENT_HOURS, 8), range(RECENT_HOURS, 2 * RECENT_HOURS, 8)
    lags = _lags(list(_BLOCK), list(whole), by_time) | _lags(["_sum"], list(before), by_time)
    sums = [F.col(f"_sum_{k}") for k in reversed(before)]
    joined = reduce(_merged, [*[_block(k) for k in reversed(whole)], _block()])
    joined["_before"] = reduce(lambda a, b: F.coalesce(a + b, a, b), sums)
    return df.withColumns(lags).withColumns(joined).drop(*lags)


def grid_features(hourly: DataFrame, label_threshold: float | None = None) -> DataFrame:
    """Six features per cell and hour that ends a gap-free run of 48 rows.

    Recent window: the last 24 rows; prior window: the 24 before, read as the
    recent sum 24 rows ago. Runs are found by marking the rows that do not
    follow their predecessor by exactly one hour.

    With ``label_threshold`` the next hour's outcome is added in the same pass
    (columns ``next_hour_activity`` and ``high_activity_target``), and rows
    whose next row is not the next hour are dropped.
    """
    require_columns(hourly, ["grid_id", "timestamp", "total_activity", "internet_activity"])
    by_time = Window.partitionBy("grid_id").orderBy("timestamp")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, 0)
    marks = {
        "_row": F.row_number().over(by_time),
        "_break": F.coalesce(F.col("timestamp") - F.lag("timestamp").over(by_time) != hours(1), F.lit(True)),
        "_next_at": F.lead("timestamp").over(by_time),
        "_next": F.lead("total_activity").over(by_time),
    }
    run = {"_run": F.max(F.when(F.col("_break"), F.col("_row"))).over(so_far)}
    rows = hourly.select("grid_id", "timestamp", "total_activity", "internet_activity")
    df = _trailing(rows, by_time, marks, run).withColumn("_prior", F.col("_before") / RECENT_HOURS)
    avg = F.col("_sum") / RECENT_HOURS  # kept rows have full windows
    kept = df.filter(F.col("_row") - F.col("_run") >= HISTORY_HOURS - 1)
    columns = [
        F.col("grid_id"),
        F.col("timestamp").alias("feature_timestamp"),
        avg.alias("avg_activity"),
        _or_zero(avg - F.col("_prior"), F.col("_prior")).alias("activity_growth"),
        F.col("_hours").cast("int").alias("active_hours"),
        _or_zero(F.col("_peak"), avg).alias("peak_ratio"),
        F.sqrt(F.try_divide("_squares", "_n")).alias("variability"),
        _or_zero(F.col("_net"), F.col("_sum")).alias("internet_share"),
    ]
    if label_threshold is None:
        return kept.select(*columns)
    labelled = kept.filter(F.col("_next_at") == F.col("timestamp") + hours(1))
    return labelled.select(
        *columns,
        F.col("_next").alias("next_hour_activity"),
        (F.col("_next") >= label_threshold).cast("int").alias("high_activity_target"),
    )


def next_hour_label(
    features: DataFrame, hourly: DataFrame, threshold: float = TARGET_THRESHOLD
) -> DataFrame:
    """Stored features joined to the activity one hour later; rows without it drop out.

    Both sides are shuffled: the planner does not see how many rows the filled hours have.
    """
    following = hourly.select(
        "grid_id",
        (F.col("timestamp") - hours(1)).alias("feature_timestamp"),
        F.col("total_activity").alias("next_hour_activity"),
    )
    return features.join(following.hint("merge"), ["grid_id", "feature_timestamp"]).withColumn(
        "high_activity_target", (F.col("next_hour_activity") >= threshold).cast("int")
    )


def split_cutoff(
    df: DataFrame, ratio: float = TRAIN_RATIO, column: str = "feature_timestamp"
) -> DataFrame:
    """One row (cutoff): the first test stamp.

    With n distinct stamps it is the one at position int(n * ratio), kept
    within 1 .. n - 1 (counting from 0). One distinct stamp gives no row.
    """
    stamps = df.select(hour_index(F.col(column)).alias("idx")).distinct()
    # One array of the distinct hours: as long as the calendar, whatever the row count.
    ordered = stamps.agg(F.array_sort(F.collect_list("idx")).alias("hours"))
    n = F.size("hours")
    position = F.greatest(F.least(F.floor(n * ratio).cast("int"), n - 1), F.lit(1))
    return ordered.filter(n > 1).select(
        from_hour_index(F.get("hours", position)).alias("cutoff")
    )


def chronological_split(
    df: DataFrame, ratio: float = TRAIN_RATIO, column: str = "feature_timestamp"
) -> DataFrame:
    """Adds ``split``: "train" before the cutoff stamp, "test" from it on.

    The cutoff is looked up now, so that it is a literal where a side is
    filtered. Fewer than two distinct stamps raise: one of the sides would be empty.
    """
    cutoff = split_cutoff(df, ratio, column).first()
    if cutoff is None:
        raise ValueError("a chronological split needs two distinct stamps")
    at = literal(cutoff["cutoff"])
    side = F.when(F.col(column) < at, F.lit("train")).when(F.col(column) >= at, F.lit("test"))
    return df.withColumn("split", side)


def latest_features(features: DataFrame) -> DataFrame:
    """Newest feature row of each cell (combines map-side, no sort)."""
    order = hour_index(F.col("feature_timestamp"))
    newest = features.groupBy("grid_id").agg(
        F.max_by(F.struct("feature_timestamp", *FEATURES), order).alias("f")
    )
    return newest.select("grid_id", "f.*")


def grid_features_at(
    features: DataFrame,
    grid_id: int,
    at: datetime | None = None,
    grids: tuple[int, int] = GRID_RANGE,
) -> DataFrame:
    """Feature row of one cell at a stamp (default: its newest), with quality and freshness."""
    if not grids[0] <= grid_id <= grids[1]:
        return feature_status(features.limit(0))
    rows = feature_status(features.filter(F.col("grid_id") == grid_id))
    if at is not None:
        return rows.filter(F.col("feature_timestamp") == literal(at))
    return rows.filter(F.col("freshness") == "CURRENT")


def feature_status(features: DataFrame) -> DataFrame:
    """Adds ``data_quality`` and ``freshness`` relative to the cell's newest row."""
    newest = F.max("feature_timestamp").over(Window.partitionBy("grid_id"))
    stamp = F.col("feature_timestamp")
    complete = F.lit(True)
    for c in FEATURES:
        complete = complete & F.col(c).isNotNull()
    return features.select(*FEATURE_COLUMNS).withColumns(
        {
            "data_quality": F.when(complete, "VALID").otherwise("INVALID"),
            "freshness": F.when(stamp == newest, "CURRENT")
            .when(stamp < newest, "HISTORICAL")
            .otherwise("UNKNOWN"),
        }
    )

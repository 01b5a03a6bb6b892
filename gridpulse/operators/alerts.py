"""Rule alerts, their summaries and the operator feeds built on them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridpulse.functions.activity import lookup, maybe_round, number_text
from gridpulse.functions.checks import require_columns
from gridpulse.functions.times import hour_index, hours, literal
from gridpulse.operators.aggregate import effective_as_of
from gridpulse.operators.baseline import leave_one_out_median
from gridpulse.operators.ranks import exact_percentiles
from gridpulse.sources.sinks import stage_table
from gridpulse.schemas import (
    ALERT_COLUMNS,
    ALERT_SEVERITY,
    DROP_RATIO,
    FLOOR_PERCENTILE,
    HIGH_RATIO,
    SEVERITY_RANK,
    SPIKE_RATIO,
    STATUS_RANK,
)


def activity_floor(
    hourly: DataFrame,
    probability: float = FLOOR_PERCENTILE,
    bucket: tuple[str, ...] = ("grid_id",),
    decimals: int | None = None,
) -> DataFrame:
    """One row: the percentile of the per-cell totals over the whole period.

    The totals, one row a cell, are stored: the hourly rows are read once.
    """
    totals = stage_table(
        hourly.groupBy(*bucket).agg(maybe_round(F.sum("total_activity"), decimals).alias("total")), "totals"
    )
    return exact_percentiles(totals, [], "total", {"activity_floor": probability}).select(
        "activity_floor"
    )


def alert_inputs(
    hourly: DataFrame,
    bucket: tuple[str, ...] = ("grid_id",),
    require_adjacent: bool = False,
    decimals: int | None = None,
) -> DataFrame:
    """Hourly rows with baseline, previous row of the cell and cell total.

    All windows share the cell key, so the hourly rows are exchanged once. The
    previous row bridges gaps unless ``require_adjacent`` is set.
    """
    require_columns(hourly, ["grid_id", "timestamp", "total_activity", *bucket])
    by_time = Window.partitionBy("grid_id").orderBy("timestamp")
    whole = Window.partitionBy("grid_id")
    previous = F.lag("total_activity").over(by_time)
    if require_adjacent:
        gap = F.col("timestamp") - F.lag("timestamp").over(by_time)
        previous = F.when(gap == hours(1), previous)
    extra = [c for c in bucket if c != "grid_id"]
    prepared = (
        hourly.select("grid_id", "timestamp", "total_activity", *extra)
        .withColumn("previous_activity", previous)
        .withColumn("grid_total", maybe_round(F.sum("total_activity").over(whole), decimals))
    )
    return leave_one_out_median(prepared, list(bucket), decimals=decimals)


def _texts(high: float, spike: float, drop: float) -> dict[str, Column]:
    current, base, before = (
        number_text(F.col(c), 2)
        for c in ("total_activity", "baseline_activity", "previous_activity")
    )
    # Alert reason texts.
    return {
        "HIGH_ACTIVITY": F.concat(
            F.lit("HIGH_ACTIVITY: current activity "), current,
            F.lit(f" is at least {high}x the baseline "), base, F.lit("."),
        ),
        "ACTIVITY_DROP": F.concat(
            F.lit("ACTIVITY_DROP: current activity "), current,
            F.lit(f" is at or below {drop}x the baseline "), base, F.lit("."),
        ),
        "ACTIVITY_SPIKE": F.concat(
            F.lit("ACTIVITY_SPIKE: current activity "), current,
            F.lit(f" is at least {spike}x the preceding hour "), before, F.lit("."),
        ),
    }


def alerts(
    hourly: DataFrame,
    high_ratio: float = HIGH_RATIO,
    spike_ratio: float = SPIKE_RATIO,
    drop_ratio: float = DROP_RATIO,
    floor: float | None = None,
    bucket: tuple[str, ...] = ("grid_id",),
    require_adjacent: bool = False,
    decimals: int | None = None,
) -> DataFrame:
    """Alert rows (bag): one per grid-hour and matching rule.

    The three rules are evaluated in one pass and unfolded, instead of scanning
    the hourly table once per rule.
    """
    rows = alert_inputs(hourly, bucket, require_adjacent, decimals)
    threshold = F.lit(floor) if floor is not None else activity_floor(hourly, decimals=decimals).scalar()
    total, base = F.col("total_activity"), F.col("baseline_activity")
    before = F.col("previous_activity")
    texts = _texts(float(high_ratio), float(spike_ratio), float(drop_ratio))
    rules = {
        "HIGH_ACTIVITY": total >= base * high_ratio,
        "ACTIVITY_DROP": total <= base * drop_ratio,
        "ACTIVITY_SPIKE": (before > 0) & (total >= before * spike_ratio),
    }
    eligible = rows.filter((F.col("grid_total") >= threshold) & (base > 0))
    fired = F.array(
        *[
            F.when(rule, F.struct(F.lit(kind).alias("alert_type"), texts[kind].alias("reason")))
            for kind, rule in rules.items()
        ]
    )
    return eligible.select(
        "grid_id",
        "timestamp",
        total.alias("current_activity"),
        base.alias("baseline_activity"),
        F.inline(F.array_compact(fired)),
    ).select(*ALERT_COLUMNS)


def alert_summary(alert_rows: DataFrame, hourly: DataFrame) -> DataFrame:
    """Alerts per type with the totals repeated: (alert_type, alerts, ...)."""
    grid_hours = hourly.agg(F.count("*").alias("n")).scalar()
    by_type = alert_rows.groupBy("alert_type").agg(F.count("*").alias("alerts"))
    whole = Window.partitionBy(F.lit(0))
    return by_type.select(
        "alert_type",
        "alerts",
        F.sum("alerts").over(whole).alias("total_alerts"),
        grid_hours.alias("total_grid_hours"),
    ).withColumn(
        "alert_proportion",
        F.coalesce(F.try_divide("total_alerts", "total_grid_hours"), F.lit(0.0)),
    )


def alert_top_grids(alert_rows: DataFrame, limit: int = 10) -> DataFrame:
    counts = alert_rows.groupBy("grid_id").agg(F.count("*").alias("alerts"))
    return counts.orderBy(F.desc("alerts"), F.asc("grid_id")).limit(limit)


def alerts_by_hour(alert_rows: DataFrame, separator: str = "|") -> DataFrame:
    """One row per grid-hour: flag, sorted distinct types, number of alerts."""
    return alert_rows.groupBy("grid_id", "timestamp").agg(
        F.lit(True).alias("np3_alert"),
        F.array_join(F.array_sort(F.collect_set("alert_type")), separator).alias(
            "np3_alert_types"
        ),
        F.count("*").alias("np3_alert_count"),
    )


def severity(alert_type: Column) -> Column:
    return lookup(ALERT_SEVERITY, alert_type)


def severity_rank(level: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_RANK, level), F.lit(0))


def _upto(df: DataFrame, as_of: datetime | None) -> DataFrame:
    """Rows up to a given cutoff; the newest stamp as cutoff excludes none that has a stamp."""
    stamp = F.col("timestamp")
    return df.filter(stamp.isNotNull() if as_of is None else stamp <= literal(as_of))


def alert_feed(
    alert_rows: DataFrame,
    limit: int,
    level: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Newest alerts first, then severity, cell, type.

    Without ``as_of`` the newest alert is the cutoff and ``alert_rows`` is read
    twice: pass a stored table then.
    """
    cutoff = effective_as_of(alert_rows, as_of)
    df = _upto(alert_rows, as_of).withColumn("severity", severity(F.col("alert_type")))
    if level is not None:
        df = df.filter(F.col("severity") == level)
    return (
        df.orderBy(
            F.desc("timestamp"),
            F.desc(severity_rank(F.col("severity"))),
            F.asc("grid_id"),
            F.asc("alert_type"),
        )
        .limit(limit)
        .select(
            "grid_id", "timestamp", "alert_type", "severity", "current_activity",
            "baseline_activity", "reason", cutoff.alias("as_of"),
        )
    )


def hotspot_feed(fact: DataFrame, limit: int, as_of: datetime | None = None) -> DataFrame:
    """Grid-hours with the most activity up to the cutoff."""
    cutoff = effective_as_of(fact, as_of)
    return (
        _upto(fact, as_of)
        .orderBy(F.desc("total_activity"), F.asc("grid_id"), F.asc("timestamp"))
        .limit(limit)
        .select(
            "grid_id",
            "timestamp",
            "total_activity",
            F.col("total_sms").alias("sms_activity"),
            F.col("total_calls").alias("call_activity"),
            "internet_activity",
            cutoff.alias("as_of"),
        )
    )


def _status(level: Column) -> Column:
    return F.when(level == "HIGH", F.lit("HIGH")).otherwise(F.lit("ATTENTION"))


def ranked_operations(hotspot_rows: DataFrame, feed: DataFrame) -> DataFrame:
    """Hotspots and alerts in one list ordered by status, activity, cell, time."""
    hot = hotspot_rows.select(
        "grid_id",
        "timestamp",
        F.col("total_activity").alias("activity"),
        F.lit("ATTENTION").alias("status"),
        F.lit(None).cast("string").alias("severity"),
        F.lit("HOTSPOT").alias("type"),
        F.lit("High activity area").alias("reason"),
    )
    alerted = feed.select(
        "grid_id",
        "timestamp",
        F.col("current_activity").alias("activity"),
        _status(F.col("severity")).alias("status"),
        "severity",
        F.lit("ALERT").alias("type"),
        "reason",
    )
    rank = lookup(STATUS_RANK, F.col("status"))
    return hot.unionByName(alerted).orderBy(
        F.desc(rank), F.desc("activity"), F.asc("grid_id"), F.asc("timestamp")
    )


def grid_status(hotspot_rows: DataFrame, feed: DataFrame) -> DataFrame:
    """One status per cell for the map; an alert overrides a hotspot.

    Within the feeds a later list entry overrides an earlier one, so the alert
    that counts is the last in feed order (oldest, lowest severity), and the
    hotspot total is the last in hotspot order (lowest activity).
    """
    last_hot = F.struct(
        (-F.col("total_activity")).alias("a"), F.col("timestamp").alias("b")
    )
    hot = hotspot_rows.groupBy("grid_id").agg(
        F.max_by("total_activity", last_hot).alias("total_activity")
    )
    last_alert = F.struct(
        (-hour_index(F.col("timestamp"))).alias("a"),
        (-severity_rank(F.col("severity"))).alias("b"),
        F.col("alert_type").alias("c"),
    )
    alerted = feed.groupBy("grid_id").agg(
        F.max_by(F.struct("severity", "alert_type", "current_activity"), last_alert).alias("a")
    )
    return hot.join(alerted, "grid_id", "full").select(
        "grid_id",
        F.when(F.col("a").isNotNull(), _status(F.col("a.severity")))
        .otherwise(F.lit("ATTENTION"))
        .alias("status"),
        "total_activity",
        F.col("a.severity").alias("severity"),
        F.col("a.alert_type").alias("alert_type"),
        F.col("a.current_activity").alias("current_activity"),
    )

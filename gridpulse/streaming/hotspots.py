"""Live alerts: hourly totals per cell against a stored baseline and the hour before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridpulse.functions.activity import add_totals, maybe_round, zero_nulls
from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.functions.times import from_hour_index, hour_index
from gridpulse.operators.cleaning import valid_rows
from gridpulse.schemas import ACTIVITY, DROP_RATIO, GRID_RANGE, HIGH_RATIO, SPIKE_RATIO


def hourly_stream(
    stream: DataFrame,
    watermark: str = "2 hours",
    decimals: int | None = None,
    grids: tuple[int, int] = GRID_RANGE,
) -> DataFrame:
    """Grid-hour totals of an activity stream; late rows within the watermark count.

    State is one row per open (hour, cell), combined map-side before the state
    store, so a hot cell does not gather its raw rows in one task. Event time
    is counted in hours since 1970, so wall-clock hours do not pass through the
    session's time zone and its daylight saving.
    """
    return _hour_windows(stream, watermark, decimals, grids).drop("closed_at")


def _hour_windows(stream: DataFrame, watermark: str, decimals: int | None, grids: tuple[int, int]) -> DataFrame:
    """``hourly_stream`` with the hour's event time, by which a further stateful operator can follow."""
    rows = zero_nulls(valid_rows(stream, grids)).withColumn(
        "event_time", F.timestamp_seconds(hour_index(F.col("timestamp")) * 3600)
    )
    sums = (
        rows.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", "1 hour"), "grid_id")
        .agg(*[maybe_round(F.sum(c), decimals).alias(c) for c in ACTIVITY])
    )
    hour = from_hour_index(F.floor(F.unix_seconds("window.start") / 3600)).alias("timestamp")
    return add_totals(sums, decimals).select(
        hour, "grid_id", *ACTIVITY, "total_activity", F.window_time("window").alias("closed_at")
    )


def rule_alerts(
    stream: DataFrame,
    baseline: DataFrame,
    watermark: str = "2 hours",
    decimals: int | None = None,
    grids: tuple[int, int] = GRID_RANGE,
    high_ratio: float = HIGH_RATIO,
    spike_ratio: float = SPIKE_RATIO,
    drop_ratio: float = DROP_RATIO,
) -> DataFrame:
    """HIGH_ACTIVITY, ACTIVITY_DROP and ACTIVITY_SPIKE of closed hours, as the batch rules find them.

    ``baseline``: grid_id, hour_of_day, baseline_activity, from stored history;
    cells without one, or with one of 0, raise nothing. A spike compares an
    hour with the one before it: the hourly totals are joined to themselves,
    an hour apart, in event time, so the join keeps the hours between the
    watermark and one hour before it only. A missing hour is no hour of 0.
    """
    known = broadcast_if_small(baseline)
    now = _hour_windows(stream, watermark, decimals, grids)
    before = _hour_windows(stream, watermark, decimals, grids).select(
        F.col("grid_id").alias("earlier_grid"), F.col("closed_at").alias("earlier"), F.col("total_activity").alias("previous_activity")
    )
    hour = F.expr("interval 1 hour")
    pairs = now.join(
        before,
        (F.col("grid_id") == F.col("earlier_grid")) & (F.col("closed_at") >= F.col("earlier") + hour) & (F.col("closed_at") <= F.col("earlier") + hour),
    )
    total, base, previous = F.col("total_activity"), F.col("baseline_activity"), F.col("previous_activity")

    def fired(hours: DataFrame, rules: dict[str, Column]) -> DataFrame:
        kinds = F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in rules.items()]))
        return (
            hours.withColumn("hour_of_day", F.hour("timestamp")).join(known, ["grid_id", "hour_of_day"]).filter(base > 0)
            .select("grid_id", "timestamp", F.explode(kinds).alias("alert_type"), total.alias("current_activity"), base.alias("baseline_activity"))
        )

    steady = fired(now, {"HIGH_ACTIVITY": total >= base * high_ratio, "ACTIVITY_DROP": total <= base * drop_ratio})
    return steady.unionByName(fired(pairs, {"ACTIVITY_SPIKE": (previous > 0) & (total >= previous * spike_ratio)}))


def hotspot_alerts(
    hourly: DataFrame, baseline: DataFrame, ratio: float = HIGH_RATIO
) -> DataFrame:
    """Grid-hours at or above ``ratio`` times the baseline of their cell and hour of day.

    ``baseline``: grid_id, hour_of_day, baseline_activity, computed in batch.
    """
    known = broadcast_if_small(baseline)
    total, base = F.col("total_activity"), F.col("baseline_activity")
    return (
        hourly.withColumn("hour_of_day", F.hour("timestamp"))
        .join(known, ["grid_id", "hour_of_day"])
        .filter((base > 0) & (total >= base * ratio))
        .select(
            "grid_id",
            "timestamp",
            F.lit("HIGH_ACTIVITY").alias("alert_type"),
            total.alias("current_activity"),
            base.alias("baseline_activity"),
        )
    )


def static_baseline(hourly: DataFrame) -> DataFrame:
    """Median per cell and hour of day (at most one row per day in a group)."""
    return hourly.groupBy("grid_id", F.hour("timestamp").alias("hour_of_day")).agg(
        F.percentile("total_activity", 0.5).alias("baseline_activity")
    )


def start(alerts: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Exactly-once Parquet sink; ``once`` drains what is there and stops."""
    writer = alerts.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": "30 seconds"}
    return writer.outputMode("append").trigger(**trigger).start(path)

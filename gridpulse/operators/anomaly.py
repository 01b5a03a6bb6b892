"""Same-hour anomaly scores against the leave-one-out median of cell and hour of day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridpulse.functions.activity import number_text
from gridpulse.functions.checks import require_columns
from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.functions.times import hour_index
from gridpulse.operators.baseline import leave_one_out_median
from gridpulse.schemas import ANOMALY_COLUMNS, ANOMALY_THRESHOLD, MIN_HISTORY_DAYS


def anomaly_scores(
    hourly: DataFrame,
    threshold: float = ANOMALY_THRESHOLD,
    min_history_days: int = MIN_HISTORY_DAYS,
    decimals: int | None = None,
) -> DataFrame:
    """Score |x - b| / b with direction, flag and reason per grid-hour.

    NULL score and direction where history is too short or the baseline is 0.
    """
    require_columns(hourly, ["grid_id", "timestamp", "total_activity"])
    rows = hourly.select(
        "grid_id", "timestamp", F.hour("timestamp").alias("hour_of_day"), "total_activity"
    )
    df = leave_one_out_median(rows, ["grid_id", "hour_of_day"], decimals=decimals)
    total, base = F.col("total_activity"), F.col("baseline_activity")
    enough = F.col("history_count") > min_history_days - 1
    eligible = enough & F.coalesce(base > 0, F.lit(False))
    deviation = total - base
    # Anomaly reason texts.
    anomalous_text = F.concat(
        F.col("direction"),
        F.lit(" anomaly: activity is "),
        number_text(F.col("anomaly_score") * 100, 1),
        F.lit("% away from the historical median for this grid and hour-of-day."),
    )
    reason = (
        F.when(
            ~enough | base.isNull(),
            F.lit("Insufficient historical observations for hour-of-day baseline."),
        )
        .when(
            ~eligible,
            F.lit("Historical baseline is zero; percentage deviation cannot be calculated."),
        )
        .when(F.col("is_anomaly"), anomalous_text)
        .otherwise(
            F.lit("Within expected historical range for this grid and hour-of-day.")
        )
    )
    direction = F.when(deviation > 0, "HIGH").when(deviation < 0, "LOW").otherwise("NONE")
    flagged = (F.col("anomaly_score") >= threshold) & F.col("direction").isin("HIGH", "LOW")
    return (
        df.withColumns(
            {
                "deviation": deviation,
                "anomaly_score": F.when(eligible, F.abs(deviation) / base),
                "direction": F.when(eligible, direction),
            }
        )
        .withColumn("is_anomaly", F.coalesce(flagged, F.lit(False)))
        .withColumn("reason", reason)
        .withColumnRenamed("total_activity", "current_activity")
        .select(*ANOMALY_COLUMNS)
    )


def anomaly_summary(scores: DataFrame) -> DataFrame:
    """One row of counts; the proportion is 0 for an empty table."""
    flag, direction = F.col("is_anomaly"), F.col("direction")
    stats = scores.agg(
        F.count("*").alias("total_grid_hours"),
        F.count_if(flag).alias("anomalies"),
        F.count_if(flag & (direction == "HIGH")).alias("high_anomalies"),
        F.count_if(flag & (direction == "LOW")).alias("low_anomalies"),
        F.count_if(direction == "HIGH").alias("high_direction_rows"),
        F.count_if(direction == "LOW").alias("low_direction_rows"),
        F.coalesce(F.min("history_count"), F.lit(0)).alias("min_bucket_count"),
        F.coalesce(F.max("history_count"), F.lit(0)).alias("max_bucket_count"),
    )
    return stats.withColumn(
        "anomaly_proportion",
        F.coalesce(F.try_divide("anomalies", "total_grid_hours"), F.lit(0.0)),
    )


def anomaly_cases(scores: DataFrame, count: int = 2) -> DataFrame:
    """The strongest cases per direction, from different cells where possible.

    The first ranking runs per direction and cell. The second orders the
    survivors, cells' best cases first; both keep only ``count`` rows per
    partition before exchanging them (rank limit pushed below the shuffle).
    """
    strongest = [F.desc("anomaly_score"), F.asc("grid_id"), F.asc("timestamp")]
    per_cell = Window.partitionBy("direction", "grid_id").orderBy(*strongest)
    per_direction = Window.partitionBy("direction").orderBy(
        F.asc(F.when(F.col("cell_rank") == 1, 0).otherwise(1)), *strongest
    )
    return (
        scores.filter(F.col("is_anomaly") & F.col("direction").isin("HIGH", "LOW"))
        .withColumn("cell_rank", F.row_number().over(per_cell))
        .filter(F.col("cell_rank") <= count)
        .withColumn("case_number", F.row_number().over(per_direction))
        .filter(F.col("case_number") <= count)
        .drop("cell_rank")
    )


def case_history(cases: DataFrame, hourly: DataFrame) -> DataFrame:
    """Per case: same-hour history without the case itself, its median and size.

    Cases are few (measured before broadcast); the history of one cell and hour
    of day has at most one row per day.
    """
    wanted = broadcast_if_small(
        cases.select(
            "direction", "case_number", "grid_id", "hour_of_day",
            F.col("timestamp").alias("case_timestamp"), "current_activity", "baseline_activity",
        )
    )
    rows = hourly.select(
        "grid_id", F.hour("timestamp").alias("hour_of_day"), "timestamp", "total_activity"
    )
    other = F.col("timestamp") != F.col("case_timestamp")
    joined = wanted.join(rows, ["grid_id", "hour_of_day"], "left")
    return joined.groupBy("direction", "case_number", "grid_id", "case_timestamp").agg(
        F.first("current_activity").alias("current_activity"),
        F.first("baseline_activity").alias("baseline_activity"),
        F.percentile(F.when(other, F.col("total_activity")), 0.5).alias("historical_median"),
        F.count_if(other).alias("historical_observations"),
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.when(
                            other,
                            F.struct(
                                hour_index(F.col("timestamp")).alias("h"),
                                F.date_format("timestamp", "yyyy-MM-dd HH").alias("t"),
                                F.col("total_activity").alias("v"),
                            ),
                        )
                    )
                ),
                lambda s: F.format_string("%s=%.2f", s["t"], s["v"]),
            ),
            ";",
        ).alias("history"),
    )

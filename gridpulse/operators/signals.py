"""Comparison of the three signals: rule alerts, next-hour model, same-hour anomalies.

Column prefixes np3 / ml3 / ml4 name alerts, model and anomalies.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridpulse.functions.checks import unfold
from gridpulse.functions.times import hour_index, shift_zone
from gridpulse.operators.alerts import alerts_by_hour
from gridpulse.operators.ranks import exact_percentiles
from gridpulse.schemas import (
    ACTIVITY_BANDS,
    CORRELATION_LIMIT,
    CURRENT_THRESHOLDS,
    FEATURES,
    MODEL_VERSION,
    QUANTILE_PROBS,
    RISK_COLUMNS,
    RISK_THRESHOLD,
    SCORE_TARGETS,
)

TARGET = "high_activity_target"


def risk_level(score: Column, threshold: float = RISK_THRESHOLD) -> Column:
    return F.when(score >= threshold, F.lit("HIGH")).otherwise(F.lit("LOW"))


def prediction_label(prediction: Column) -> Column:
    return F.when(prediction == 1, "HIGH").when(prediction == 0, "NOT_HIGH")


def _once(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, raising at run time if a key repeats; the window shares the join's exchange."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    unique = F.assert_true(place == 1, f"several {what} for one grid and hour")
    return df.withColumn("_place", unique).filter(F.col("_place").isNull()).drop("_place")


def combine_risk(
    scored: DataFrame, anomalies: DataFrame, model_version: str = MODEL_VERSION
) -> DataFrame:
    """Risk rows (grid_id, feature_timestamp, risk_score) with their anomaly result.

    Left join one to one: a key that stands twice on either side raises. Both
    sides are shuffled: the anomaly rows may come from filled hours, whose
    number the planner cannot see, so it would broadcast all of them.
    ``anomaly_present`` tells a missing anomaly row from one whose score is
    NULL because its baseline is 0.
    """
    keys = ["grid_id", "timestamp"]
    right = anomalies.select(
        "grid_id",
        "timestamp",
        "anomaly_score",
        F.col("direction").alias("anomaly_direction"),
        F.col("is_anomaly").cast("int").alias("is_anomaly"),
        F.col("reason").alias("anomaly_reason"),
        F.lit(True).alias("anomaly_present"),
    )
    left = scored.select(
        "grid_id",
        F.col("feature_timestamp").alias("timestamp"),
        "risk_score",
        risk_level(F.col("risk_score")).alias("risk_level"),
        F.lit(model_version).alias("model_version"),
    )
    left, right = _once(left, keys, "risk rows"), _once(right, keys, "anomaly rows")
    joined = left.join(right.hint("merge"), keys, "left")
    return joined.withColumn(
        "anomaly_present", F.coalesce("anomaly_present", F.lit(False))
    ).select(*RISK_COLUMNS, "anomaly_present")


def risk_table(combined: DataFrame, strict: bool = True) -> DataFrame:
    """Publishable risk rows; strict mode fails on rows without an anomaly result."""
    if strict:
        checked = F.assert_true(F.col("anomaly_present"), "risk row without anomaly result")
        combined = combined.filter(checked.isNull())
    return combined.select(*RISK_COLUMNS)


def three_way(model_test: DataFrame, alert_rows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Test rows of the model with the alert and anomaly signals of the same grid-hour.

    ``model_test``: grid_id, timestamp, next_hour_activity, target,
    ml3_probability, ml3_positive. Alerts are collapsed to one row per
    grid-hour before the join, so it cannot fan out.
    """
    np3 = alerts_by_hour(alert_rows, "|").drop("np3_alert_count")
    ml4 = anomalies.select(
        "grid_id",
        "timestamp",
        F.col("is_anomaly").alias("ml4_anomaly"),
        F.col("direction").alias("ml4_direction"),
        "anomaly_score",
        "baseline_activity",
        "current_activity",
    )
    keys = ["grid_id", "timestamp"]
    return model_test.join(np3, keys, "left").join(ml4, keys, "left").withColumns(
        {
            "np3_alert": F.coalesce("np3_alert", F.lit(False)),
            "np3_alert_types": F.coalesce("np3_alert_types", F.lit("")),
            "ml4_anomaly": F.coalesce("ml4_anomaly", F.lit(False)),
            "ml4_direction": F.coalesce("ml4_direction", F.lit("NONE")),
        }
    )


# Names of the eight combinations, by (alert, model, anomaly).
COMBINATIONS = {
    "ALL THREE": (True, True, True),
    "NP3 + ML4 only": (True, False, True),
    "NP3 + ML3 only": (True, True, False),
    "ML3 + ML4 only": (False, True, True),
    "NP3 ONLY": (True, False, False),
    "ML3 ONLY": (False, True, False),
    "ML4 ONLY": (False, False, True),
    "NONE": (False, False, False),
}


def three_way_overlap(comparison: DataFrame) -> DataFrame:
    """Rows and share of each exclusive combination; empty ones are kept."""
    flags = [F.col("np3_alert"), F.col("ml3_positive"), F.col("ml4_anomaly")]
    counts = {}
    for name, wanted in COMBINATIONS.items():
        match = F.lit(True)
        for flag, value in zip(flags, wanted):
            match = match & (flag if value else ~flag)
        counts[name] = F.count_if(match).alias(name)
    stats = comparison.agg(F.count("*").alias("_n"), *counts.values())
    return unfold(
        stats,
        "combination",
        {
            name: {
                "rows": F.col(f"`{name}`"),
                "share": F.try_divide(F.col(f"`{name}`"), F.col("_n")),
            }
            for name in COMBINATIONS
        },
    )


def outcome_rates(comparison: DataFrame) -> DataFrame:
    """Next-hour outcome rate per signal; NULL rate for a signal without rows."""
    # Signal names.
    signals = {
        "NP3 alert": F.col("np3_alert"),
        "ML3 positive": F.col("ml3_positive"),
        "ML4 anomaly": F.col("ml4_anomaly"),
        "ML4 HIGH": F.col("ml4_direction") == "HIGH",
        "ML4 LOW": F.col("ml4_direction") == "LOW",
    }
    columns = []
    for i, flag in enumerate(signals.values()):
        columns += [
            F.count_if(flag).alias(f"n{i}"),
            F.avg(F.when(flag, F.col("target"))).alias(f"r{i}"),
        ]
    stats = comparison.agg(*columns)
    return unfold(
        stats,
        "signal",
        {
            name: {"rows": F.col(f"n{i}"), "next_hour_high_rate": F.col(f"r{i}")}
            for i, name in enumerate(signals)
        },
    )


def disagreements(comparison: DataFrame) -> DataFrame:
    """The strongest row of each kind of disagreement, found in one aggregate."""
    anomaly_only = F.col("ml4_anomaly") & ~F.col("ml3_positive")
    model_only = F.col("ml3_positive") & ~F.col("ml4_anomaly")
    alert_differs = F.col("np3_alert") != F.col("ml4_anomaly")
    first = [(-F.col("grid_id")).alias("g"), (-hour_index(F.col("timestamp"))).alias("t")]
    shown = F.struct(
        "grid_id", "timestamp", "np3_alert", "np3_alert_types", "ml4_anomaly", "ml4_direction",
        "anomaly_score", "ml3_probability", "next_hour_activity",
    )
    kinds = {
        "anomaly_not_model": (anomaly_only, F.struct(F.col("anomaly_score").alias("s"), *first)),
        "model_not_anomaly": (model_only, F.struct(F.col("ml3_probability").alias("s"), *first)),
        "alert_differs_from_anomaly": (alert_differs, F.struct(*first)),
    }
    stats = comparison.agg(
        *[F.max_by(shown, F.when(test, order)).alias(k) for k, (test, order) in kinds.items()]
    )
    return (
        unfold(stats, "kind", {k: {"r": F.col(k)} for k in kinds})
        .filter(F.col("r").isNotNull())
        .select("kind", "r.*")
    )


# --- alerts against model ----------------------------------------------------


def alert_vs_model(
    model_test: DataFrame, alert_rows: DataFrame, zone: str | None = None
) -> DataFrame:
    """Model test rows with the alerts of the same hour and the comparison group.

    ``model_test``: grid_id, feature_timestamp, ml3_prediction,
    ml3_probability, high_activity_target. ``zone`` moves alert stamps from UTC
    to that zone's wall clock first.
    """
    stamped = alert_rows
    if zone is not None:
        stamped = alert_rows.withColumn("timestamp", shift_zone(F.col("timestamp"), zone))
    np3 = alerts_by_hour(stamped, ",").withColumnRenamed("grid_id", "np3_grid_id")
    joined = model_test.join(
        np3,
        (F.col("grid_id") == F.col("np3_grid_id"))
        & (F.col("feature_timestamp") == F.col("timestamp")),
        "left",
    ).drop("np3_grid_id", "timestamp")
    alert, model = F.col("np3_alert"), F.col("ml3_positive")
    # Comparison group names.
    group = (
        F.when(alert & model, "BOTH")
        .when(alert, "NP3_ONLY")
        .when(model, "ML3_ONLY")
        .otherwise("NEITHER")
    )
    return joined.withColumns(
        {
            "np3_alert": F.coalesce("np3_alert", F.lit(False)),
            "np3_alert_types": F.coalesce("np3_alert_types", F.lit("")),
            "np3_alert_count": F.coalesce("np3_alert_count", F.lit(0)).cast("long"),
            "ml3_positive": F.col("ml3_prediction") == 1,
            "ml3_prediction_label": prediction_label(F.col("ml3_prediction")),
            "actual_next_hour_high": F.col(TARGET) == 1,
        }
    ).withColumn("comparison_group", group)


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 4), F.lit(0.0))


def comparison_summary(comparison: DataFrame) -> DataFrame:
    """One row of counts, percentages, agreement and outcome rates."""
    alert, model = F.col("np3_alert"), F.col("ml3_positive")
    outcome = F.col("actual_next_hour_high").cast("int")
    group = F.col("comparison_group")
    stats = comparison.agg(
        F.count("*").alias("total_comparison_rows"),
        F.min("feature_timestamp").alias("test_start"),
        F.max("feature_timestamp").alias("test_end"),
        F.count_if(alert).alias("np3_alert_rows"),
        F.count_if(model).alias("ml3_positive_rows"),
        F.count_if(group == "BOTH").alias("both_rows"),
        F.count_if(group == "NP3_ONLY").alias("np3_only_rows"),
        F.count_if(group == "ML3_ONLY").alias("ml3_only_rows"),
        F.count_if(group == "NEITHER").alias("neither_rows"),
        F.coalesce(F.sum(F.when(alert, outcome)), F.lit(0)).alias("_a"),
        F.coalesce(F.sum(F.when(model, outcome)), F.lit(0)).alias("_m"),
    ).withColumn("agreement_rows", F.col("both_rows") + F.col("neither_rows"))
    n = F.col("total_comparison_rows")
    return stats.withColumns(
        {
            "np3_alert_rate_percent": _percent(F.col("np3_alert_rows"), n),
            "ml3_positive_rate_percent": _percent(F.col("ml3_positive_rows"), n),
            "agreement_rate_percent": _percent(F.col("agreement_rows"), n),
            "np3_alert_next_hour_high_rate_percent": _percent(
                F.col("_a"), F.col("np3_alert_rows")
            ),
            "ml3_positive_next_hour_high_rate_percent": _percent(
                F.col("_m"), F.col("ml3_positive_rows")
            ),
        }
    ).drop("_a", "_m")


def alert_type_overlap(comparison: DataFrame) -> DataFrame:
    """Per alert type: rows, share of alert rows, model overlap, outcome rate."""
    alerted = comparison.filter("np3_alert")
    alert_rows = alerted.agg(F.count("*").alias("n")).scalar()
    typed = alerted.select(
        F.explode(F.split("np3_alert_types", ",")).alias("alert_type"),
        "ml3_positive",
        "actual_next_hour_high",
    )
    stats = typed.groupBy("alert_type").agg(
        F.count("*").alias("rows"),
        F.count_if("ml3_positive").alias("ml3_positive_overlap_rows"),
        F.count_if("actual_next_hour_high").alias("_high"),
    )
    return stats.withColumns(
        {
            "percent_of_np3_alert_rows": _percent(F.col("rows"), alert_rows),
            "ml3_positive_overlap_percent": _percent(
                F.col("ml3_positive_overlap_rows"), F.col("rows")
            ),
            "next_hour_high_rate_percent": _percent(F.col("_high"), F.col("rows")),
        }
    ).drop("_high")


# --- feature investigation ---------------------------------------------------


def feature_means(df: DataFrame) -> DataFrame:
    """Per feature: mean by class and positive / negative ratio."""
    label = F.col(TARGET)
    stats = df.agg(
        *[F.avg(F.when(label == k, F.col(c))).alias(f"{c}_{k}") for c in FEATURES for k in (0, 1)]
    )
    return unfold(
        stats,
        "feature",
        {
            c: {
                "not_high_mean": F.col(f"{c}_0"),
                "high_mean": F.col(f"{c}_1"),
                "mean_ratio": F.try_divide(F.col(f"{c}_1"), F.col(f"{c}_0")),
            }
            for c in FEATURES
        },
    )


def feature_corr(df: DataFrame) -> DataFrame:
    """Pearson correlation of each feature with the label, strongest first."""
    label = F.col(TARGET).cast("double")
    stats = df.agg(*[F.corr(F.col(c).cast("double"), label).alias(c) for c in FEATURES])
    rows = unfold(stats, "feature", {c: {"correlation": F.col(c)} for c in FEATURES})
    return rows.orderBy(F.desc(F.abs("correlation")), F.asc("feature"))


def feature_quantiles(df: DataFrame, column: str = "avg_activity") -> DataFrame:
    """Per class: count, mean, exact percentiles and maximum.

    One class holds nearly all rows, so the percentiles go through the
    segmented ranks instead of a per-class buffer.
    """
    moments = df.groupBy(TARGET).agg(
        F.count("*").alias("rows"), F.avg(column).alias("mean"), F.max(column).alias("max")
    )
    quantiles = exact_percentiles(df, [TARGET], column, QUANTILE_PROBS).drop("n")
    return moments.join(quantiles, TARGET, "left")


def threshold_rates(
    df: DataFrame, thresholds: list[float] = CURRENT_THRESHOLDS, column: str = "avg_activity"
) -> DataFrame:
    """Outcome rate of the rows at or above each threshold, from one aggregate."""
    columns = []
    for i, t in enumerate(thresholds):
        above = F.col(column) >= t
        columns += [
            F.count_if(above).alias(f"n{i}"),
            F.count_if(above & (F.col(TARGET) == 1)).alias(f"p{i}"),
        ]
    stats = df.agg(*columns)
    rows = {
        str(float(t)): {
            "rows": F.col(f"n{i}"),
            "positive_rate": F.coalesce(F.try_divide(f"p{i}", f"n{i}"), F.lit(0.0)),
        }
        for i, t in enumerate(thresholds)
    }
    return unfold(stats, "threshold", rows).withColumn(
        "threshold", F.col("threshold").cast("double")
    )


def activity_bands(df: DataFrame, edges: list[float] = ACTIVITY_BANDS) -> DataFrame:
    """Rows, means and outcome rate per left-closed band of avg_activity; empty bands stay."""
    band = F.lit(None).cast("int")
    for i, low in enumerate(edges):
        band = F.when(F.col("avg_activity") >= low, F.lit(i)).otherwise(band)
    stats = (
        df.withColumn("band", band)
        .filter(F.col("band").isNotNull())
        .groupBy("band")
        .agg(
            F.count("*").alias("rows"),
            F.avg("avg_activity").alias("mean_avg_activity"),
            F.avg("variability").alias("mean_variability"),
            F.avg(F.col(TARGET).cast("double")).alias("positive_rate"),
        )
    )
    lower = F.array(*[F.lit(e) for e in edges])
    upper = F.array(*[F.lit(e) for e in edges[1:]], F.lit(None).cast("double"))
    bands = df.sparkSession.range(len(edges)).select(
        F.col("id").cast("int").alias("band"),
        F.get(lower, F.col("id").cast("int")).alias("band_from"),
        F.get(upper, F.col("id").cast("int")).alias("band_to"),
    )
    return bands.join(stats, "band", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def feature_pairs(df: DataFrame, limit: float | None = CORRELATION_LIMIT) -> DataFrame:
    """Correlation of every feature pair; with ``limit`` only strong pairs."""
    pairs = list(combinations(FEATURES, 2))
    stats = df.agg(
        *[
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    rows = unfold(
        stats,
        "pair",
        {
            f"{a}|{b}": {
                "feature_a": F.lit(a), "feature_b": F.lit(b), "correlation": F.col(f"p{i}")
            }
            for i, (a, b) in enumerate(pairs)
        },
    ).drop("pair")
    return rows if limit is None else rows.filter(F.abs("correlation") >= limit)


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: confusion matrix, accuracy, precision, recall, all-negative baseline."""
    hit, actual = F.col(score) >= threshold, F.col(label) == 1
    stats = df.agg(
        F.count("*").alias("rows"),
        F.count_if(hit & actual).alias("true_positives"),
        F.count_if(hit & ~actual).alias("false_positives"),
        F.count_if(~hit & actual).alias("false_negatives"),
        F.count_if(~hit & ~actual).alias("true_negatives"),
    )
    n, tp, tn = F.col("rows"), F.col("true_positives"), F.col("true_negatives")
    fp, fn = F.col("false_positives"), F.col("false_negatives")

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return stats.withColumns(
        {
            "accuracy": ratio(tp + tn, n),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "baseline_accuracy": ratio(fp + tn, n),
            "base_rate": ratio(tp + fn, n),
        }
    ).withColumns(
        {
            "accuracy_improvement": F.col("accuracy") - F.col("baseline_accuracy"),
            "accuracy_warning": F.col("accuracy") > 0.95,
        }
    )


def nearest_scores(df: DataFrame, targets: list[float] = SCORE_TARGETS) -> DataFrame:
    """The row closest to each target score; all targets in one aggregate."""
    row = F.struct("grid_id", "feature_timestamp", "risk_score")
    columns = []
    for i, t in enumerate(targets):
        # distances are compared to 9 decimals so that ties are ties
        distance = F.round(F.abs(F.col("risk_score") - t), 9)
        order = F.struct(
            distance.alias("d"),
            F.col("grid_id").alias("g"),
            hour_index(F.col("feature_timestamp")).alias("t"),
        )
        columns.append(F.min_by(row, order).alias(f"t{i}"))
    stats = df.agg(*columns)
    rows = unfold(stats, "target", {str(t): {"r": F.col(f"t{i}")} for i, t in enumerate(targets)})
    return rows.select(
        F.col("target").cast("double").alias("target"),
        "r.*",
        risk_level(F.col("r.risk_score")).alias("risk_level"),
    )

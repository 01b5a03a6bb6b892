"""Star schema build and the derived tables read from it."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions.checks import require
from gridpulse.operators import alerts, anomaly, features, model, signals, warehouse
from gridpulse.schemas import EXPECTED_GRIDS, FEATURES, RISK_THRESHOLD, TARGET_THRESHOLD
from gridpulse.sources import sinks, versions


def build_warehouse(
    spark: SparkSession,
    hourly: DataFrame,
    lookup: DataFrame,
    path: str,
    expected_grids: int | None = EXPECTED_GRIDS,
) -> DataFrame:
    """Dimensions, then the fact from the stored dimensions, then the checks (raised on failure)."""
    versions.commit(warehouse.dim_time(hourly), f"{path}/dim_time")
    versions.commit(warehouse.dim_grid(lookup), f"{path}/dim_grid")
    times, grids = versions.read(spark, f"{path}/dim_time"), versions.read(spark, f"{path}/dim_grid")
    versions.commit(warehouse.fact(hourly, times, grids), f"{path}/fact_network_activity")
    facts = versions.read(spark, f"{path}/fact_network_activity")
    checks = warehouse.star_checks(hourly, facts, times, grids, expected_grids)
    require(checks)
    return checks


def open_star(spark: SparkSession, path: str) -> DataFrame:
    return warehouse.star(
        versions.read(spark, f"{path}/fact_network_activity"),
        versions.read(spark, f"{path}/dim_time"),
        versions.read(spark, f"{path}/dim_grid"),
    )


def feature_job(star: DataFrame, path: str) -> None:
    """Full refresh of the stored feature table, as its next version."""
    versions.commit(features.grid_features(star), path)


def alert_job(hourly: DataFrame, path: str, **options) -> DataFrame:
    """Alerts to Parquet and CSV; returns the stored table."""
    spark = hourly.sparkSession
    sinks.write_parquet(alerts.alerts(hourly, **options), f"{path}/alerts")
    stored = spark.read.parquet(f"{path}/alerts")
    sinks.write_csv(stored, f"{path}/alerts_csv")
    return stored


def anomaly_job(hourly: DataFrame, path: str, **options) -> DataFrame:
    """Anomaly scores to Parquet and CSV; returns the stored table."""
    spark = hourly.sparkSession
    sinks.write_parquet(anomaly.anomaly_scores(hourly, **options), f"{path}/anomalies")
    stored = spark.read.parquet(f"{path}/anomalies")
    sinks.write_csv(stored, f"{path}/anomalies_csv")
    return stored


def training_job(
    feature_rows: DataFrame, hourly: DataFrame, threshold: float, columns: list[str] = FEATURES
) -> tuple[PipelineModel, DataFrame]:
    """Label, split by time, fit on the early part; returns the model and the test metrics."""
    rows = features.next_hour_label(feature_rows, hourly, threshold)
    labelled = sinks.stage_table(features.chronological_split(rows), "labelled")
    fitted = model.train(labelled.filter("split = 'train'"), columns)
    scored = sinks.stage_table(
        model.score(fitted, labelled.filter("split = 'test'")), "scored"
    )
    return fitted, model.evaluate(scored)


def risk_job(
    fitted: PipelineModel, feature_rows: DataFrame, anomalies: DataFrame, path: str
) -> DataFrame:
    """Score stored features, attach anomalies, publish the next version of the risk table."""
    scored = model.score(fitted, feature_rows)
    table = signals.risk_table(signals.combine_risk(scored, anomalies))
    versions.commit(table, path)
    return versions.read(feature_rows.sparkSession, path)


def comparison_job(
    fitted: PipelineModel,
    feature_rows: DataFrame,
    hourly: DataFrame,
    alert_rows: DataFrame,
    anomalies: DataFrame,
    path: str,
    threshold: float = TARGET_THRESHOLD,
    zone: str | None = None,
) -> dict[str, DataFrame]:
    """Model, alerts and anomalies side by side on the test part; reports beside the tables.

    The joined tables are stored first, so each report reads only the columns
    it needs instead of repeating the joins.
    """
    spark = feature_rows.sparkSession
    labelled = features.next_hour_label(feature_rows, hourly, threshold)
    split = features.chronological_split(labelled).filter("split = 'test'").drop("split")
    test = sinks.stage_table(model.score(fitted, split), "test")
    positive = F.col("risk_score") >= RISK_THRESHOLD
    three = signals.three_way(
        test.select(
            "grid_id",
            F.col("feature_timestamp").alias("timestamp"),
            "next_hour_activity",
            F.col("high_activity_target").alias("target"),
            F.col("risk_score").alias("ml3_probability"),
            positive.alias("ml3_positive"),
        ),
        alert_rows,
        anomalies,
    )
    versus = signals.alert_vs_model(
        test.select(
            "grid_id",
            "feature_timestamp",
            positive.cast("int").alias("ml3_prediction"),
            F.col("risk_score").alias("ml3_probability"),
            "high_activity_target",
        ),
        alert_rows,
        zone,
    )
    sinks.write_parquet(three, f"{path}/three_way")
    sinks.write_parquet(versus, f"{path}/alert_vs_model")
    three = spark.read.parquet(f"{path}/three_way")
    versus = spark.read.parquet(f"{path}/alert_vs_model")
    reports = {
        "three_way_overlap": signals.three_way_overlap(three),
        "outcome_rates": signals.outcome_rates(three),
        "disagreements": signals.disagreements(three),
        "comparison_summary": signals.comparison_summary(versus),
        "alert_type_overlap": signals.alert_type_overlap(versus),
    }
    for name, report in reports.items():
        sinks.write_report(report, f"{path}/{name}")
    return {name: spark.read.json(f"{path}/{name}") for name in reports}

"""Registered queries: every operator over the whole event table.

``events`` supplies the activity rows (one event is one raw row, its user the
cell). Doubles are rounded at the end so that results can be compared across
engines; the library itself does not round them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.functions import geometry as geom
from gridpulse.functions import times
from gridpulse.functions.activity import quick_round
from gridpulse.operators import (
    aggregate,
    alerts,
    anomaly,
    cleaning,
    features,
    geo,
    landing,
    layout,
    model,
    newton,
    quality,
    ranks,
    signals,
    warehouse,
)
from gridpulse.schemas import (
    ACTIVITY,
    CANONICAL_COLUMNS,
    FEATURES,
    HOURLY_COLUMNS,
    MEASURES,
    RAW_TO_CANONICAL,
)
from gridpulse.operators.baseline import leave_one_out_median
from gridpulse.plans import batch, refresh
from gridpulse.sources import grid, sinks, versions
from gridpulse.session import scratch_dir
from gridpulse.sources.activity import (
    events_as_activity,
    read_table,
    read_text_csv,
    read_typed_csv,
    stream_table,
    to_canonical,
)
from gridpulse.streaming import hotspots as live

Query = Callable[[SparkSession, str], DataFrame]

# Thresholds that suit the value range of the event table.
LABEL_THRESHOLD = 100.0
FEATURE_THRESHOLDS = [1.0, 2.0, 4.0, 8.0, 12.0, 16.0]
FEATURE_BANDS = [0.0, 1.0, 2.0, 4.0, 6.0, 8.0, 10.0, 15.0, 20.0]
# Cells of the event table are user ids + 1: any positive id is valid, 0 is the injected bad one.
CELLS = (1, 2**31 - 1)
BAD_CELL = 0
AS_OF = datetime(2024, 1, 20, 12)
DAY = date(2024, 1, 15)
# A day that is delivered twice, and a cutoff before the second delivery's days.
CORRECTED = date(2024, 1, 9)
EARLY = datetime(2024, 1, 10, 5)

_REGISTRY: dict[str, Query] = {}


def query(name: str, decimals: int = 6) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return settle(fn(spark, sf_dir), decimals)

        _REGISTRY[name] = run
        return fn

    return register


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def settle(df: DataFrame, decimals: int, rounded: Callable[[Column, int], Column] = F.round) -> DataFrame:
    """Round every double column (adding 0.0 turns -0.0 into 0.0)."""
    return df.select(
        *[
            (rounded(F.col(f.name), decimals) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# --- inputs ------------------------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def activity(spark: SparkSession, sf: str) -> DataFrame:
    return events_as_activity(events(spark, sf))


def defective(spark: SparkSession, sf: str) -> DataFrame:
    """Activity with injected defects, one in about a hundred rows per kind."""
    rows = events_as_activity(events(spark, sf), keep=("event_id",))

    def every(step: int, at: int) -> Column:
        return F.col("event_id") % step == at

    return rows.withColumns(
        {
            "timestamp": F.when(every(101, 0), None).otherwise(F.col("timestamp")),
            "grid_id": F.when(every(89, 3), None)
            .when(every(83, 5), BAD_CELL)
            .otherwise(F.col("grid_id"))
            .cast("int"),
            "sms_in": F.when(every(97, 7), -1.0).otherwise(F.col("sms_in")),
        }
    )


def raw_text(spark: SparkSession, sf: str) -> DataFrame:
    """The daily files as landing rows: all text, raw names, a few unreadable fields."""
    ev = events(spark, sf)

    def every(step: int, at: int) -> Column:
        return F.col("event_id") % step == at

    rows = events_as_activity(ev, keep=("event_id",))
    file_name = F.concat(
        F.lit("sms-call-internet-mi-"), F.date_format("timestamp", "yyyy-MM-dd"), F.lit(".csv")
    )
    texts = {
        "datetime": F.when(every(1009, 5), "n/a").otherwise(
            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
        ),
        "CellID": F.when(every(1013, 7), None).otherwise(F.col("grid_id").cast("string")),
        "countrycode": F.when(every(1511, 9), "??").otherwise(
            F.col("country_code").cast("string")
        ),
        "smsin": F.when(every(701, 11), "-4.5").otherwise(F.col("sms_in").cast("string")),
        "smsout": F.when(every(997, 13), "x1").otherwise(F.col("sms_out").cast("string")),
        "callin": F.col("call_in").cast("string"),
        "callout": F.col("call_out").cast("string"),
        "internet": F.col("internet_activity").cast("string"),
    }
    return rows.select(file_name.alias("file_name"), *[c.alias(n) for n, c in texts.items()])


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_activity(activity(spark, sf), CELLS)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.grid_hour(clean(spark, sf), decimals=2)


def stored_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly table, written once, for queries that read it several times."""
    return sinks.stage_table(hourly(spark, sf), "hourly")


def cell_count(spark: SparkSession, sf: str) -> int:
    """Largest cell id of the events; one aggregate over one column."""
    return events(spark, sf).agg(F.max("user_id") + 1).first()[0] or 0


def cell_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Cell geometry for the ids of the supplier table (fewer cells than the activity has)."""
    ids = spark.read.parquet(f"{sf}/supplier.parquet").select(
        (F.col("s_suppkey") + 1).cast("int").alias("grid_id")
    )
    inside = ids.filter(F.col("grid_id").between(*CELLS)).distinct()
    return inside.withColumn("geometry", grid.square_cell(F.col("grid_id")))


def all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cell geometry for every cell of the activity."""
    ids = events(spark, sf).select((F.col("user_id") + 1).cast("int").alias("grid_id"))
    inside = ids.filter(F.col("grid_id").between(*CELLS)).distinct()
    return inside.withColumn("geometry", grid.square_cell(F.col("grid_id")))


def star(spark: SparkSession, sf: str) -> DataFrame:
    hours = hourly(spark, sf)
    times_dim, grids_dim = stored_dims(spark, sf)
    return warehouse.star(warehouse.fact(hours, times_dim, grids_dim), times_dim, grids_dim)


def stored_star(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.stage_table(star(spark, sf), "star")


def dims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    valid = cleaning.valid_rows(activity(spark, sf), CELLS)
    return warehouse.dim_time(valid), warehouse.dim_grid(all_cells(spark, sf))


def stored_dims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Dimensions as small tables: measuring and joining them does not scan the events again."""
    time_dim, grid_dim = dims(spark, sf)
    return sinks.stage_table(time_dim, "dim_time"), sinks.stage_table(grid_dim, "dim_grid")


def alert_rows(spark: SparkSession, sf: str, hours: DataFrame | None = None) -> DataFrame:
    """Alerts over the stored hourly table: the floor and the windows read it, not the events."""
    return alerts.alerts(stored_hourly(spark, sf) if hours is None else hours, decimals=4)


def stored_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts as a table, for queries that read them more than once."""
    return sinks.stage_table(alert_rows(spark, sf), "alerts")


def anomaly_rows(spark: SparkSession, sf: str, hours: DataFrame | None = None) -> DataFrame:
    return anomaly.anomaly_scores(hourly(spark, sf) if hours is None else hours, decimals=4)


def filled(spark: SparkSession, sf: str, hours: DataFrame | None = None) -> DataFrame:
    return features.fill_hours(hourly(spark, sf) if hours is None else hours)


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    return settle(features.grid_features(filled(spark, sf)), 9)


def labelled(spark: SparkSession, sf: str, hours: DataFrame | None = None) -> DataFrame:
    return settle(features.grid_features(filled(spark, sf, hours), LABEL_THRESHOLD), 9, quick_round)


def rule_score(avg: Column) -> Column:
    """A fixed score in place of a fitted one, so both engines can compute it."""
    return F.round(1.0 / (1.0 + F.exp(-(avg - 8.0) / 2.0)), 6)


def split(
    spark: SparkSession, sf: str, hours: DataFrame | None = None, names: list[str] = FEATURES
) -> DataFrame:
    """Labelled rows with their side; written once, with the features ``names``, before the cutoff is taken from them."""
    rows = labelled(spark, sf, hours)
    kept = [c for c in rows.columns if c in names or c not in FEATURES]
    return features.chronological_split(sinks.stage_table(rows.select(*kept), "labelled"))


def scored(spark: SparkSession, sf: str, hours: DataFrame | None = None) -> DataFrame:
    rows = split(spark, sf, hours)
    return rows.withColumn("risk_score", rule_score(F.col("avg_activity")))


def model_test(spark: SparkSession, sf: str, hours: DataFrame | None = None) -> DataFrame:
    return scored(spark, sf, hours).filter("split = 'test'")


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    hours = stored_hourly(spark, sf)
    test = model_test(spark, sf, hours).select(
        "grid_id",
        F.col("feature_timestamp").alias("timestamp"),
        "next_hour_activity",
        F.col("high_activity_target").alias("target"),
        F.col("risk_score").alias("ml3_probability"),
        (F.col("risk_score") >= 0.5).alias("ml3_positive"),
    )
    return signals.three_way(test, alert_rows(spark, sf, hours), anomaly_rows(spark, sf, hours))


def alert_comparison(spark: SparkSession, sf: str) -> DataFrame:
    hours = stored_hourly(spark, sf)
    test = model_test(spark, sf, hours).select(
        "grid_id",
        "feature_timestamp",
        (F.col("risk_score") >= 0.5).cast("int").alias("ml3_prediction"),
        F.col("risk_score").alias("ml3_probability"),
        "high_activity_target",
    )
    return signals.alert_vs_model(test, alert_rows(spark, sf, hours))


# --- cleaning and quality ----------------------------------------------------


@query("canonical_activity")
def _(spark, sf):
    raw = activity(spark, sf).withColumnsRenamed({v: k for k, v in RAW_TO_CANONICAL.items()})
    return raw.withColumnsRenamed(RAW_TO_CANONICAL).select(*CANONICAL_COLUMNS)


@query("typed_activity")
def _(spark, sf):
    raw = raw_text(spark, sf).withColumnsRenamed(RAW_TO_CANONICAL)
    return cleaning.cast_columns(raw).select("file_name", *CANONICAL_COLUMNS)


@query("quarantine")
def _(spark, sf):
    return cleaning.rejected_rows(defective(spark, sf), CELLS)


@query("clean_activity")
def _(spark, sf):
    return cleaning.clean_activity(defective(spark, sf), CELLS)


@query("cleaning_counts")
def _(spark, sf):
    return cleaning.cleaning_counts(defective(spark, sf), CELLS)


@query("null_policy")
def _(spark, sf):
    return cleaning.nulls_handled(cleaning.valid_rows(defective(spark, sf), CELLS))


@query("null_profile")
def _(spark, sf):
    return cleaning.null_profile(defective(spark, sf))


@query("reconcile")
def _(spark, sf):
    rows = defective(spark, sf)
    return cleaning.reconcile(rows, cleaning.clean_activity(rows, CELLS), CELLS)


@query("fail_fast_checks")
def _(spark, sf):
    return cleaning.fail_fast_checks(defective(spark, sf), CELLS)


@query("landing_verdict")
def _(spark, sf):
    return landing.landing_verdict(raw_text(spark, sf))


@query("landing_rerun")
def _(spark, sf):
    rows = raw_text(spark, sf)
    accepted = (
        rows.filter(F.col("file_name") <= "sms-call-internet-mi-2024-01-10.csv")
        .select(F.col("file_name").alias("filename"))
        .distinct()
    )
    return landing.landing_summary(landing.landing_verdict(rows, accepted=accepted))


@query("landing_new_files")
def _(spark, sf):
    rows = raw_text(spark, sf)
    files = rows.select("file_name").distinct()
    return landing.new_files(landing.named_like_contract(files), landing.landing_verdict(rows))


@query("landing_accepted_rows")
def _(spark, sf):
    rows = raw_text(spark, sf)
    verdict = sinks.stage_table(landing.landing_verdict(rows), "verdict")
    good = landing.accepted_rows(rows, verdict)
    return quality.file_report(good, "file_name")


@query("cadence_by_day")
def _(spark, sf):
    return quality.cadence_by_day(activity(spark, sf))


@query("cadence_steps")
def _(spark, sf):
    return quality.cadence_steps(activity(spark, sf))


@query("cadence_global")
def _(spark, sf):
    return quality.cadence_global(activity(spark, sf))


@query("raw_grain_dups")
def _(spark, sf):
    return quality.raw_grain_duplicates(activity(spark, sf))


@query("raw_grain_checks")
def _(spark, sf):
    return quality.raw_grain_checks(clean(spark, sf))


@query("exact_duplicates")
def _(spark, sf):
    return quality.exact_duplicates(activity(spark, sf))


@query("rows_per_grid_hour")
def _(spark, sf):
    return quality.rows_per_grid_hour(activity(spark, sf))


@query("grain_checks")
def _(spark, sf):
    return quality.grain_checks(clean(spark, sf), hourly(spark, sf), CELLS, cell_count(spark, sf))


def with_source_file(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(
        F.lit("sms-call-internet-mi-"), F.date_format("timestamp", "yyyy-MM-dd"), F.lit(".csv")
    )
    return activity(spark, sf).withColumn("source_file", name)


@query("ingest_acceptance")
def _(spark, sf):
    return quality.ingest_acceptance(with_source_file(spark, sf), grids=CELLS)


@query("file_report")
def _(spark, sf):
    return quality.file_report(with_source_file(spark, sf))


@query("profile")
def _(spark, sf):
    return quality.profile(defective(spark, sf).drop("event_id"))


@query("file_profile")
def _(spark, sf):
    return quality.profile(with_source_file(spark, sf), "source_file")


@query("country_counts")
def _(spark, sf):
    return quality.country_counts(activity(spark, sf))


@query("alert_input_checks")
def _(spark, sf):
    return quality.alert_input_checks(hourly(spark, sf), CELLS)


@query("alert_table_checks")
def _(spark, sf):
    return quality.alert_table_checks(stored_alerts(spark, sf), cell_reference(spark, sf), CELLS)


@query("parity", decimals=4)
def _(spark, sf):
    names = {v: k for k, v in RAW_TO_CANONICAL.items()}
    text = activity(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in names])
    other = cleaning.clean_or_raise(cleaning.cast_columns(text), CELLS)
    return quality.parity(clean(spark, sf), other)


@query("schema_contract")
def _(spark, sf):
    df = hourly(spark, sf)
    return df.select(*HOURLY_COLUMNS).groupBy("date").agg(F.count("*").alias("rows"))


# --- projections -------------------------------------------------------------


@query("time_features")
def _(spark, sf):
    stamps = activity(spark, sf).select("timestamp").distinct()
    return times.add_time_features(stamps).withColumns(
        {
            "weekday_monday0": times.day_of_week_monday0(F.col("timestamp")),
            "weekday_name": times.day_name(F.col("timestamp")),
            "time_key": times.time_key(F.col("timestamp")),
        }
    )


@query("tz_shift")
def _(spark, sf):
    stamps = activity(spark, sf).select("timestamp").distinct()
    return stamps.withColumn(
        "local_timestamp", times.shift_zone(F.col("timestamp"), "Asia/Kolkata")
    )


@query("hourly_contract")
def _(spark, sf):
    enriched = geo.enrich(hourly(spark, sf), cell_reference(spark, sf))
    return enriched.select(*HOURLY_COLUMNS)


@query("enriched_contract")
def _(spark, sf):
    enriched = geo.enrich(hourly(spark, sf), cell_reference(spark, sf))
    return geo.enriched_contract(geo.add_centroid(enriched))


# --- aggregates and rankings ---------------------------------------------------


@query("grid_hour")
def _(spark, sf):
    return hourly(spark, sf)


@query("daily_traffic")
def _(spark, sf):
    return aggregate.daily_traffic(hourly(spark, sf))


@query("daily_summary")
def _(spark, sf):
    return aggregate.daily_summary(hourly(spark, sf))


@query("grid_summary")
def _(spark, sf):
    return aggregate.grid_summary(hourly(spark, sf))


@query("dashboard")
def _(spark, sf):
    return aggregate.dashboard(hourly(spark, sf))


@query("summary_stats")
def _(spark, sf):
    return aggregate.summary_stats(hourly(spark, sf))


@query("hotspots")
def _(spark, sf):
    return aggregate.hotspots(hourly(spark, sf))


@query("peak_hour")
def _(spark, sf):
    return aggregate.peak_hour(hourly(spark, sf))


@query("busiest")
def _(spark, sf):
    return aggregate.busiest(hourly(spark, sf))


# --- geometry ------------------------------------------------------------------


@query("geo_enrich")
def _(spark, sf):
    enriched = geo.enrich(hourly(spark, sf), cell_reference(spark, sf))
    return enriched.select("timestamp", "grid_id", "total_activity", "geometry")


@query("geo_enrich_merge")
def _(spark, sf):
    enriched = geo.enrich(hourly(spark, sf), cell_reference(spark, sf), hint="merge")
    return enriched.select("timestamp", "grid_id", "total_activity", "geometry")


@query("geo_coverage")
def _(spark, sf):
    return geo.coverage(geo.enrich(hourly(spark, sf), cell_reference(spark, sf)))


@query("geo_unmatched")
def _(spark, sf):
    return geo.unmatched_grids(hourly(spark, sf), cell_reference(spark, sf))


@query("geo_acceptance")
def _(spark, sf):
    hours, cells = stored_hourly(spark, sf), cell_reference(spark, sf)
    return geo.acceptance(hours, geo.enrich(hours, cells), cells)


@query("geo_lookup_from_enriched")
def _(spark, sf):
    enriched = geo.enrich(hourly(spark, sf), cell_reference(spark, sf))
    return layout.lookup_of(enriched, ["grid_id"], ["geometry"])


@query("geo_spot_check")
def _(spark, sf):
    return geo.spot_check(all_cells(spark, sf), [1, 2, 15])


@query("cell_centroids")
def _(spark, sf):
    shape = F.col("geometry")
    return cell_reference(spark, sf).select(
        "grid_id",
        geom.centroid_text(shape).alias("centroid"),
        geom.longitude(shape, drop_closing=True).alias("center_longitude"),
        geom.latitude(shape, drop_closing=True).alias("center_latitude"),
    )


@query("top_grids_geo")
def _(spark, sf):
    return geo.top_grids(hourly(spark, sf), cell_reference(spark, sf))


# --- warehouse -------------------------------------------------------------------


@query("dim_time")
def _(spark, sf):
    return dims(spark, sf)[0]


@query("dim_grid")
def _(spark, sf):
    return dims(spark, sf)[1]


@query("fact_build")
def _(spark, sf):
    return warehouse.fact(hourly(spark, sf), *stored_dims(spark, sf))


@query("star_join")
def _(spark, sf):
    return star(spark, sf)


@query("star_checks")
def _(spark, sf):
    hours, (t, g) = stored_hourly(spark, sf), stored_dims(spark, sf)
    facts = sinks.stage_table(warehouse.fact(hours, t, g), "fact")
    return warehouse.star_checks(hours, facts, t, g)


@query("network_summary")
def _(spark, sf):
    facts = stored_star(spark, sf)
    return aggregate.network_summary(facts).unionByName(aggregate.network_summary(facts, AS_OF))


@query("grid_history")
def _(spark, sf):
    times, grids = stored_dims(spark, sf)
    facts = warehouse.fact(hourly(spark, sf), times, grids)
    s = sinks.stage_table(warehouse.star(facts, times, grids), "star")
    parts = [
        aggregate.grid_history(s, 8, times=times).withColumn("request", F.lit("last 24 hours")),
        aggregate.grid_history(s, 8, date=DAY, times=times).withColumn("request", F.lit("date")),
        aggregate.grid_history(s, 8, hour=9, as_of=AS_OF).withColumn("request", F.lit("hour")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("grid_exists")
def _(spark, sf):
    requested = events(spark, sf).select((F.col("user_id") + 1).cast("int").alias("grid_id"))
    return aggregate.grid_exists(requested.distinct(), cell_reference(spark, sf), CELLS)


@query("hourly_trend")
def _(spark, sf):
    return aggregate.hourly_trend(star(spark, sf))


@query("internet_heavy")
def _(spark, sf):
    return aggregate.internet_heavy(star(spark, sf))


@query("hotspot_feed")
def _(spark, sf):
    return alerts.hotspot_feed(star(spark, sf), 20, AS_OF)


# --- alerts ----------------------------------------------------------------------


@query("loo_baseline")
def _(spark, sf):
    df = leave_one_out_median(hourly(spark, sf), ["grid_id"])
    return df.select("grid_id", "timestamp", "total_activity", "history_count", "baseline_activity")


@query("activity_floor")
def _(spark, sf):
    return alerts.activity_floor(hourly(spark, sf))


@query("alerts")
def _(spark, sf):
    return alert_rows(spark, sf)


@query("alerts_adjacent")
def _(spark, sf):
    return alerts.alerts(
        hourly(spark, sf), spike_ratio=1.2, floor=100.0, require_adjacent=True, decimals=4
    )


@query("alert_summary")
def _(spark, sf):
    hours = stored_hourly(spark, sf)
    return alerts.alert_summary(alert_rows(spark, sf, hours), hours)


@query("alert_top_grids")
def _(spark, sf):
    return alerts.alert_top_grids(alert_rows(spark, sf))


@query("alerts_by_hour")
def _(spark, sf):
    return alerts.alerts_by_hour(alert_rows(spark, sf))


@query("alert_feed")
def _(spark, sf):
    return alerts.alert_feed(stored_alerts(spark, sf), 50, as_of=AS_OF)


@query("alert_feed_high")
def _(spark, sf):
    return alerts.alert_feed(stored_alerts(spark, sf), 50, level="HIGH")


@query("ranked_ops")
def _(spark, sf):
    hot = alerts.hotspot_feed(star(spark, sf), 20, AS_OF)
    return alerts.ranked_operations(hot, alerts.alert_feed(stored_alerts(spark, sf), 30, as_of=AS_OF))


@query("grid_status")
def _(spark, sf):
    hot = alerts.hotspot_feed(star(spark, sf), 20, AS_OF)
    return alerts.grid_status(hot, alerts.alert_feed(stored_alerts(spark, sf), 60, as_of=AS_OF))


# --- anomalies ---------------------------------------------------------------------


@query("anomaly_scores", decimals=9)
def _(spark, sf):
    return anomaly_rows(spark, sf)


@query("anomaly_scores_filled", decimals=9)
def _(spark, sf):
    return anomaly.anomaly_scores(filled(spark, sf), threshold=1.0, decimals=4)


@query("anomaly_summary")
def _(spark, sf):
    return anomaly.anomaly_summary(anomaly_rows(spark, sf))


@query("anomaly_cases", decimals=9)
def _(spark, sf):
    return anomaly.anomaly_cases(settle(anomaly_rows(spark, sf), 9))


@query("case_history")
def _(spark, sf):
    cases = anomaly.anomaly_cases(settle(anomaly_rows(spark, sf), 9))
    cases = sinks.stage_table(cases, "cases")
    return anomaly.case_history(cases, hourly(spark, sf))


# --- features, label, split ----------------------------------------------------------


@query("grid_features", decimals=9)
def _(spark, sf):
    return features.grid_features(filled(spark, sf))


@query("feature_checks")
def _(spark, sf):
    return quality.feature_checks(feature_rows(spark, sf))


@query("latest_features", decimals=9)
def _(spark, sf):
    return features.latest_features(feature_rows(spark, sf))


@query("feature_freshness")
def _(spark, sf):
    df = features.feature_status(feature_rows(spark, sf))
    return df.select("grid_id", "feature_timestamp", "data_quality", "freshness")


@query("grid_features_at", decimals=9)
def _(spark, sf):
    rows = feature_rows(spark, sf)
    return features.grid_features_at(rows, 7, grids=CELLS).unionByName(
        features.grid_features_at(rows, 7, AS_OF, CELLS)
    )


@query("next_hour_label")
def _(spark, sf):
    rows = features.next_hour_label(feature_rows(spark, sf), filled(spark, sf), LABEL_THRESHOLD)
    return rows.select(
        "grid_id", "feature_timestamp", "next_hour_activity", "high_activity_target"
    )


@query("next_hour_label_windowed", decimals=9)
def _(spark, sf):
    return labelled(spark, sf)


@query("chrono_split")
def _(spark, sf):
    return model.describe_split(split(spark, sf))


@query("feature_means")
def _(spark, sf):
    return signals.feature_means(labelled(spark, sf))


@query("feature_corr")
def _(spark, sf):
    return signals.feature_corr(labelled(spark, sf))


@query("feature_pairs")
def _(spark, sf):
    return signals.feature_pairs(labelled(spark, sf), limit=None)


@query("feature_quantiles")
def _(spark, sf):
    # read three times (moments, segments, values), so stored once
    rows = labelled(spark, sf).select("high_activity_target", "avg_activity")
    return signals.feature_quantiles(sinks.stage_table(rows, "labelled"))


@query("threshold_rates")
def _(spark, sf):
    return signals.threshold_rates(labelled(spark, sf), FEATURE_THRESHOLDS)


@query("activity_bands")
def _(spark, sf):
    return signals.activity_bands(labelled(spark, sf), FEATURE_BANDS)


# --- signals ----------------------------------------------------------------------


@query("confusion")
def _(spark, sf):
    return signals.confusion(model_test(spark, sf), "risk_score", "high_activity_target")


@query("ranking_metrics")
def _(spark, sf):
    return ranks.ranking_metrics(model_test(spark, sf), "risk_score", "high_activity_target")


@query("nearest_scores")
def _(spark, sf):
    return signals.nearest_scores(scored(spark, sf))


@query("three_way", decimals=9)
def _(spark, sf):
    return comparison(spark, sf)


@query("three_way_overlap")
def _(spark, sf):
    return signals.three_way_overlap(comparison(spark, sf))


@query("outcome_rates")
def _(spark, sf):
    return signals.outcome_rates(comparison(spark, sf))


@query("disagreements", decimals=9)
def _(spark, sf):
    return signals.disagreements(settle(comparison(spark, sf), 9))


@query("alert_vs_model")
def _(spark, sf):
    return alert_comparison(spark, sf)


@query("comparison_summary")
def _(spark, sf):
    return signals.comparison_summary(alert_comparison(spark, sf))


@query("alert_type_overlap")
def _(spark, sf):
    return signals.alert_type_overlap(sinks.stage_table(alert_comparison(spark, sf), "comparison"))


@query("risk_rows_rule_score", decimals=9)
def _(spark, sf):
    hours = stored_hourly(spark, sf)
    anomalies = anomaly.anomaly_scores(filled(spark, sf, hours), decimals=4)
    return signals.risk_table(signals.combine_risk(scored(spark, sf, hours), anomalies))


# --- fitted model -------------------------------------------------------------------


def fitted(spark: SparkSession, sf: str):
    table = split(spark, sf)
    return model.train(table.filter("split = 'train'")), table


@query("risk_model")
def _(spark, sf):
    fit, table = fitted(spark, sf)
    rows = table.filter("split = 'train'").count()
    return model.coefficients(fit, spark, rows)


@query("risk_model_metrics")
def _(spark, sf):
    fit, table = fitted(spark, sf)
    return model.evaluate(model.score(fit, table.filter("split = 'test'")))


@query("risk_ablation")
def _(spark, sf):
    table = split(spark, sf)
    return model.ablation(table.filter("split = 'train'"), table.filter("split = 'test'"))


@query("risk_scores")
def _(spark, sf):
    fit, table = fitted(spark, sf)
    anomalies = anomaly.anomaly_scores(filled(spark, sf), decimals=4)
    return signals.risk_table(signals.combine_risk(model.score(fit, table), anomalies))


@query("risk_point")
def _(spark, sf):
    fit, table = fitted(spark, sf)
    return model.predict_point(fit, table, 7, AS_OF)


ONE = ["avg_activity"]


def newton_fitted(spark: SparkSession, sf: str) -> tuple[newton.Fit, DataFrame]:
    """The one-feature fit and the table of both splits."""
    table = split(spark, sf, names=ONE)
    return newton.fit(table.filter("split = 'train'"), ONE), table


@query("newton_fit")
def _(spark, sf):
    return newton.coefficients(newton_fitted(spark, sf)[0], spark)


@query("newton_scores")
def _(spark, sf):
    fit, table = newton_fitted(spark, sf)
    anomalies = anomaly.anomaly_scores(filled(spark, sf), decimals=4)
    return signals.risk_table(signals.combine_risk(newton.score(fit, table), anomalies))


@query("newton_point")
def _(spark, sf):
    fit, table = newton_fitted(spark, sf)
    return model.point(newton.score(fit, model.row_at(table, 7, AS_OF)))


@query("model_save_load", decimals=4)
def _(spark, sf):
    """Coefficients of the one-feature pipeline after saving and loading it."""
    table = split(spark, sf, names=ONE).filter("split = 'train'")
    path = scratch(spark)
    model.save(model.train(table, ONE, tol=1e-13), path)
    return model.coefficients(model.load(path, ONE), spark, table.count())


@query("newton_ablation")
def _(spark, sf):
    """Test metrics of the one-feature set, fitted beside the other sets in the same passes."""
    table = split(spark, sf)
    fits = newton.fit_sets(table.filter("split = 'train'"), model.FEATURE_SETS)
    name = "avg_activity only"
    found = model.evaluate(newton.score(fits[name], table.filter("split = 'test'")))
    return found.select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "roc_auc", "average_precision")


# --- stream ---------------------------------------------------------------------------


@query("live_hotspots")
def _(spark, sf):
    """The event table read as a stream; hours closed by the watermark are judged."""
    baseline = settle(live.static_baseline(hourly(spark, sf)), 4)
    raw = stream_table(spark, f"{sf}/events.parquet", events(spark, sf).schema)
    totals = live.hourly_stream(events_as_activity(raw), decimals=2, grids=CELLS)
    found = live.hotspot_alerts(totals, sinks.stage_table(baseline, "baseline"))
    folder = scratch(spark)
    live.start(found, f"{folder}/alerts", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/alerts")


@query("live_rules")
def _(spark, sf):
    """All three rules over the event table as a stream; a spike needs the hour before."""
    baseline = sinks.stage_table(settle(live.static_baseline(hourly(spark, sf)), 4), "baseline")
    raw = stream_table(spark, f"{sf}/events.parquet", events(spark, sf).schema)
    found = live.rule_alerts(events_as_activity(raw), baseline, decimals=2, grids=CELLS)
    folder = scratch(spark)
    live.start(found, f"{folder}/alerts", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/alerts")


# --- files ----------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def csv_folder(spark: SparkSession, sf: str) -> str:
    """The activity as raw CSV files with the columns in another order than the contract's."""
    path = scratch(spark)
    raw = activity(spark, sf).withColumnsRenamed({v: k for k, v in RAW_TO_CANONICAL.items()})
    sinks.write_csv(raw.select(*reversed(raw.columns)), path)
    return path


@query("csv_typed_scan")
def _(spark, sf):
    rows = read_typed_csv(spark, csv_folder(spark, sf), "*.csv")
    return to_canonical(rows).select(*CANONICAL_COLUMNS)


@query("csv_text_scan")
def _(spark, sf):
    rows = to_canonical(read_text_csv(spark, csv_folder(spark, sf)))
    named = F.count_if(F.col("input_file_name").endswith(".csv"))
    counts = cleaning.cast_columns(rows).groupBy("grid_id")
    return counts.agg(named.alias("rows_with_file"), *[F.sum(c).alias(c) for c in ACTIVITY])


@query("parquet_round_trip")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_parquet(hourly(spark, sf), path)
    return read_table(spark, path).select(*HOURLY_COLUMNS)


@query("storage_stage")
def _(spark, sf):
    """Clean and hourly tables written, read again and checked against what was written."""
    rows = sinks.stage_table(clean(spark, sf), "clean")
    hours = sinks.stage_table(aggregate.grid_hour(rows, decimals=2), "hourly")
    return batch.storage_stage(rows, hours, scratch(spark), every=True)


@query("date_partitions_round_trip")
def _(spark, sf):
    path = scratch(spark)
    sinks.write_by_date(clean(spark, sf), path)
    sinks.write_by_date(clean(spark, sf).filter(F.col("date") == F.lit(DAY)), path)
    return read_table(spark, path).groupBy("date").agg(*[F.sum(c).alias(c) for c in MEASURES])


@query("report_round_trip")
def _(spark, sf):
    path = scratch(spark)
    stats = aggregate.summary_stats(hourly(spark, sf))
    sinks.write_report(stats, path)
    return spark.read.schema(stats.schema).json(path)


@query("audit_log")
def _(spark, sf):
    path = scratch(spark)
    verdict = sinks.stage_table(landing.landing_verdict(raw_text(spark, sf)), "verdict")
    for _ in range(2):
        sinks.append_audit(landing.audit_records(verdict), path)
    return read_table(spark, path).groupBy("filename", "status", "reason").agg(
        F.count("*").alias("records"), F.sum("row_count").alias("row_count")
    )


@query("table_refresh")
def _(spark, sf):
    path = scratch(spark)
    versions.commit(aggregate.daily_summary(hourly(spark, sf)), path)
    versions.commit(aggregate.daily_traffic(hourly(spark, sf)), path)
    return versions.read(spark, path)


def refreshed(spark: SparkSession, sf: str) -> str:
    """Derived tables after two loads: the first half of the days, one of them short of rows, then the rest and its correction."""
    path = scratch(spark)
    rows = sinks.stage_table(clean(spark, sf), "clean")
    first = rows.filter((F.col("date") < DAY) & ((F.col("date") != CORRECTED) | (F.col("grid_id") % 3 != 0)))
    refresh.load_days(first, path, decimals=2)
    refresh.refresh(spark, path)
    refresh.load_days(rows.filter((F.col("date") >= DAY) | (F.col("date") == CORRECTED)), path, decimals=2)
    refresh.refresh(spark, path)
    return path


@query("incremental_refresh")
def _(spark, sf):
    path = refreshed(spark, sf)
    total = F.col("total_activity").cast("double").alias("total_activity")

    def shown(name: str, key: Column, rows: str) -> DataFrame:
        table = versions.read(spark, f"{path}/{name}")
        return table.select(F.lit(name).alias("table_name"), key.cast("string").alias("key"), total, F.col(rows).alias("row_count"))

    parts = [
        shown("daily_summary", F.col("date"), "active_grid_hours"),
        shown("daily_traffic", F.col("date"), "active_grids"),
        shown("dashboard", F.date_format("timestamp", "yyyy-MM-dd HH"), "active_grids"),
        shown("cells", F.col("grid_id"), "active_hours"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("network_summary_snapshot")
def _(spark, sf):
    path = refreshed(spark, sf)
    parts = [refresh.network_summary_at(spark, path, at) for at in (AS_OF, EARLY)]
    return reduce(DataFrame.unionByName, parts)


# --- layout -------------------------------------------------------------------------


@query("sampled_rows")
def _(spark, sf):
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH")
    key = F.concat_ws("|", "grid_id", stamp, "country_code")
    sample = layout.sample_rows(clean(spark, sf), 0.1, 42, key)
    return sample.agg(F.count("*").alias("rows"), F.sum("total_activity").alias("total_activity"))


@query("by_date_layout")
def _(spark, sf):
    laid = layout.by_date(clean(spark, sf))
    return laid.groupBy("date").agg(*[F.sum(c).alias(c) for c in MEASURES])


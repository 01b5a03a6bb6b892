"""Table contracts and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw file layout and canonical names.
RAW_TO_CANONICAL = {
    "datetime": "timestamp",
    "CellID": "grid_id",
    "countrycode": "country_code",
    "smsin": "sms_in",
    "smsout": "sms_out",
    "callin": "call_in",
    "callout": "call_out",
    "internet": "internet_activity",
}
RAW_COLUMNS = list(RAW_TO_CANONICAL)
RAW_ACTIVITY = RAW_COLUMNS[3:]
CANONICAL_COLUMNS = list(RAW_TO_CANONICAL.values())
ACTIVITY = CANONICAL_COLUMNS[3:]
TOTALS = ["total_sms", "total_calls", "total_activity"]
MEASURES = ACTIVITY + TOTALS
FILE_NAME_PATTERN = r"^sms-call-internet-mi-\d{4}-\d{2}-\d{2}\.csv$"
FILE_GLOB = "sms-call-internet-mi-*.csv"

# Valid cell ids of the reference grid; operators take other ranges as arguments.
GRID_RANGE = (1, 10_000)
EXPECTED_GRIDS = 10_000

# Thresholds.
HIGH_RATIO, SPIKE_RATIO, DROP_RATIO = 2.0, 1.5, 0.5
FLOOR_PERCENTILE = 0.10
ANOMALY_THRESHOLD, ANOMALY_THRESHOLD_FILE_JOB = 0.5, 1.0
MIN_HISTORY_DAYS = 2
TARGET_THRESHOLD = 2000.0
TRAIN_RATIO = 0.8
RISK_THRESHOLD = 0.5
HISTORY_HOURS, RECENT_HOURS = 48, 24
MODEL_VERSION = "ml3-logistic-regression-v1"
INSERT_BATCH = 25_000

# Codes.
ALERT_SEVERITY = {"HIGH_ACTIVITY": "HIGH", "ACTIVITY_SPIKE": "MEDIUM", "ACTIVITY_DROP": "MEDIUM"}
SEVERITY_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
STATUS_RANK = {"HIGH": 3, "ATTENTION": 2, "NORMAL": 1}
FEATURES = [
    "avg_activity",
    "activity_growth",
    "active_hours",
    "peak_ratio",
    "variability",
    "internet_share",
]
QUANTILE_PROBS = {"median": 0.5, "p90": 0.90, "p95": 0.95, "p99": 0.99}
CURRENT_THRESHOLDS = [500.0, 1000.0, 1500.0, 2000.0, 3000.0, 5000.0]
ACTIVITY_BANDS = [0.0, 100.0, 250.0, 500.0, 1000.0, 1500.0, 2000.0, 3000.0, 5000.0]
SCORE_TARGETS = [0.10, 0.20, 0.30, 0.40, 0.60, 0.70, 0.80, 0.90]
CORRELATION_LIMIT = 0.70


_TYPES = {
    "timestamp_ntz": T.TimestampNTZType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
}


def _struct(spec: str) -> T.StructType:
    fields = [field.split() for field in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# Timestamps are naive wall-clock hours, so TIMESTAMP_NTZ: no result depends
# on the session time zone.
RAW_SCHEMA = _struct(
    "datetime timestamp_ntz, CellID int, countrycode int, smsin double, smsout double, "
    "callin double, callout double, internet double"
)
RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
ACTIVITY_SCHEMA = _struct(
    "timestamp timestamp_ntz, grid_id int, country_code int, sms_in double, sms_out double, "
    "call_in double, call_out double, internet_activity double"
)
CLEAN_SCHEMA = _struct(
    "timestamp timestamp_ntz, grid_id int, country_code int, sms_in double, sms_out double, "
    "call_in double, call_out double, internet_activity double, input_file_name string, "
    "date date, hour int, day_of_week int, total_sms double, total_calls double, "
    "total_activity double"
)
HOURLY_SCHEMA = _struct(
    "timestamp timestamp_ntz, grid_id int, sms_in double, sms_out double, call_in double, "
    "call_out double, internet_activity double, total_sms double, total_calls double, "
    "total_activity double, internet_share double, date date, hour int, day_of_week int"
)
HOURLY_COLUMNS = HOURLY_SCHEMA.fieldNames()
ENRICHED_COLUMNS = (
    ["timestamp", "grid_id"] + ACTIVITY + ["total_activity", "geometry", "centroid"]
)
DIM_TIME_COLUMNS = ["time_key", "timestamp", "date", "hour", "day_of_week"]
DIM_GRID_COLUMNS = ["grid_key", "grid_id", "latitude", "longitude", "geometry_reference"]
FACT_COLUMNS = ["time_key", "grid_key"] + MEASURES
ALERT_COLUMNS = [
    "grid_id", "timestamp", "alert_type", "current_activity", "baseline_activity", "reason",
]
ANOMALY_COLUMNS = [
    "grid_id", "timestamp", "hour_of_day", "current_activity", "baseline_activity",
    "history_count", "deviation", "anomaly_score", "direction", "is_anomaly", "reason",
]
FEATURE_COLUMNS = ["grid_id", "feature_timestamp"] + FEATURES
RISK_COLUMNS = [
    "grid_id", "timestamp", "risk_score", "risk_level", "model_version", "anomaly_score",
    "anomaly_direction", "is_anomaly", "anomaly_reason",
]
AUDIT_SCHEMA = _struct(
    "filename string, status string, row_count long, reason string, processed_at timestamp"
)

"""SQL equivalents of the registered queries, for an independent engine.

Written from the definitions, not from the Spark plans: medians by self-join,
windows with explicit frames, hour gaps by a generated calendar.
"""

from __future__ import annotations

import re

from gridpulse.plans.catalog import FEATURE_BANDS, FEATURE_THRESHOLDS, LABEL_THRESHOLD
from gridpulse.schemas import FEATURES, SCORE_TARGETS

_MEASURES5 = ["sms_in", "sms_out", "call_in", "call_out", "internet_activity"]
_MEASURES = _MEASURES5 + ["total_sms", "total_calls", "total_activity"]
_TRAFFIC = ["total_sms", "total_calls", "internet_activity", "total_activity"]
_AS_OF = "TIMESTAMP '2024-01-20 12:00:00'"

_CHANNELS = """
    CASE WHEN event_type = 'click' THEN value END AS sms_in,
    CASE WHEN event_type = 'view' THEN value END AS sms_out,
    CASE WHEN event_type = 'signup' THEN value END AS call_in,
    CASE WHEN event_type = 'purchase' THEN value END AS call_out,
    CASE WHEN event_type = 'error' THEN value END AS internet_activity"""

_TIME = """CAST("timestamp" AS DATE) AS date, CAST(hour("timestamp") AS INTEGER) AS hour,
    CAST(dayofweek("timestamp") + 1 AS INTEGER) AS day_of_week"""

_REASON = """CASE WHEN "timestamp" IS NULL THEN 'missing_timestamp'
    WHEN grid_id IS NULL THEN 'missing_grid_id'
    WHEN grid_id < 1 THEN 'invalid_grid_id'
    WHEN coalesce(sms_in < 0, false) OR coalesce(sms_out < 0, false)
      OR coalesce(call_in < 0, false) OR coalesce(call_out < 0, false)
      OR coalesce(internet_activity < 0, false) THEN 'negative_activity' END"""


def _clean_select(source: str, keep: str = "") -> str:
    zeroed = ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in _MEASURES5)
    return f"""
    SELECT *, sms_in + sms_out AS total_sms, call_in + call_out AS total_calls,
      sms_in + sms_out + (call_in + call_out) + internet_activity AS total_activity
    FROM (SELECT {keep} "timestamp", grid_id, country_code, {zeroed}, {_TIME}
      FROM {source} WHERE {_REASON} IS NULL)"""


_SUMS = ", ".join(f"round(sum({c}), 2) AS {c}" for c in _MEASURES5)

# Common table expressions in dependency order.
_CTES: list[tuple[str, str]] = [
    (
        "activity",
        f"""SELECT date_trunc('hour', ts) AS "timestamp", CAST(user_id + 1 AS INTEGER) AS grid_id,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS country_code, {_CHANNELS}
    FROM events""",
    ),
    (
        "defective",
        f"""SELECT event_id,
    CASE WHEN event_id % 101 <> 0 THEN "timestamp" END AS "timestamp",
    CASE WHEN event_id % 89 = 3 THEN NULL WHEN event_id % 83 = 5 THEN 0
      ELSE grid_id END AS grid_id,
    country_code, CASE WHEN event_id % 97 = 7 THEN -1.0 ELSE sms_in END AS sms_in,
    sms_out, call_in, call_out, internet_activity
    FROM (SELECT event_id, date_trunc('hour', ts) AS "timestamp",
      CAST(user_id + 1 AS INTEGER) AS grid_id,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS country_code, {_CHANNELS}
      FROM events)""",
    ),
    ("clean", _clean_select("activity")),
    ("clean_defective", _clean_select("defective", "event_id,")),
    (
        "raw_text",
        f"""SELECT 'sms-call-internet-mi-' || strftime("timestamp", '%Y-%m-%d') || '.csv'
      AS file_name,
    CASE WHEN event_id % 1009 = 5 THEN NULL ELSE "timestamp" END AS "timestamp",
    CASE WHEN event_id % 1013 = 7 THEN NULL ELSE grid_id END AS grid_id,
    CASE WHEN event_id % 1511 = 9 THEN NULL ELSE country_code END AS country_code,
    CASE WHEN event_id % 701 = 11 THEN -4.5 ELSE sms_in END AS sms_in,
    CASE WHEN event_id % 997 = 13 THEN NULL ELSE sms_out END AS sms_out,
    event_id % 997 = 13 AS bad_smsout, call_in, call_out, internet_activity
    FROM (SELECT event_id, date_trunc('hour', ts) AS "timestamp",
      CAST(user_id + 1 AS INTEGER) AS grid_id,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS country_code, {_CHANNELS}
      FROM events)""",
    ),
    (
        "verdict",
        """SELECT file_name AS filename, count(*) AS row_count,
    CASE WHEN count(*) FILTER ("timestamp" IS NULL) > 0
      THEN 'Invalid datetime values: ' || count(*) FILTER ("timestamp" IS NULL)
    WHEN count(*) FILTER (grid_id IS NULL) > 0
      THEN 'Invalid or missing CellID values: ' || count(*) FILTER (grid_id IS NULL)
    WHEN count(*) FILTER (country_code IS NULL) > 0
      THEN 'Invalid or missing countrycode values: ' || count(*) FILTER (country_code IS NULL)
    WHEN count(*) FILTER (sms_in < 0) > 0
      THEN 'Negative activity values in smsin: ' || count(*) FILTER (sms_in < 0)
    WHEN count(*) FILTER (bad_smsout) > 0
      THEN 'Invalid non-numeric values in smsout: ' || count(*) FILTER (bad_smsout)
    END AS failure
    FROM raw_text GROUP BY file_name""",
    ),
    (
        "hourly",
        f"""SELECT "timestamp", grid_id, {", ".join(_MEASURES5)}, total_sms, total_calls,
    total_activity,
    CASE WHEN total_activity <> 0 THEN round(internet_activity / total_activity, 6)
      ELSE 0.0 END AS internet_share, {_TIME}
    FROM (SELECT *, round(sms_in + sms_out, 2) AS total_sms,
        round(call_in + call_out, 2) AS total_calls,
        round(sms_in + sms_out + (call_in + call_out) + internet_activity, 2) AS total_activity
      FROM (SELECT "timestamp", grid_id, {_SUMS} FROM clean GROUP BY "timestamp", grid_id))""",
    ),
    (
        "cells",
        """SELECT grid_id, '{"type":"Polygon","coordinates":[['
      || printf('[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f]',
         w, s, w + 0.002, s, w + 0.002, s + 0.002, w, s + 0.002, w, s) || ']]}' AS geometry, w, s
    FROM (SELECT grid_id, 9.0::DOUBLE + ((grid_id - 1) % 100) * 0.002::DOUBLE AS w,
        45.0::DOUBLE + ((grid_id - 1) // 100) * 0.002::DOUBLE AS s
      FROM (SELECT DISTINCT CAST(s_suppkey + 1 AS INTEGER) AS grid_id FROM supplier
        WHERE s_suppkey + 1 >= 1))""",
    ),
    (
        "all_cells",
        """SELECT grid_id, '{"type":"Polygon","coordinates":[['
      || printf('[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f]',
         w, s, w + 0.002, s, w + 0.002, s + 0.002, w, s + 0.002, w, s) || ']]}' AS geometry, w, s
    FROM (SELECT grid_id, 9.0::DOUBLE + ((grid_id - 1) % 100) * 0.002::DOUBLE AS w,
        45.0::DOUBLE + ((grid_id - 1) // 100) * 0.002::DOUBLE AS s
      FROM (SELECT DISTINCT CAST(user_id + 1 AS INTEGER) AS grid_id FROM events))""",
    ),
    ("enriched", "SELECT h.*, c.geometry, c.w, c.s FROM hourly h LEFT JOIN cells c USING (grid_id)"),
    (
        "dim_time",
        f"""SELECT CAST(strftime("timestamp", '%Y%m%d%H') AS BIGINT) AS time_key, "timestamp",
    {_TIME} FROM (SELECT DISTINCT "timestamp" FROM activity)""",
    ),
    (
        "base",
        """SELECT a.grid_id, a."timestamp", a.total_activity, a.prev, a.prev_at, a.grid_total, a.n,
    round(quantile_cont(b.total_activity, 0.5), 4) AS baseline
    FROM (SELECT grid_id, "timestamp", total_activity,
        lag(total_activity) OVER (PARTITION BY grid_id ORDER BY "timestamp") AS prev,
        lag("timestamp") OVER (PARTITION BY grid_id ORDER BY "timestamp") AS prev_at,
        round(sum(total_activity) OVER (PARTITION BY grid_id), 4) AS grid_total,
        count(*) OVER (PARTITION BY grid_id) AS n FROM hourly) a
    LEFT JOIN hourly b ON a.grid_id = b.grid_id AND a."timestamp" <> b."timestamp"
    GROUP BY ALL""",
    ),
    (
        "floor_value",
        """SELECT quantile_cont(total, 0.1) AS activity_floor FROM
    (SELECT round(sum(total_activity), 4) AS total FROM hourly GROUP BY grid_id)""",
    ),
]


def _text(value: str) -> str:
    return f"regexp_replace(printf('%.2f', round_even({value}, 2)), '(\\.\\d+?)0+$', '\\1')"


def _alert_union(floor: str, spike: float, adjacent: bool) -> str:
    gap = """AND prev_at = "timestamp" - INTERVAL 1 HOUR""" if adjacent else ""
    eligible = f"grid_total >= {floor} AND baseline > 0"
    head = """SELECT grid_id, "timestamp", '{k}' AS alert_type, total_activity AS current_activity,
      baseline AS baseline_activity, '{k}: current activity ' || {cur} || '{mid}' || {ref} || '.'
      AS reason FROM base WHERE {eligible} AND {test}"""
    current, base, prev = _text("total_activity"), _text("baseline"), _text("prev")
    rules = [
        ("HIGH_ACTIVITY", " is at least 2.0x the baseline ", base,
         "total_activity >= baseline * 2.0"),
        ("ACTIVITY_DROP", " is at or below 0.5x the baseline ", base,
         "total_activity <= baseline * 0.5"),
        ("ACTIVITY_SPIKE", f" is at least {spike}x the preceding hour ", prev,
         f"prev > 0 AND total_activity >= prev * {spike} {gap}"),
    ]
    return "\n    UNION ALL ".join(
        head.format(k=k, cur=current, mid=mid, ref=ref, eligible=eligible, test=test)
        for k, mid, ref, test in rules
    )


def _anomaly(source: str, threshold: float) -> str:
    return f"""SELECT grid_id, "timestamp", hour_of_day, current_activity, baseline_activity,
    history_count, deviation, anomaly_score, direction,
    coalesce(anomaly_score >= {threshold} AND direction IN ('HIGH', 'LOW'), false) AS is_anomaly,
    CASE WHEN history_count <= 1
      THEN 'Insufficient historical observations for hour-of-day baseline.'
    WHEN baseline_activity <= 0
      THEN 'Historical baseline is zero; percentage deviation cannot be calculated.'
    WHEN anomaly_score >= {threshold} AND direction IN ('HIGH', 'LOW')
      THEN direction || ' anomaly: activity is ' || printf('%.1f', round_even(anomaly_score * 100, 1))
        || '% away from the historical median for this grid and hour-of-day.'
    ELSE 'Within expected historical range for this grid and hour-of-day.' END AS reason
    FROM (SELECT *, current_activity - baseline_activity AS deviation,
        CASE WHEN history_count > 1 AND baseline_activity > 0
          THEN abs(current_activity - baseline_activity) / baseline_activity END AS anomaly_score,
        CASE WHEN history_count > 1 AND baseline_activity > 0 THEN
          CASE WHEN current_activity > baseline_activity THEN 'HIGH'
            WHEN current_activity < baseline_activity THEN 'LOW' ELSE 'NONE' END END AS direction
      FROM (SELECT a.grid_id, a."timestamp", CAST(hour(a."timestamp") AS INTEGER) AS hour_of_day,
          a.total_activity AS current_activity,
          round(quantile_cont(b.total_activity, 0.5), 4) AS baseline_activity,
          count(b.total_activity) + 1 AS history_count
        FROM {source} a LEFT JOIN {source} b ON a.grid_id = b.grid_id
          AND hour(a."timestamp") = hour(b."timestamp") AND a."timestamp" <> b."timestamp"
        GROUP BY ALL))"""


_RULE = "round(1.0 / (1.0 + exp(-(avg_activity - 8.0) / 2.0)), 6)"

_CTES += [
    ("alert_rows", _alert_union("(SELECT activity_floor FROM floor_value)", 1.5, False)),
    ("alerts_adjacent", _alert_union("100.0", 1.2, True)),
    (
        "alert_severity",
        """SELECT *, CASE WHEN alert_type = 'HIGH_ACTIVITY' THEN 'HIGH' ELSE 'MEDIUM' END
    AS severity, CASE WHEN alert_type = 'HIGH_ACTIVITY' THEN 3 ELSE 2 END AS severity_rank
    FROM alert_rows""",
    ),
    ("anomaly_rows", _anomaly("hourly", 0.5)),
    (
        "filled",
        """SELECT s.grid_id, s."timestamp", coalesce(h.total_activity, 0.0) AS total_activity,
    coalesce(h.internet_activity, 0.0) AS internet_activity
    FROM (SELECT grid_id, unnest(generate_series(min("timestamp"), max("timestamp"),
        INTERVAL 1 HOUR)) AS "timestamp" FROM hourly GROUP BY grid_id) s
    LEFT JOIN hourly h ON s.grid_id = h.grid_id AND s."timestamp" = h."timestamp" """,
    ),
    ("anomaly_filled", _anomaly("filled", 1.0)),
    ("anomaly_filled_default", _anomaly("filled", 0.5)),
    (
        "windowed",
        """SELECT grid_id, "timestamp" AS feature_timestamp, total_activity,
    avg(total_activity) OVER recent AS a, avg(total_activity) OVER prior AS p,
    count(*) FILTER (total_activity > 0) OVER recent AS h, max(total_activity) OVER recent AS m,
    stddev_pop(total_activity) OVER recent AS s, sum(total_activity) OVER recent AS t,
    sum(internet_activity) OVER recent AS i, count(*) OVER whole AS rows48,
    min("timestamp") OVER whole AS first48
    FROM filled
    WINDOW recent AS (PARTITION BY grid_id ORDER BY "timestamp" ROWS 23 PRECEDING),
    prior AS (PARTITION BY grid_id ORDER BY "timestamp"
      ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING),
    whole AS (PARTITION BY grid_id ORDER BY "timestamp" ROWS 47 PRECEDING)""",
    ),
    (
        "features",
        """SELECT grid_id, feature_timestamp, round(a, 9) + 0.0 AS avg_activity,
    round(CASE WHEN p = 0 THEN 0.0 ELSE (a - p) / p END, 9) + 0.0 AS activity_growth,
    CAST(h AS INTEGER) AS active_hours,
    round(CASE WHEN a = 0 THEN 0.0 ELSE m / a END, 9) + 0.0 AS peak_ratio,
    round(s, 9) + 0.0 AS variability,
    round(CASE WHEN t = 0 THEN 0.0 ELSE i / t END, 9) + 0.0 AS internet_share
    FROM windowed WHERE rows48 = 48 AND first48 = feature_timestamp - INTERVAL 47 HOUR""",
    ),
    (
        "labelled",
        f"""SELECT f.*, n.total_activity AS next_hour_activity,
    CASE WHEN n.total_activity >= {LABEL_THRESHOLD} THEN 1 ELSE 0 END AS high_activity_target
    FROM features f JOIN filled n ON n.grid_id = f.grid_id
      AND n."timestamp" = f.feature_timestamp + INTERVAL 1 HOUR""",
    ),
    (
        "cutoff",
        """SELECT feature_timestamp AS cutoff FROM (
      SELECT feature_timestamp, row_number() OVER (ORDER BY feature_timestamp) - 1 AS i,
        count(*) OVER () AS n
      FROM (SELECT DISTINCT feature_timestamp FROM labelled))
    WHERE i = greatest(1, least(CAST(floor(n * 0.8) AS BIGINT), n - 1))""",
    ),
    (
        "scored",
        f"""SELECT *, CASE WHEN feature_timestamp < (SELECT cutoff FROM cutoff) THEN 'train'
    ELSE 'test' END AS split, {_RULE} AS risk_score FROM labelled""",
    ),
    ("test", "SELECT * FROM scored WHERE split = 'test'"),
    # Newton steps on (intercept, weight); the penalty of the weight is 1
    (
        "newton_rows",
        """SELECT (avg_activity - m) / s AS x, y, m, s FROM (
    SELECT avg_activity, high_activity_target AS y, avg(avg_activity) OVER () AS m, stddev_pop(avg_activity) OVER () AS s
    FROM scored WHERE split = 'train')""",
    ),
    (
        "newton_weights",
        """SELECT b, w, m, s FROM (
    WITH RECURSIVE step AS (
      SELECT 0 AS i, 0.0::DOUBLE AS b, 0.0::DOUBLE AS w
      UNION ALL
      SELECT i + 1, b - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), w - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
      FROM (
        SELECT i, b, w, sum(p - y) AS g0, sum((p - y) * x) + w AS g1, sum(p * (1 - p)) AS h00,
          sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 1.0 AS h11
        FROM (SELECT i, b, w, x, y, 1.0 / (1.0 + exp(-(b + w * x))) AS p FROM newton_rows JOIN step ON i < 20)
        GROUP BY i, b, w))
    SELECT b, w FROM step WHERE i = 20), (SELECT any_value(m) AS m, any_value(s) AS s FROM newton_rows)""",
    ),
    (
        "newton_scored",
        """SELECT * REPLACE (1.0 / (1.0 + exp(-(b + w * (avg_activity - m) / s))) AS risk_score)
    FROM (SELECT scored.*, b, w, m, s FROM scored JOIN newton_weights ON true)""",
    ),
    (
        "comparison",
        """SELECT t.grid_id, t.feature_timestamp AS "timestamp", t.next_hour_activity,
    t.high_activity_target AS target, t.risk_score AS ml3_probability,
    t.risk_score >= 0.5 AS ml3_positive, n.grid_id IS NOT NULL AS np3_alert,
    coalesce(n.types, '') AS np3_alert_types, coalesce(m.is_anomaly, false) AS ml4_anomaly,
    coalesce(m.direction, 'NONE') AS ml4_direction, m.anomaly_score, m.baseline_activity,
    m.current_activity
    FROM test t
    LEFT JOIN (SELECT grid_id, "timestamp",
        string_agg(DISTINCT alert_type, '|' ORDER BY alert_type) AS types
      FROM alert_rows GROUP BY ALL) n
      ON n.grid_id = t.grid_id AND n."timestamp" = t.feature_timestamp
    LEFT JOIN anomaly_rows m ON m.grid_id = t.grid_id AND m."timestamp" = t.feature_timestamp""",
    ),
    (
        "versus",
        """SELECT t.grid_id, t.feature_timestamp,
    CAST(t.risk_score >= 0.5 AS INTEGER) AS ml3_prediction, t.risk_score AS ml3_probability,
    t.high_activity_target, n.grid_id IS NOT NULL AS np3_alert,
    coalesce(n.types, '') AS np3_alert_types, coalesce(n.alerts, 0) AS np3_alert_count,
    t.risk_score >= 0.5 AS ml3_positive,
    CASE WHEN t.risk_score >= 0.5 THEN 'HIGH' ELSE 'NOT_HIGH' END AS ml3_prediction_label,
    t.high_activity_target = 1 AS actual_next_hour_high,
    CASE WHEN n.grid_id IS NOT NULL AND t.risk_score >= 0.5 THEN 'BOTH'
      WHEN n.grid_id IS NOT NULL THEN 'NP3_ONLY'
      WHEN t.risk_score >= 0.5 THEN 'ML3_ONLY' ELSE 'NEITHER' END AS comparison_group
    FROM test t
    LEFT JOIN (SELECT grid_id, "timestamp", count(*) AS alerts,
        string_agg(DISTINCT alert_type, ',' ORDER BY alert_type) AS types
      FROM alert_rows GROUP BY ALL) n
      ON n.grid_id = t.grid_id AND n."timestamp" = t.feature_timestamp""",
    ),
    (
        "cases",
        """SELECT * EXCLUDE (cell_rank) FROM (
      SELECT *, row_number() OVER (PARTITION BY direction ORDER BY
          CASE WHEN cell_rank = 1 THEN 0 ELSE 1 END, anomaly_score DESC, grid_id, "timestamp")::INTEGER
        AS case_number
      FROM (SELECT * REPLACE (round(anomaly_score, 9) AS anomaly_score),
          row_number() OVER (PARTITION BY direction, grid_id
            ORDER BY round(anomaly_score, 9) DESC, "timestamp") AS cell_rank
        FROM anomaly_rows WHERE is_anomaly))
    WHERE case_number <= 2""",
    ),
    (
        "hot_feed",
        f"""SELECT grid_id, "timestamp", total_activity, total_sms AS sms_activity,
    total_calls AS call_activity, internet_activity, {_AS_OF} AS as_of FROM hourly
    WHERE "timestamp" <= {_AS_OF}
    ORDER BY total_activity DESC, grid_id, "timestamp" LIMIT 20""",
    ),
]


def _with(body: str) -> str:
    """Prefix ``body`` with the table expressions it needs, transitively."""
    text = dict(_CTES)
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name, definition in text.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                needed.add(name)
                visit(definition)

    visit(body)
    parts = [f"{name} AS MATERIALIZED (\n    {sql})" for name, sql in _CTES if name in needed]
    return ("WITH " + ",\n  ".join(parts) + "\n" if parts else "") + body


def _checks(source: str, rows: dict[str, tuple[str, str]]) -> str:
    """Check rows from a one-row source."""
    union = " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", CAST({value} AS DOUBLE) AS value, {passed} AS passed FROM q"
        for name, (value, passed) in rows.items()
    )
    return f"SELECT * FROM (WITH q AS ({source}) {union})"


def _zero(column: str) -> tuple[str, str]:
    return column, f"{column} = 0"


def _sum_list(columns: list[str]) -> str:
    return ", ".join(f"sum({c}) AS {c}" for c in columns)


_BODIES: dict[str, tuple[str, list[str]]] = {}


def _add(name: str, sql: str, doubles: list[str] | None = None) -> None:
    _BODIES[name] = (sql, doubles or [])


_add(
    "canonical_activity",
    'SELECT "timestamp", grid_id, country_code, ' + ", ".join(_MEASURES5) + " FROM activity",
    _MEASURES5,
)
_add(
    "typed_activity",
    'SELECT file_name, "timestamp", grid_id, country_code, '
    + ", ".join(_MEASURES5)
    + " FROM raw_text",
    _MEASURES5,
)
_add(
    "quarantine",
    f"SELECT * FROM (SELECT *, {_REASON} AS rejection_reason FROM defective) "
    "WHERE rejection_reason IS NOT NULL",
    _MEASURES5,
)
_add("clean_activity", "SELECT * FROM clean_defective", _MEASURES)
_NULLS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _MEASURES5)
_add(
    "cleaning_counts",
    f"""SELECT count(*) AS input_rows, count(r) AS rejected_rows,
  count(*) FILTER (r IS NULL) AS clean_rows,
  count(*) FILTER (r = 'missing_timestamp') AS missing_timestamp,
  count(*) FILTER (r = 'missing_grid_id') AS missing_grid_id,
  count(*) FILTER (r = 'invalid_grid_id') AS invalid_grid_id,
  count(*) FILTER (r = 'negative_activity') AS negative_activity,
  CAST(sum(CASE WHEN r IS NULL THEN {_NULLS} END) AS BIGINT) AS nulls_handled
FROM (SELECT *, {_REASON} AS r FROM defective)""",
)
_add(
    "null_policy",
    f"""SELECT count(*) AS rows, count(*) FILTER (n > 0) AS rows_with_null,
  CAST(sum(n) AS BIGINT) AS nulls_handled
FROM (SELECT {_NULLS} AS n FROM defective WHERE {_REASON} IS NULL)""",
)
_add(
    "null_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count FROM defective"
        for c in _MEASURES5
    ),
)
_add(
    "reconcile",
    f"""SELECT input_rows, rejected_rows, input_rows - rejected_rows AS expected_rows, clean_rows,
  input_rows - rejected_rows = clean_rows AS reconciled
FROM (SELECT count(*) AS input_rows, count({_REASON}) AS rejected_rows FROM defective),
  (SELECT count(*) AS clean_rows FROM clean_defective)""",
)
_add(
    "fail_fast_checks",
    _checks(
        f"""SELECT count(*) FILTER (r = 'missing_timestamp') AS a,
    count(*) FILTER (r = 'missing_grid_id') AS b, count(*) FILTER (r = 'invalid_grid_id') AS c,
    count(*) FILTER (r = 'negative_activity') AS d
    FROM (SELECT {_REASON} AS r FROM defective)""",
        {
            "missing_timestamp": _zero("a"),
            "missing_grid_id": _zero("b"),
            "invalid_grid_id": _zero("c"),
            "negative_activity": _zero("d"),
        },
    ),
)
_add(
    "landing_verdict",
    """SELECT filename, CASE WHEN failure IS NULL THEN 'ACCEPTED' ELSE 'REJECTED' END AS status,
  row_count, coalesce(failure, 'File validated and routed to raw.') AS reason FROM verdict""",
)
_add(
    "landing_rerun",
    """SELECT count(*) AS detected,
  count(*) FILTER (NOT seen AND failure IS NULL) AS accepted,
  count(*) FILTER (NOT seen AND failure IS NOT NULL) AS rejected,
  count(*) FILTER (seen) AS skipped
FROM (SELECT *, filename <= 'sms-call-internet-mi-2024-01-10.csv' AS seen FROM verdict)""",
)
_add(
    "landing_new_files",
    "SELECT filename AS file_name FROM verdict WHERE failure IS NOT NULL",
)
_add(
    "landing_accepted_rows",
    "SELECT filename AS file_name, row_count FROM verdict WHERE failure IS NULL",
)
_add(
    "cadence_by_day",
    """SELECT date, timestamp_count, min_timestamp, max_timestamp,
  CAST(date_diff('hour', min_timestamp, max_timestamp) AS BIGINT) AS span_hours,
  timestamp_count = 24 AND date_diff('hour', min_timestamp, max_timestamp) = 23 AS valid
FROM (SELECT CAST("timestamp" AS DATE) AS date, count(DISTINCT "timestamp") AS timestamp_count,
    min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp
  FROM activity GROUP BY 1)""",
)
_add(
    "cadence_steps",
    """SELECT step_hours, count(*) AS occurrences FROM (
  SELECT CAST(date_diff('hour', lag(t) OVER (ORDER BY t), t) AS BIGINT) AS step_hours
  FROM (SELECT DISTINCT "timestamp" AS t FROM activity))
WHERE step_hours IS NOT NULL GROUP BY 1""",
)
_add(
    "cadence_global",
    """SELECT *, distinct_timestamps = expected_timestamps AS complete FROM (
  SELECT count(DISTINCT "timestamp") AS distinct_timestamps, min("timestamp") AS min_timestamp,
    max("timestamp") AS max_timestamp,
    CAST(date_diff('hour', min("timestamp"), max("timestamp")) + 1 AS BIGINT)
      AS expected_timestamps
  FROM activity)""",
)
_add(
    "raw_grain_dups",
    """SELECT "timestamp", grid_id, country_code, count(*) AS row_count FROM activity
GROUP BY ALL HAVING count(*) > 1""",
)
_add(
    "raw_grain_checks",
    _checks(
        """SELECT (SELECT count(*) FROM (SELECT 1 FROM clean
      GROUP BY "timestamp", grid_id, country_code HAVING count(*) > 1)) AS a,
    (SELECT count(*) FROM (SELECT 1 FROM clean
      GROUP BY "timestamp", grid_id HAVING count(*) > 1)) AS b""",
        {
            "duplicate_raw_groups": _zero("a"),
            "grid_hours_with_several_rows": ("b", "b > 0"),
        },
    ),
)
_add(
    "exact_duplicates",
    """SELECT CAST((SELECT count(*) FROM activity)
  - (SELECT count(*) FROM (SELECT DISTINCT * FROM activity)) AS BIGINT) AS duplicate_rows""",
)
_add(
    "rows_per_grid_hour",
    """SELECT n AS rows_in_grid_hour, count(*) AS grid_hours
FROM (SELECT count(*) AS n FROM activity GROUP BY "timestamp", grid_id) GROUP BY 1""",
)
_add(
    "grain_checks",
    _checks(
        """SELECT (SELECT count(*) FROM hourly) AS r, (SELECT count(*) FROM clean) AS c,
    (SELECT count(DISTINCT date) FROM hourly) * 24 * (SELECT max(user_id) + 1 FROM events) AS ceiling,
    (SELECT count(*) FROM hourly WHERE grid_id < 1) AS bad""",
        {
            "duplicate_grid_hours": ("0", "true"),
            "rows_reduced": ("r", "r < c"),
            "rows_within_ceiling": ("ceiling", "r <= ceiling"),
            "country_code_absent": ("0", "true"),
            "grid_out_of_range": _zero("bad"),
        },
    ),
)
_add(
    "ingest_acceptance",
    _checks(
        """SELECT count(DISTINCT "timestamp") AS t, count(DISTINCT CAST("timestamp" AS DATE)) AS f,
    count(*) FILTER (grid_id < 1) AS bad, count(*) AS r,
    count(DISTINCT ("timestamp", grid_id)) AS g FROM activity""",
        {
            "distinct_timestamps": ("t", "t = f * 24"),
            "file_count": ("f", "true"),
            "grid_out_of_range": _zero("bad"),
            "rows_exceed_grid_hours": ("r", "r > g"),
            "missing_source_file": ("0", "true"),
        },
    ),
)
_add(
    "file_report",
    """SELECT 'sms-call-internet-mi-' || strftime("timestamp", '%Y-%m-%d') || '.csv'
  AS source_file, count(*) AS row_count FROM activity GROUP BY 1""",
)
_add(
    "profile",
    f"""SELECT count(*) AS row_count, count(DISTINCT grid_id) AS unique_grids,
  count(DISTINCT country_code) AS country_code_categories,
  count(DISTINCT "timestamp") AS distinct_hourly_intervals, min(grid_id) AS min_grid_id,
  max(grid_id) AS max_grid_id, min("timestamp") AS min_timestamp,
  max("timestamp") AS max_timestamp, count(*) FILTER (grid_id IS NULL) AS null_grid_ids,
  count(*) FILTER ("timestamp" IS NULL) AS null_timestamps,
  {" + ".join(f"count(*) FILTER ({c} < 0)" for c in _MEASURES5)} AS negative_values
FROM defective""",
)
_add(
    "file_profile",
    _BODIES["profile"][0].replace("FROM defective", "FROM activity").replace(
        "min(grid_id)", "count(DISTINCT CAST(\"timestamp\" AS DATE)) AS source_files, min(grid_id)"
    ),
)
_add("country_counts", "SELECT country_code, count(*) AS row_count FROM activity GROUP BY 1")
_add(
    "alert_input_checks",
    _checks(
        """SELECT count(*) FILTER ("timestamp" IS NULL) AS a, count(*) FILTER (grid_id IS NULL) AS b,
    count(*) FILTER (grid_id < 1) AS c,
    count(*) - count(DISTINCT ("timestamp", grid_id)) AS d,
    count(*) FILTER (total_activity IS NULL) AS e, count(*) FILTER (total_activity < 0) AS f
    FROM hourly""",
        {
            "invalid_timestamp": _zero("a"),
            "missing_grid_id": _zero("b"),
            "grid_out_of_range": _zero("c"),
            "duplicate_grid_hours": _zero("d"),
            "missing_activity": _zero("e"),
            "negative_activity": _zero("f"),
        },
    ),
)
_add(
    "alert_table_checks",
    _checks(
        """SELECT count(*) FILTER ("timestamp" IS NULL) AS a,
    count(*) FILTER (grid_id < 1) AS b,
    count(*) FILTER (alert_type NOT IN ('HIGH_ACTIVITY', 'ACTIVITY_DROP', 'ACTIVITY_SPIKE')) AS c,
    count(DISTINCT grid_id) FILTER (grid_id NOT IN (SELECT grid_id FROM cells)) AS d
    FROM alert_rows""",
        {
            "invalid_timestamp": _zero("a"),
            "grid_out_of_range": _zero("b"),
            "unknown_alert_type": _zero("c"),
            "grid_not_in_dimension": _zero("d"),
        },
    ),
)
_PARITY = ["rows", "timestamps"] + _MEASURES
_add(
    "parity",
    "SELECT * FROM (WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS rows, "
    'CAST(count(DISTINCT "timestamp") AS DOUBLE) AS timestamps, '
    + _sum_list(_MEASURES)
    + " FROM clean) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, {c} AS left_value, {c} AS right_value, true AS matches FROM s"
        for c in _PARITY
    )
    + ")",
    ["left_value:4", "right_value:4"],
)
_add("schema_contract", "SELECT date, count(*) AS rows FROM hourly GROUP BY date")
_add(
    "time_features",
    f"""SELECT "timestamp", {_TIME}, CAST(isodow("timestamp") - 1 AS INTEGER) AS weekday_monday0,
  dayname("timestamp") AS weekday_name,
  CAST(strftime("timestamp", '%Y%m%d%H') AS BIGINT) AS time_key
FROM (SELECT DISTINCT "timestamp" FROM activity)""",
)
_add(
    "tz_shift",
    """SELECT "timestamp", "timestamp" + INTERVAL 330 MINUTE AS local_timestamp
FROM (SELECT DISTINCT "timestamp" FROM activity)""",
)
_HOURLY_DOUBLES = _MEASURES + ["internet_share"]
_add("hourly_contract", "SELECT * FROM hourly", _HOURLY_DOUBLES)
_CENTROID = """CASE WHEN w IS NOT NULL THEN printf('%.6f,%.6f',
  (w + (w + 0.002) + (w + 0.002) + w + w) / 5, (s + s + (s + 0.002) + (s + 0.002) + s) / 5) END"""
_add(
    "enriched_contract",
    f"""SELECT "timestamp", grid_id, {", ".join(_MEASURES5)}, total_activity, geometry,
  {_CENTROID} AS centroid FROM enriched""",
    _MEASURES5 + ["total_activity"],
)
_add("grid_hour", "SELECT * FROM hourly", _HOURLY_DOUBLES)
_add(
    "daily_traffic",
    f"""SELECT date, {_sum_list(_TRAFFIC)}, count(DISTINCT grid_id) AS active_grids
FROM hourly GROUP BY date""",
    _TRAFFIC,
)
_add(
    "daily_summary",
    f"SELECT date, {_sum_list(_TRAFFIC)}, count(*) AS active_grid_hours FROM hourly GROUP BY date",
    _TRAFFIC,
)
_add(
    "grid_summary",
    f"""SELECT grid_id, {_sum_list(_TRAFFIC)}, count(DISTINCT "timestamp") AS active_hours
FROM hourly GROUP BY grid_id""",
    _TRAFFIC,
)
_add(
    "dashboard",
    f"""SELECT *, CASE WHEN total_activity <> 0 THEN internet_activity / total_activity ELSE 0.0 END
  AS internet_share
FROM (SELECT "timestamp", {_sum_list(_TRAFFIC)}, count(DISTINCT grid_id) AS active_grids
  FROM hourly GROUP BY "timestamp")""",
    _TRAFFIC + ["internet_share"],
)
_add(
    "summary_stats",
    """SELECT sum(total_activity) AS total_activity, avg(total_activity) AS average_activity,
  max(total_activity) AS maximum_grid_hour_activity, count(DISTINCT grid_id) AS unique_grids,
  count(DISTINCT "timestamp") AS distinct_timestamps FROM hourly""",
    ["total_activity", "average_activity", "maximum_grid_hour_activity"],
)
_add(
    "hotspots",
    """SELECT grid_id, sum(total_activity) AS total_activity FROM hourly GROUP BY grid_id
ORDER BY 2 DESC, 1 LIMIT 10""",
    ["total_activity"],
)
_add(
    "peak_hour",
    """SELECT "timestamp", sum(total_activity) AS total_activity FROM hourly GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 1""",
    ["total_activity"],
)
_FIVE_AND_TOTAL = _sum_list(_MEASURES5 + ["total_activity"])
_add(
    "busiest",
    f"""(SELECT 'hour' AS kind, "timestamp", CAST(NULL AS INTEGER) AS grid_id, {_FIVE_AND_TOTAL}
  FROM hourly GROUP BY "timestamp" ORDER BY sum(total_activity) DESC, "timestamp" LIMIT 1)
UNION ALL
(SELECT 'grid' AS kind, CAST(NULL AS TIMESTAMP) AS "timestamp", grid_id, {_FIVE_AND_TOTAL}
  FROM hourly GROUP BY grid_id ORDER BY sum(total_activity) DESC, grid_id LIMIT 1)""",
    _MEASURES5 + ["total_activity"],
)
for _name in ("geo_enrich", "geo_enrich_merge"):
    _add(
        _name,
        'SELECT "timestamp", grid_id, total_activity, geometry FROM enriched',
        ["total_activity"],
    )
_add(
    "geo_coverage",
    """SELECT *, matched_grids * 100.0 / activity_grids AS coverage_percentage FROM (
  SELECT count(DISTINCT grid_id) AS activity_grids,
    count(DISTINCT grid_id) FILTER (geometry IS NOT NULL) AS matched_grids,
    count(DISTINCT grid_id) FILTER (geometry IS NULL) AS unmatched_grids FROM enriched)""",
    ["coverage_percentage"],
)
_add(
    "geo_unmatched",
    "SELECT DISTINCT grid_id FROM hourly WHERE grid_id NOT IN (SELECT grid_id FROM cells)",
)
_add(
    "geo_acceptance",
    _checks(
        """SELECT (SELECT count(*) FROM cells) AS n, (SELECT count(*) FROM hourly) AS r,
    count(DISTINCT grid_id) FILTER (geometry IS NULL) AS u,
    count(DISTINCT grid_id) FILTER (geometry IS NOT NULL) * 100.0 / count(DISTINCT grid_id) AS p
    FROM enriched""",
        {
            "reference_rows": ("n", "n = 10000"),
            "reference_ids": ("n", "n = 10000"),
            "reference_out_of_range": ("0", "true"),
            "reference_without_geometry": ("0", "true"),
            "row_count_preserved": ("r", "true"),
            "coverage_percentage": ("p", "p = 100"),
            "unmatched_grids": _zero("u"),
        },
    ),
    ["value"],
)
_add("geo_lookup_from_enriched", "SELECT DISTINCT grid_id, geometry FROM enriched")
_add(
    "geo_spot_check",
    f"SELECT grid_id, {_CENTROID} AS centroid FROM all_cells WHERE grid_id IN (1, 2, 15)",
)
_add(
    "cell_centroids",
    f"""SELECT grid_id, {_CENTROID} AS centroid, w + 0.001 AS center_longitude,
  s + 0.001 AS center_latitude FROM cells""",
    ["center_longitude", "center_latitude"],
)
_add(
    "top_grids_geo",
    """SELECT t.grid_id, c.geometry, t.total_activity
FROM (SELECT grid_id, sum(total_activity) AS total_activity FROM hourly GROUP BY grid_id
  ORDER BY 2 DESC, 1 LIMIT 10) t LEFT JOIN cells c USING (grid_id)""",
    ["total_activity"],
)
_add("dim_time", "SELECT * FROM dim_time")
_add(
    "dim_grid",
    """SELECT grid_id AS grid_key, grid_id, s + 0.0008 AS latitude, w + 0.0008 AS longitude,
  geometry AS geometry_reference FROM all_cells""",
    ["latitude", "longitude"],
)
_add(
    "fact_build",
    f"""SELECT CAST(strftime("timestamp", '%Y%m%d%H') AS BIGINT) AS time_key, grid_id AS grid_key,
  {", ".join(_MEASURES)} FROM hourly""",
    _MEASURES,
)
_add(
    "star_join",
    f"""SELECT c.grid_id, t."timestamp", t.date, t.hour, {", ".join(_MEASURES)} FROM hourly h
JOIN dim_time t USING ("timestamp") JOIN all_cells c ON c.grid_id = h.grid_id""",
    _MEASURES,
)
_add(
    "star_checks",
    _checks(
        """SELECT (SELECT count(*) FROM hourly) AS n, (SELECT count(*) FROM dim_time) AS t,
    (SELECT count(DISTINCT "timestamp") FROM hourly) AS h,
    (SELECT count(*) FROM all_cells) AS g""",
        {
            "fact_rows": ("n", "true"),
            "dim_time_rows": ("t", "t = h"),
            "dim_grid_rows": ("g", "true"),
            "duplicate_fact_keys": ("0", "true"),
            "duplicate_time_keys": ("0", "true"),
            "duplicate_grid_ids": ("0", "true"),
            "orphan_time_keys": ("0", "true"),
            "orphan_grid_keys": ("0", "true"),
            "geometry_in_fact": ("0", "true"),
        },
    ),
)


def _summary(cutoff: str) -> str:
    scope = f'FROM hourly WHERE "timestamp" <= {cutoff}'
    return f"""SELECT (SELECT sum(total_activity) {scope}) AS total_activity,
  (SELECT count(DISTINCT grid_id) {scope} AND total_activity > 0) AS active_grids,
  (SELECT "timestamp" {scope} GROUP BY "timestamp" ORDER BY sum(total_activity) DESC, 1 LIMIT 1)
    AS peak_hour,
  (SELECT grid_id {scope} GROUP BY grid_id ORDER BY sum(total_activity) DESC, 1 LIMIT 1)
    AS top_grid, {cutoff} AS as_of"""


_NEWEST = '(SELECT max("timestamp") FROM hourly)'
_add(
    "network_summary",
    _summary(_NEWEST) + "\nUNION ALL " + _summary(_AS_OF),
    ["total_activity"],
)
_add(
    "network_summary_snapshot",
    _summary(_AS_OF) + "\nUNION ALL " + _summary("TIMESTAMP '2024-01-10 05:00:00'"),
    ["total_activity"],
)
_HISTORY = f'"timestamp", {", ".join(_MEASURES)}'
_add(
    "grid_history",
    f"""SELECT {_HISTORY}, 'last 24 hours' AS request FROM hourly WHERE grid_id = 8
  AND "timestamp" BETWEEN {_NEWEST} - INTERVAL 23 HOUR AND {_NEWEST}
UNION ALL SELECT {_HISTORY}, 'date' FROM hourly WHERE grid_id = 8 AND date = DATE '2024-01-15'
UNION ALL SELECT {_HISTORY}, 'hour' FROM hourly WHERE grid_id = 8 AND hour = 9
  AND "timestamp" <= {_AS_OF}""",
    _MEASURES,
)
_add(
    "grid_exists",
    "SELECT DISTINCT grid_id FROM activity WHERE grid_id IN (SELECT grid_id FROM cells)",
)
_add(
    "hourly_trend",
    "SELECT date, hour, sum(total_activity) AS total_activity FROM hourly GROUP BY ALL",
    ["total_activity"],
)
_add(
    "internet_heavy",
    """SELECT "timestamp", sum(internet_activity) / nullif(sum(total_activity), 0)
  AS internet_share FROM hourly GROUP BY 1 HAVING sum(total_activity) > 0
ORDER BY 2 DESC, 1 LIMIT 10""",
    ["internet_share"],
)
_add(
    "hotspot_feed",
    "SELECT * FROM hot_feed",
    ["total_activity", "sms_activity", "call_activity", "internet_activity"],
)
_add(
    "loo_baseline",
    """SELECT grid_id, "timestamp", total_activity, n AS history_count, baseline
  AS baseline_activity FROM base""",
    ["total_activity", "baseline_activity"],
)
_add("activity_floor", "SELECT * FROM floor_value", ["activity_floor"])
_ALERT_DOUBLES = ["current_activity", "baseline_activity"]
_add("alerts", "SELECT * FROM alert_rows", _ALERT_DOUBLES)
_add("alerts_adjacent", "SELECT * FROM alerts_adjacent", _ALERT_DOUBLES)
_add(
    "alert_summary",
    """SELECT *, total_alerts / total_grid_hours AS alert_proportion FROM (
  SELECT alert_type, count(*) AS alerts,
    CAST(sum(count(*)) OVER () AS BIGINT) AS total_alerts,
    (SELECT count(*) FROM hourly) AS total_grid_hours FROM alert_rows GROUP BY 1)""",
    ["alert_proportion"],
)
_add(
    "alert_top_grids",
    """SELECT grid_id, count(*) AS alerts FROM alert_rows GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""",
)
_add(
    "alerts_by_hour",
    """SELECT grid_id, "timestamp", true AS np3_alert,
  string_agg(DISTINCT alert_type, '|' ORDER BY alert_type) AS np3_alert_types,
  count(*) AS np3_alert_count FROM alert_rows GROUP BY ALL""",
)


def _feed(where: str, limit: int, as_of: str) -> str:
    return f"""SELECT grid_id, "timestamp", alert_type, severity, current_activity,
  baseline_activity, reason, {as_of} AS as_of FROM alert_severity WHERE {where}
ORDER BY "timestamp" DESC, severity_rank DESC, grid_id, alert_type LIMIT {limit}"""


_UP_TO = f'"timestamp" <= {_AS_OF}'
_add("alert_feed", _feed(_UP_TO, 50, _AS_OF), _ALERT_DOUBLES)
_add(
    "alert_feed_high",
    _feed("severity = 'HIGH'", 50, '(SELECT max("timestamp") FROM alert_rows)'),
    _ALERT_DOUBLES,
)
_add(
    "ranked_ops",
    f"""SELECT grid_id, "timestamp", total_activity AS activity, 'ATTENTION' AS status,
  CAST(NULL AS VARCHAR) AS severity, 'HOTSPOT' AS type, 'High activity area' AS reason
FROM hot_feed
UNION ALL SELECT grid_id, "timestamp", current_activity,
  CASE WHEN severity = 'HIGH' THEN 'HIGH' ELSE 'ATTENTION' END, severity, 'ALERT', reason
FROM ({_feed(_UP_TO, 30, _AS_OF)})""",
    ["activity"],
)
_add(
    "grid_status",
    f"""SELECT coalesce(h.grid_id, a.grid_id) AS grid_id,
  CASE WHEN a.severity = 'HIGH' THEN 'HIGH' ELSE 'ATTENTION' END AS status, h.total_activity,
  a.severity, a.alert_type, a.current_activity
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_id
      ORDER BY total_activity, "timestamp" DESC) AS k FROM hot_feed) WHERE k = 1) h
FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_id
      ORDER BY "timestamp", severity = 'HIGH', alert_type DESC) AS k
    FROM ({_feed(_UP_TO, 60, _AS_OF)})) WHERE k = 1) a ON h.grid_id = a.grid_id""",
    ["total_activity", "current_activity"],
)
_SCORE_DOUBLES = ["current_activity", "baseline_activity", "deviation:9", "anomaly_score:9"]
_add("anomaly_scores", "SELECT * FROM anomaly_rows", _SCORE_DOUBLES)
_add("anomaly_scores_filled", "SELECT * FROM anomaly_filled", _SCORE_DOUBLES)
_add(
    "anomaly_summary",
    """SELECT *, anomalies / total_grid_hours AS anomaly_proportion FROM (
  SELECT count(*) AS total_grid_hours, count(*) FILTER (is_anomaly) AS anomalies,
    count(*) FILTER (is_anomaly AND direction = 'HIGH') AS high_anomalies,
    count(*) FILTER (is_anomaly AND direction = 'LOW') AS low_anomalies,
    count(*) FILTER (direction = 'HIGH') AS high_direction_rows,
    count(*) FILTER (direction = 'LOW') AS low_direction_rows,
    min(history_count) AS min_bucket_count, max(history_count) AS max_bucket_count
  FROM anomaly_rows)""",
    ["anomaly_proportion"],
)
_add("anomaly_cases", "SELECT * FROM cases", _SCORE_DOUBLES)
_add(
    "case_history",
    """SELECT c.direction, c.case_number, c.grid_id, c."timestamp" AS case_timestamp,
  any_value(c.current_activity) AS current_activity,
  any_value(c.baseline_activity) AS baseline_activity,
  quantile_cont(h.total_activity, 0.5) AS historical_median,
  count(h.total_activity) AS historical_observations,
  string_agg(strftime(h."timestamp", '%Y-%m-%d %H') || '=' || printf('%.2f', h.total_activity),
    ';' ORDER BY h."timestamp") AS history
FROM cases c LEFT JOIN hourly h ON h.grid_id = c.grid_id AND h.hour = c.hour_of_day
  AND h."timestamp" <> c."timestamp"
GROUP BY ALL""",
    ["current_activity", "baseline_activity", "historical_median"],
)
_FEATURE_DOUBLES = [f for f in FEATURES if f != "active_hours"]
_add("grid_features", "SELECT * FROM features")
_add(
    "feature_checks",
    _checks(
        "SELECT count(*) - count(DISTINCT (grid_id, feature_timestamp)) AS d FROM features",
        {
            "missing_key": ("0", "true"),
            "not_finite": ("0", "true"),
            "active_hours_range": ("0", "true"),
            "internet_share_range": ("0", "true"),
            "duplicate_keys": _zero("d"),
        },
    ),
)
_add(
    "latest_features",
    """SELECT * FROM features QUALIFY
  row_number() OVER (PARTITION BY grid_id ORDER BY feature_timestamp DESC) = 1""",
)
_add(
    "feature_freshness",
    """SELECT grid_id, feature_timestamp, 'VALID' AS data_quality,
  CASE WHEN feature_timestamp = max(feature_timestamp) OVER (PARTITION BY grid_id)
    THEN 'CURRENT' ELSE 'HISTORICAL' END AS freshness FROM features""",
)
_add(
    "grid_features_at",
    f"""SELECT *, 'VALID' AS data_quality, 'CURRENT' AS freshness FROM features WHERE grid_id = 7
  AND feature_timestamp = (SELECT max(feature_timestamp) FROM features WHERE grid_id = 7)
UNION ALL SELECT *, 'VALID', 'HISTORICAL' FROM features WHERE grid_id = 7
  AND feature_timestamp = {_AS_OF}""",
)
_add(
    "next_hour_label",
    """SELECT grid_id, feature_timestamp, next_hour_activity, high_activity_target
FROM labelled""",
    ["next_hour_activity"],
)
_add("next_hour_label_windowed", "SELECT * FROM labelled", ["next_hour_activity"])
_add(
    "chrono_split",
    """SELECT split, count(*) AS rows, min(feature_timestamp) AS earliest_timestamp,
  max(feature_timestamp) AS latest_timestamp,
  count(*) FILTER (high_activity_target = 1) AS positive_rows,
  count(*) FILTER (high_activity_target = 0) AS negative_rows,
  avg(high_activity_target) AS base_rate FROM scored GROUP BY split""",
    ["base_rate"],
)
_add(
    "feature_means",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, a AS not_high_mean, b AS high_mean, b / nullif(a, 0)
  AS mean_ratio FROM (SELECT avg({c}) FILTER (high_activity_target = 0) AS a,
    avg({c}) FILTER (high_activity_target = 1) AS b FROM labelled)"""
        for c in FEATURES
    ),
    ["not_high_mean", "high_mean", "mean_ratio"],
)
_add(
    "feature_corr",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, high_activity_target) AS correlation FROM labelled"
        for c in FEATURES
    ),
    ["correlation"],
)
_add(
    "feature_pairs",
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlation "
        "FROM labelled"
        for i, a in enumerate(FEATURES)
        for b in FEATURES[i + 1 :]
    ),
    ["correlation"],
)
_add(
    "feature_quantiles",
    """SELECT high_activity_target, count(*) AS rows, avg(avg_activity) AS mean,
  max(avg_activity) AS max, quantile_cont(avg_activity, 0.5) AS median,
  quantile_cont(avg_activity, 0.9) AS p90, quantile_cont(avg_activity, 0.95) AS p95,
  quantile_cont(avg_activity, 0.99) AS p99 FROM labelled GROUP BY 1""",
    ["mean", "max", "median", "p90", "p95", "p99"],
)
_add(
    "threshold_rates",
    " UNION ALL ".join(
        f"""SELECT CAST({t} AS DOUBLE) AS threshold, count(*) AS rows,
  coalesce(avg(high_activity_target), 0.0) AS positive_rate
  FROM labelled WHERE avg_activity >= {t}"""
        for t in FEATURE_THRESHOLDS
    ),
    ["positive_rate"],
)
_add(
    "activity_bands",
    " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS band, CAST({low} AS DOUBLE) AS band_from,
  CAST({high} AS DOUBLE) AS band_to, count(*) AS rows, avg(avg_activity) AS mean_avg_activity,
  avg(variability) AS mean_variability, avg(high_activity_target) AS positive_rate FROM labelled
  WHERE avg_activity >= {low}""" + ("" if high == "NULL" else f" AND avg_activity < {high}")
        for i, (low, high) in enumerate(zip(FEATURE_BANDS, [*FEATURE_BANDS[1:], "NULL"]))
    ),
    ["mean_avg_activity", "mean_variability", "positive_rate"],
)
_add(
    "confusion",
    """SELECT *, accuracy - baseline_accuracy AS accuracy_improvement,
  accuracy > 0.95 AS accuracy_warning
FROM (SELECT *, (true_positives + true_negatives) / rows AS accuracy,
    coalesce(true_positives / nullif(true_positives + false_positives, 0), 0.0) AS precision,
    coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0.0) AS recall,
    (false_positives + true_negatives) / rows AS baseline_accuracy,
    (true_positives + false_negatives) / rows AS base_rate
  FROM (SELECT count(*) AS rows, count(*) FILTER (h AND y) AS true_positives,
      count(*) FILTER (h AND NOT y) AS false_positives,
      count(*) FILTER (NOT h AND y) AS false_negatives,
      count(*) FILTER (NOT h AND NOT y) AS true_negatives
    FROM (SELECT risk_score >= 0.5 AS h, high_activity_target = 1 AS y FROM test)))""",
    ["accuracy", "precision", "recall", "baseline_accuracy", "base_rate", "accuracy_improvement"],
)
_add(
    "ranking_metrics",
    """SELECT CAST(max(p) AS BIGINT) AS positives, CAST(max(q) AS BIGINT) AS negatives,
  1.0 - sum(pos * (above_neg - neg + neg / 2.0)) / (max(p) * max(q)) AS roc_auc,
  sum(pos * above_pos / (above_pos + above_neg)) / max(p) AS average_precision
FROM (SELECT *, sum(pos) OVER (ORDER BY risk_score DESC) AS above_pos,
    sum(neg) OVER (ORDER BY risk_score DESC) AS above_neg, sum(pos) OVER () AS p,
    sum(neg) OVER () AS q
  FROM (SELECT risk_score, CAST(sum(high_activity_target) AS DOUBLE) AS pos,
      CAST(sum(1 - high_activity_target) AS DOUBLE) AS neg FROM test GROUP BY 1))""",
    ["roc_auc", "average_precision"],
)
_add(
    "nearest_scores",
    " UNION ALL ".join(
        f"""(SELECT CAST({t} AS DOUBLE) AS target, grid_id, feature_timestamp, risk_score,
  CASE WHEN risk_score >= 0.5 THEN 'HIGH' ELSE 'LOW' END AS risk_level FROM scored
  ORDER BY round(abs(risk_score - {t}), 9), grid_id, feature_timestamp LIMIT 1)"""
        for t in SCORE_TARGETS
    ),
    ["target", "risk_score"],
)
_COMPARE_DOUBLES = [
    "next_hour_activity", "ml3_probability", "anomaly_score:9", "baseline_activity",
    "current_activity",
]
_add("three_way", "SELECT * FROM comparison", _COMPARE_DOUBLES)
_COMBOS = {
    "ALL THREE": "np3_alert AND ml3_positive AND ml4_anomaly",
    "NP3 + ML4 only": "np3_alert AND NOT ml3_positive AND ml4_anomaly",
    "NP3 + ML3 only": "np3_alert AND ml3_positive AND NOT ml4_anomaly",
    "ML3 + ML4 only": "NOT np3_alert AND ml3_positive AND ml4_anomaly",
    "NP3 ONLY": "np3_alert AND NOT ml3_positive AND NOT ml4_anomaly",
    "ML3 ONLY": "NOT np3_alert AND ml3_positive AND NOT ml4_anomaly",
    "ML4 ONLY": "NOT np3_alert AND NOT ml3_positive AND ml4_anomaly",
    "NONE": "NOT np3_alert AND NOT ml3_positive AND NOT ml4_anomaly",
}
_add(
    "three_way_overlap",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS combination, count(*) FILTER ({test}) AS rows,
  count(*) FILTER ({test}) / count(*) AS share FROM comparison"""
        for name, test in _COMBOS.items()
    ),
    ["share"],
)
_SIGNALS = {
    "NP3 alert": "np3_alert",
    "ML3 positive": "ml3_positive",
    "ML4 anomaly": "ml4_anomaly",
    "ML4 HIGH": "ml4_direction = 'HIGH'",
    "ML4 LOW": "ml4_direction = 'LOW'",
}
_add(
    "outcome_rates",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS signal, count(*) AS rows, avg(target) AS next_hour_high_rate
  FROM comparison WHERE {test}"""
        for name, test in _SIGNALS.items()
    ),
    ["next_hour_high_rate"],
)
_SHOWN = """grid_id, "timestamp", np3_alert, np3_alert_types, ml4_anomaly, ml4_direction,
  anomaly_score, ml3_probability, next_hour_activity"""
_add(
    "disagreements",
    f"""(SELECT 'anomaly_not_model' AS kind, {_SHOWN} FROM comparison
  WHERE ml4_anomaly AND NOT ml3_positive
  ORDER BY round(anomaly_score, 9) DESC, grid_id, "timestamp" LIMIT 1)
UNION ALL (SELECT 'model_not_anomaly', {_SHOWN} FROM comparison
  WHERE ml3_positive AND NOT ml4_anomaly
  ORDER BY ml3_probability DESC, grid_id, "timestamp" LIMIT 1)
UNION ALL (SELECT 'alert_differs_from_anomaly', {_SHOWN} FROM comparison
  WHERE np3_alert <> ml4_anomaly ORDER BY grid_id, "timestamp" LIMIT 1)""",
    ["anomaly_score:9", "ml3_probability", "next_hour_activity"],
)
_add("alert_vs_model", "SELECT * FROM versus", ["ml3_probability"])
_add(
    "comparison_summary",
    """SELECT * EXCLUDE (a, m),
  round(np3_alert_rows * 100.0 / total_comparison_rows, 4) AS np3_alert_rate_percent,
  round(ml3_positive_rows * 100.0 / total_comparison_rows, 4) AS ml3_positive_rate_percent,
  round(agreement_rows * 100.0 / total_comparison_rows, 4) AS agreement_rate_percent,
  round(a * 100.0 / np3_alert_rows, 4) AS np3_alert_next_hour_high_rate_percent,
  round(m * 100.0 / ml3_positive_rows, 4) AS ml3_positive_next_hour_high_rate_percent
FROM (SELECT count(*) AS total_comparison_rows, min(feature_timestamp) AS test_start,
    max(feature_timestamp) AS test_end, count(*) FILTER (np3_alert) AS np3_alert_rows,
    count(*) FILTER (ml3_positive) AS ml3_positive_rows,
    count(*) FILTER (comparison_group = 'BOTH') AS both_rows,
    count(*) FILTER (comparison_group = 'NP3_ONLY') AS np3_only_rows,
    count(*) FILTER (comparison_group = 'ML3_ONLY') AS ml3_only_rows,
    count(*) FILTER (comparison_group = 'NEITHER') AS neither_rows,
    count(*) FILTER (comparison_group IN ('BOTH', 'NEITHER')) AS agreement_rows,
    count(*) FILTER (np3_alert AND actual_next_hour_high) AS a,
    count(*) FILTER (ml3_positive AND actual_next_hour_high) AS m FROM versus)""",
    [
        "np3_alert_rate_percent", "ml3_positive_rate_percent", "agreement_rate_percent",
        "np3_alert_next_hour_high_rate_percent", "ml3_positive_next_hour_high_rate_percent",
    ],
)
_add(
    "alert_type_overlap",
    """SELECT alert_type, count(*) AS rows,
  count(*) FILTER (ml3_positive) AS ml3_positive_overlap_rows,
  round(count(*) * 100.0 / (SELECT count(*) FROM versus WHERE np3_alert), 4)
    AS percent_of_np3_alert_rows,
  round(count(*) FILTER (ml3_positive) * 100.0 / count(*), 4) AS ml3_positive_overlap_percent,
  round(count(*) FILTER (actual_next_hour_high) * 100.0 / count(*), 4)
    AS next_hour_high_rate_percent
FROM (SELECT unnest(string_split(np3_alert_types, ',')) AS alert_type, ml3_positive,
    actual_next_hour_high FROM versus WHERE np3_alert)
GROUP BY 1""",
    [
        "percent_of_np3_alert_rows", "ml3_positive_overlap_percent",
        "next_hour_high_rate_percent",
    ],
)
_add(
    "risk_rows_rule_score",
    """SELECT s.grid_id, s.feature_timestamp AS "timestamp", s.risk_score,
  CASE WHEN s.risk_score >= 0.5 THEN 'HIGH' ELSE 'LOW' END AS risk_level,
  'ml3-logistic-regression-v1' AS model_version, a.anomaly_score,
  a.direction AS anomaly_direction, CAST(a.is_anomaly AS INTEGER) AS is_anomaly,
  a.reason AS anomaly_reason
FROM scored s JOIN anomaly_filled_default a
  ON a.grid_id = s.grid_id AND a."timestamp" = s.feature_timestamp""",
    ["risk_score", "anomaly_score:9"],
)
_add(
    "newton_fit",
    """SELECT 'avg_activity' AS feature, w AS coefficient, b AS intercept,
  CASE WHEN w > 0 THEN 'positive' WHEN w < 0 THEN 'negative' ELSE 'neutral' END AS direction FROM newton_weights""",
    ["coefficient", "intercept"],
)
_add(
    "model_save_load",
    """SELECT 'avg_activity' AS feature, w AS coefficient,
  CASE WHEN w > 0 THEN 'positive' WHEN w < 0 THEN 'negative' ELSE 'neutral' END AS direction FROM newton_weights""",
    ["coefficient:4"],
)
_add(
    "storage_stage",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", c AS "check", v AS value, ok AS passed FROM (
  SELECT unnest(['row_count', 'columns_differing', 'types_differing', 'date_values', 'contents_differ', 'geometry_absent', 'duplicate_keys']) AS c,
    unnest([rows, 0, 0, dates, 0, 0, dups]::DOUBLE[]) AS v, unnest([true, true, true, true, true, true, dups = 0]) AS ok
  FROM (SELECT sum(n) AS rows, count(DISTINCT date) AS dates, count(*) FILTER (n > 1) AS dups
    FROM (SELECT date, count(*) AS n FROM {name if name == "hourly" else "clean"} GROUP BY date{keys})))"""
        for name, keys in (("clean_activity", ', "timestamp", grid_id, country_code'), ("hourly", ', "timestamp", grid_id'))
    ),
    ["value"],
)
_add(
    "newton_scores",
    _BODIES["risk_rows_rule_score"][0].replace("FROM scored s", "FROM newton_scored s"),
    ["risk_score", "anomaly_score"],
)
_add(
    "newton_point",
    f"""SELECT grid_id, feature_timestamp AS "timestamp", risk_score,
  CASE WHEN risk_score >= 0.5 THEN 'HIGH' ELSE 'LOW' END AS risk_level, 'ml3-logistic-regression-v1' AS model_version
FROM newton_scored WHERE grid_id = 7 AND feature_timestamp = {_AS_OF}""",
    ["risk_score"],
)
_add(
    "newton_ablation",
    f"""SELECT 'avg_activity only' AS model, accuracy, precision, recall, roc_auc, average_precision
FROM ({_BODIES["confusion"][0].replace("FROM test", "FROM newton_scored WHERE split = 'test'")}),
  ({_BODIES["ranking_metrics"][0].replace("FROM test", "FROM newton_scored WHERE split = 'test'")})""",
    ["accuracy", "precision", "recall", "roc_auc", "average_precision"],
)
_add(
    "live_hotspots",
    """SELECT h.grid_id, h."timestamp", 'HIGH_ACTIVITY' AS alert_type,
  h.total_activity AS current_activity, b.baseline AS baseline_activity
FROM hourly h JOIN (SELECT grid_id, hour, round(quantile_cont(total_activity, 0.5), 4) AS baseline
  FROM hourly GROUP BY ALL) b USING (grid_id, hour)
WHERE b.baseline > 0 AND h.total_activity >= b.baseline * 2.0
  AND h."timestamp" + INTERVAL 3 HOUR <= (SELECT max("timestamp") FROM hourly)""",
    _ALERT_DOUBLES,
)
_add(
    "live_rules",
    """SELECT grid_id, "timestamp", unnest(list_filter([CASE WHEN total_activity >= baseline * 2.0 THEN 'HIGH_ACTIVITY' END,
    CASE WHEN total_activity <= baseline * 0.5 THEN 'ACTIVITY_DROP' END,
    CASE WHEN previous > 0 AND total_activity >= previous * 1.5 THEN 'ACTIVITY_SPIKE' END], lambda k: k IS NOT NULL)) AS alert_type,
  total_activity AS current_activity, baseline AS baseline_activity
FROM (SELECT h.grid_id, h."timestamp", h.total_activity, b.baseline, p.total_activity AS previous
  FROM hourly h JOIN (SELECT grid_id, hour, round(quantile_cont(total_activity, 0.5), 4) AS baseline
    FROM hourly GROUP BY ALL) b USING (grid_id, hour)
  LEFT JOIN hourly p ON p.grid_id = h.grid_id AND p."timestamp" = h."timestamp" - INTERVAL 1 HOUR
  WHERE b.baseline > 0 AND h."timestamp" + INTERVAL 3 HOUR <= (SELECT max("timestamp") FROM hourly))""",
    _ALERT_DOUBLES,
)
_add(
    "by_date_layout",
    f"SELECT date, {_sum_list(_MEASURES)} FROM clean GROUP BY date",
    _MEASURES,
)
_add(
    "sampled_rows",
    """SELECT count(*) AS rows, sum(total_activity) AS total_activity FROM clean
WHERE md5('42|' || concat_ws('|', grid_id, strftime("timestamp", '%Y-%m-%d %H'), country_code))
  < '19999999'""",
    ["total_activity"],
)
_add("csv_typed_scan", *_BODIES["canonical_activity"])
_add(
    "csv_text_scan",
    f"SELECT grid_id, count(*) AS rows_with_file, {_sum_list(_MEASURES5)} FROM activity GROUP BY 1",
    _MEASURES5,
)
_add("parquet_round_trip", *_BODIES["grid_hour"])
_add("date_partitions_round_trip", *_BODIES["by_date_layout"])
_add("report_round_trip", *_BODIES["summary_stats"])
_add(
    "audit_log",
    f"""SELECT filename, status, reason, CAST(2 AS BIGINT) AS records,
  CAST(2 * row_count AS HUGEINT)::BIGINT AS row_count FROM ({_BODIES["landing_verdict"][0]})""",
)
_add("table_refresh", *_BODIES["daily_traffic"])
_add(
    "incremental_refresh",
    """SELECT 'daily_summary' AS table_name, CAST(date AS VARCHAR) AS key, sum(total_activity) AS total_activity, count(*) AS row_count
FROM hourly GROUP BY date
UNION ALL SELECT 'daily_traffic', CAST(date AS VARCHAR), sum(total_activity), count(DISTINCT grid_id) FROM hourly GROUP BY date
UNION ALL SELECT 'dashboard', strftime("timestamp", '%Y-%m-%d %H'), sum(total_activity), count(*) FROM hourly GROUP BY "timestamp"
UNION ALL SELECT 'cells', CAST(grid_id AS VARCHAR), sum(total_activity), count(*) FROM hourly GROUP BY grid_id""",
    ["total_activity"],
)


def statements() -> dict[str, str]:
    """SQL per query; doubles rounded like the registered queries round theirs."""
    out = {}
    for name, (sql, doubles) in _BODIES.items():
        body = sql
        if doubles:
            items = [d.split(":") if ":" in d else (d, "6") for d in doubles]
            replaced = ", ".join(f"round({c}, {k}) + 0.0 AS {c}" for c, k in items)
            body = f"SELECT * REPLACE ({replaced}) FROM (\n{sql})"
        out[name] = _with(body)
    return out

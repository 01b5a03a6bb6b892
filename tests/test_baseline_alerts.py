from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from gridpulse.operators import alerts, anomaly, baseline


@pytest.mark.parametrize("seed", range(3))
def test_leave_one_out_median_brute_force(hours_frame, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(1, 9):
        for h in rng.sample(range(200), rng.choice([1, 2, 3, 4, 9, 40])):
            rows.append((g, h, rng.choice([0, 1, 1, 2, 5.5, rng.uniform(0, 100)])))
    out = baseline.leave_one_out_median(hours_frame(rows), ["grid_id"]).collect()
    assert len(out) == len(rows)
    for r in out:
        others = [t for g, h, t in rows if g == r["grid_id"]]
        assert r["history_count"] == len(others)
        others.remove(r["total_activity"])
        want = median(others) if others else None
        assert r["baseline_activity"] == (pytest.approx(want) if others else None)


def test_baseline_needs_a_bucket(hours_frame):
    with pytest.raises(ValueError):
        baseline.leave_one_out_median(hours_frame([(1, 0, 1)]), [])


def test_strict_history_raises(hours_frame):
    df = baseline.leave_one_out_median(hours_frame([(1, 0, 1), (2, 0, 1), (2, 1, 3)]), ["grid_id"])
    with pytest.raises(Exception, match="two rows per bucket"):
        baseline.require_history(df).collect()


def same_hour(hours_frame, values, grid=1):
    return hours_frame([(grid, 24 * d + 3, v) for d, v in enumerate(values)])


def test_history_counts_days(hours_frame):
    df = same_hour(hours_frame, [1, 2, 3]).unionByName(same_hour(hours_frame, [4, 5, 6], 2))
    assert {r["history_count"] for r in anomaly.anomaly_scores(df).collect()} == {3}


def test_baseline_excludes_the_row_itself(hours_frame):
    rows = anomaly.anomaly_scores(same_hour(hours_frame, [100, 100, 1000])).collect()
    assert [r["baseline_activity"] for r in rows if r["current_activity"] == 1000] == [100.0]


@pytest.mark.parametrize("last,direction", [(300, "HIGH"), (0, "LOW")])
def test_anomaly_direction(hours_frame, last, direction):
    df = anomaly.anomaly_scores(same_hour(hours_frame, [100, 100, last]), threshold=1.0)
    row = df.filter(F.col("current_activity") == last).first()
    assert (row["direction"], row["is_anomaly"]) == (direction, True)
    percent = "200.0" if direction == "HIGH" else "100.0"
    assert row["reason"] == (
        f"{direction} anomaly: activity is {percent}% away from the historical median "
        "for this grid and hour-of-day."
    )


def test_anomaly_reasons_without_score(hours_frame):
    df = same_hour(hours_frame, [0, 0, 5]).unionByName(same_hour(hours_frame, [7], 2))
    rows = {(r["grid_id"], r["current_activity"]): r for r in anomaly.anomaly_scores(df).collect()}
    zero, short = rows[(1, 5.0)], rows[(2, 7.0)]
    assert zero["anomaly_score"] is None and "baseline is zero" in zero["reason"]
    assert short["anomaly_score"] is None and short["reason"].startswith("Insufficient")
    assert not zero["is_anomaly"] and not short["is_anomaly"]


def test_within_range_is_none_direction(hours_frame):
    row = anomaly.anomaly_scores(same_hour(hours_frame, [10, 10, 10])).first()
    assert (row["direction"], row["is_anomaly"], row["anomaly_score"]) == ("NONE", False, 0.0)


def test_cases_prefer_distinct_cells(spark, stamp):
    rows = [(1, 0, 9.0), (1, 1, 8.0), (2, 0, 3.0), (3, 0, 2.0)]
    df = spark.createDataFrame(
        [(g, stamp(h), s, "HIGH", True) for g, h, s in rows]
        + [(7, stamp(0), 5.0, "LOW", True), (7, stamp(1), 4.0, "LOW", True)]
        + [(7, stamp(2), 3.0, "LOW", True), (9, stamp(0), 99.0, "HIGH", False)],
        "grid_id int, timestamp timestamp_ntz, anomaly_score double, direction string, "
        "is_anomaly boolean",
    )
    out = anomaly.anomaly_cases(df).orderBy("direction", "case_number").collect()
    assert [(r["direction"], r["grid_id"], r["anomaly_score"]) for r in out] == [
        ("HIGH", 1, 9.0), ("HIGH", 2, 3.0), ("LOW", 7, 5.0), ("LOW", 7, 4.0),
    ]


def test_rules_and_multiplicity(hours_frame):
    df = hours_frame([(1, h, t) for h, t in enumerate([10, 10, 30, 4, 10])])
    rows = alerts.alerts(df, floor=0.0).orderBy("timestamp", "alert_type").collect()
    kinds = [(r["timestamp"].hour, r["alert_type"]) for r in rows]
    assert kinds == [
        (2, "ACTIVITY_SPIKE"), (2, "HIGH_ACTIVITY"), (3, "ACTIVITY_DROP"), (4, "ACTIVITY_SPIKE"),
    ]
    reasons = {r["alert_type"]: r["reason"] for r in rows if r["timestamp"].hour in (2, 3)}
    assert reasons == {
        "ACTIVITY_SPIKE": "ACTIVITY_SPIKE: current activity 30.0 is at least 1.5x the preceding "
        "hour 10.0.",
        "HIGH_ACTIVITY": "HIGH_ACTIVITY: current activity 30.0 is at least 2.0x the baseline "
        "10.0.",
        "ACTIVITY_DROP": "ACTIVITY_DROP: current activity 4.0 is at or below 0.5x the baseline "
        "10.0.",
    }


def test_previous_row_bridges_gaps_unless_adjacent(hours_frame):
    df = hours_frame([(1, 0, 10), (1, 5, 100), (1, 6, 100)])
    spikes = F.col("alert_type") == "ACTIVITY_SPIKE"
    assert alerts.alerts(df, floor=0.0).filter(spikes).count() == 1
    assert alerts.alerts(df, floor=0.0, require_adjacent=True).filter(spikes).count() == 0


def test_floor_removes_quiet_cells(hours_frame):
    quiet = [(1, 0, 1), (1, 1, 5)]
    busy = [(g, h, 100 * (h + 1)) for g in range(2, 12) for h in range(3)]
    df = hours_frame(quiet + busy)
    floor = alerts.activity_floor(df).first()["activity_floor"]
    assert floor == pytest.approx(600.0)
    assert alerts.alerts(df).filter("grid_id = 1").count() == 0
    assert alerts.alerts(df, floor=0.0).filter("grid_id = 1").count() > 0


def test_floor_with_a_wider_bucket_uses_ranks(hours_frame):
    df = hours_frame([(g, h, g * (h + 1)) for g in range(1, 6) for h in range(2)])
    floor = alerts.activity_floor(df, 0.5, ("grid_id", "timestamp")).first()["activity_floor"]
    assert floor == pytest.approx(4.0)


@pytest.fixture
def alert_table(spark, stamp):
    rows = [
        (4821, stamp(23), "ACTIVITY_SPIKE"), (100, stamp(23), "HIGH_ACTIVITY"),
        (4821, stamp(22), "ACTIVITY_DROP"), (100, stamp(23), "ACTIVITY_SPIKE"),
    ]
    return spark.createDataFrame(
        [(*r, 2.0, 1.0, "x") for r in rows],
        "grid_id int, timestamp timestamp_ntz, alert_type string, current_activity double, "
        "baseline_activity double, reason string",
    )


def test_feed_order_and_filter(alert_table, stamp):
    feed = alerts.alert_feed(alert_table, 10).collect()
    assert [(r["grid_id"], r["timestamp"].hour, r["severity"]) for r in feed] == [
        (100, 23, "HIGH"), (100, 23, "MEDIUM"), (4821, 23, "MEDIUM"), (4821, 22, "MEDIUM"),
    ]
    assert {r["as_of"] for r in feed} == {stamp(23)}
    assert alerts.alert_feed(alert_table, 10, level="HIGH").count() == 1
    assert alerts.alert_feed(alert_table, 10, as_of=stamp(22)).count() == 1
    assert alerts.alert_feed(alert_table, 2).count() == 2


def test_status_alert_overrides_hotspot(spark, alert_table, stamp):
    hot = spark.createDataFrame(
        [(4821, stamp(1), 50.0), (5, stamp(1), 40.0), (5, stamp(2), 30.0)],
        "grid_id int, timestamp timestamp_ntz, total_activity double",
    )
    feed = alerts.alert_feed(alert_table, 10)
    out = {r["grid_id"]: r for r in alerts.grid_status(hot, feed).collect()}
    assert out[5]["status"] == "ATTENTION" and out[5]["total_activity"] == 30.0
    assert out[4821]["alert_type"] == "ACTIVITY_DROP"
    assert out[100]["status"] == "ATTENTION"  # the later, lower alert of the same hour wins
    ranked = alerts.ranked_operations(hot, feed).collect()
    assert ranked[0]["status"] == "HIGH" and ranked[1]["activity"] == 50.0


def test_collapsed_types_are_sorted_and_distinct(alert_table):
    row = alerts.alerts_by_hour(alert_table).filter("grid_id = 100").first()
    assert row["np3_alert_types"] == "ACTIVITY_SPIKE|HIGH_ACTIVITY" and row["np3_alert_count"] == 2

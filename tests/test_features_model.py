from __future__ import annotations

import random
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from gridpulse.functions.activity import quick_round
from gridpulse.operators import anomaly, features, model, newton, quality, signals
from gridpulse.schemas import FEATURES
from gridpulse.sources import sinks


def test_literal_case(hours_frame):
    rows = [(1, h, 100, 50) for h in range(24)] + [(1, 24 + h, h + 1, (h + 1) / 2) for h in range(24)]
    out = features.grid_features(hours_frame(rows)).collect()
    assert len(out) == 1
    r = out[0]
    assert r["avg_activity"] == 12.5
    assert r["activity_growth"] == -0.875
    assert r["active_hours"] == 24
    assert r["peak_ratio"] == 1.92
    assert r["internet_share"] == 0.5
    assert r["variability"] == pytest.approx(pstdev(range(1, 25)))


def test_zeros_give_zero_features(hours_frame):
    r = features.grid_features(hours_frame([(1, h, 0) for h in range(48)])).first()
    assert [r[c] for c in FEATURES] == [0.0, 0.0, 0, 0.0, 0.0, 0.0]


def test_short_and_broken_runs_give_no_row(hours_frame):
    assert features.grid_features(hours_frame([(1, h, 1) for h in range(47)])).count() == 0
    mixed = [(1, h, 1) for h in range(24)] + [(2, 24 + h, 1) for h in range(24)]
    assert features.grid_features(hours_frame(mixed)).count() == 0
    gap = [(1, h if h < 30 else h + 1, 1) for h in range(77)]
    assert features.grid_features(hours_frame(gap)).count() == 0
    assert features.grid_features(hours_frame(gap + [(1, 78, 1)])).count() == 1


def test_future_row_does_not_leak(hours_frame):
    rows = [(1, h, h) for h in range(48)]
    now = features.grid_features(hours_frame(rows)).first()
    later = features.grid_features(hours_frame(rows + [(1, 48, 999999)])).orderBy(
        "feature_timestamp"
    )
    assert later.first() == now


def test_features_and_label_brute_force(hours_frame, stamp):
    rng = random.Random(3)
    rows = {}
    for g in (1, 2):
        for h in range(130):
            if rng.random() > 0.01:
                t = rng.choice([0, 0, rng.uniform(0, 50)])
                rows[(g, h)] = (t, t * rng.random())
    df = hours_frame([(g, h, t, i) for (g, h), (t, i) in rows.items()])
    want = {}
    for g, h in rows:
        window = [rows.get((g, k)) for k in range(h - 47, h + 1)]
        if None in window or (g, h + 1) not in rows:
            continue
        prior, recent = [t for t, _ in window[:24]], [t for t, _ in window[24:]]
        avg, before = fmean(recent), fmean(prior)
        want[(g, stamp(h))] = [
            avg, (avg - before) / before if before else 0.0, sum(t > 0 for t in recent),
            max(recent) / avg if avg else 0.0, pstdev(recent),
            sum(i for _, i in window[24:]) / sum(recent) if sum(recent) else 0.0,
            int(rows[(g, h + 1)][0] >= 20),
        ]
    one_pass = features.grid_features(df, label_threshold=20)
    joined = features.next_hour_label(features.grid_features(df), df, 20)
    for frame in (one_pass, joined):
        got = {
            (r["grid_id"], r["feature_timestamp"]): [r[c] for c in FEATURES]
            + [r["high_activity_target"]]
            for r in frame.collect()
        }
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k])


def test_trailing_rows_leave_nulls_out(spark, hours_frame):
    """Every figure equals the plain aggregate over the last 24 rows, few updates a row."""
    from pyspark.sql.window import Window

    rng = random.Random(5)
    rows = [(g, h, rng.choice([0, 3.25, rng.uniform(0, 9)]), rng.random()) for g in (1, 2) for h in range(90)]
    rows += [(3, h, 0.1, 0.1) for h in range(60)]
    hole = (F.col("grid_id") == 1) & (F.hour("timestamp") % 5 == 0) | (F.col("timestamp") >= "2024-01-03") & (F.col("grid_id") == 2)
    df = hours_frame(rows)
    df = df.withColumn("total_activity", F.when(~hole, F.col("total_activity")))
    recent = Window.partitionBy("grid_id").orderBy("timestamp").rowsBetween(-23, 0)
    total = F.col("total_activity")
    plain = df.select(
        "grid_id", F.col("timestamp").alias("feature_timestamp"), F.sum(total).over(recent).alias("s"),
        F.count_if(total > 0).over(recent).alias("h"), F.max(total).over(recent).alias("p"),
        F.stddev_pop(total).over(recent).alias("d"), F.sum("internet_activity").over(recent).alias("i"),
    )
    out = features.grid_features(df)
    assert "rowframe, -23" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    both = out.join(plain, ["grid_id", "feature_timestamp"]).collect()
    assert len(both) == 43 + 43 + 13
    for r in both:
        assert r["active_hours"] == r["h"]
        assert r["avg_activity"] == (None if r["s"] is None else pytest.approx(r["s"] / 24))
        assert r["variability"] == (None if r["d"] is None else pytest.approx(r["d"], abs=1e-12))
        if r["s"]:
            assert r["peak_ratio"] == pytest.approx(r["p"] * 24 / r["s"])
            assert r["internet_share"] == pytest.approx(r["i"] / r["s"])
        if r["grid_id"] == 3:
            assert r["variability"] == 0


def test_features_take_three_windows(hours_frame):
    """Every window copies all rows once, so the trailing figures, marks and runs share them."""
    rows = [(1, h, h % 7) for h in range(60)]
    plan = features.grid_features(hours_frame(rows), 3.0)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" :+-").startswith("Window [") for line in plan.splitlines()) <= 3


def test_quick_round_is_round(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 0.0009765625, -0.0009765625, 1e-12, -1e-12, 5e-10, 4.9999999995, 2.5e-9, 1e12, -3e15, float("inf"), None]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(3000)]
    values += [(2 * rng.randint(0, 10**9) + 1) / 2e9 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (4, 9):
        assert df.filter(~(quick_round(F.col("v"), d)).eqNullSafe(F.round("v", d))).count() == 0
    assert df.filter(quick_round(F.lit(float("nan")), 9) != F.lit(float("nan"))).count() == 0


def test_fill_hours(hours_frame, stamp):
    out = features.fill_hours(hours_frame([(1, 0, 5, 1), (1, 3, 7, 2), (2, 9, 1, 1)]))
    rows = [
        (r["grid_id"], r["timestamp"], r["total_activity"], r["internet_activity"])
        for r in out.orderBy("grid_id", "timestamp").collect()
    ]
    assert rows == [
        (1, stamp(0), 5.0, 1.0), (1, stamp(1), 0.0, 0.0), (1, stamp(2), 0.0, 0.0),
        (1, stamp(3), 7.0, 2.0), (2, stamp(9), 1.0, 1.0),
    ]


@pytest.mark.parametrize("n,cut", [(2, 1), (3, 2), (5, 4), (10, 8), (11, 8)])
def test_split_position(hours_frame, stamp, n, cut):
    df = hours_frame([(g, h, 1) for g in (1, 2) for h in range(n)]).withColumnRenamed(
        "timestamp", "feature_timestamp"
    )
    assert features.split_cutoff(df).first()["cutoff"] == stamp(cut)
    out = features.chronological_split(df)
    assert out.filter("split = 'train'").count() == 2 * cut
    assert out.filter("split = 'test'").count() == 2 * (n - cut)


def test_split_needs_two_stamps(hours_frame):
    df = hours_frame([(1, 0, 1)]).withColumnRenamed("timestamp", "feature_timestamp")
    assert features.split_cutoff(df).count() == 0
    with pytest.raises(Exception, match="two distinct stamps"):
        features.chronological_split(df).collect()


def test_feature_lookup(hours_frame, stamp):
    rows = features.grid_features(hours_frame([(5, h, h) for h in range(50)]))
    newest = features.grid_features_at(rows, 5).first()
    assert (newest["feature_timestamp"], newest["freshness"]) == (stamp(49), "CURRENT")
    older = features.grid_features_at(rows, 5, stamp(48)).first()
    assert (older["freshness"], older["data_quality"]) == ("HISTORICAL", "VALID")
    for bad in (0, 10001):
        assert features.grid_features_at(rows, bad).count() == 0
    assert features.latest_features(rows).first()["feature_timestamp"] == stamp(49)


def test_feature_checks_flag_bad_rows(spark, stamp):
    good = [1, stamp(0), 1.0, 0.0, 24, 1.0, 0.0, 0.5]
    bad = [1, stamp(0), float("nan"), 0.0, 25, float("inf"), 0.0, 1.5]
    df = spark.createDataFrame(
        [good, bad],
        "grid_id int, feature_timestamp timestamp_ntz, avg_activity double, activity_growth "
        "double, active_hours int, peak_ratio double, variability double, internet_share double",
    )
    got = {r["check"]: r["value"] for r in quality.feature_checks(df).collect()}
    assert got == {
        "missing_key": 0, "not_finite": 1, "active_hours_range": 1, "internet_share_range": 1,
        "duplicate_keys": 1,
    }


@pytest.fixture(scope="module")
def labelled(spark):
    """Labels from a known noisy rule over two informative features."""
    df = spark.range(2000).select(
        (F.col("id") % 50 + 1).cast("int").alias("grid_id"),
        F.timestamp_add("HOUR", F.floor(F.col("id") / 50).cast("int"),
                        F.lit("2024-01-01").cast("timestamp_ntz")).alias("feature_timestamp"),
        (F.rand(1) * 10).alias("avg_activity"),
        F.randn(2).alias("activity_growth"),
        (F.rand(3) * 24).cast("int").alias("active_hours"),
        (F.rand(4) + 1).alias("peak_ratio"),
        (F.rand(5) * 3).alias("variability"),
        F.rand(6).alias("internet_share"),
    )
    signal = F.col("avg_activity") - 5 + F.col("activity_growth") + F.randn(7)
    return df.withColumn("high_activity_target", (signal > 0).cast("int")).persist()


def test_model_fit_is_the_penalised_optimum(labelled):
    """Gradient of mean loss + |w|^2 / (2 C n) vanishes on population-standardised features."""
    import numpy as np

    n = labelled.count()
    fitted = model.train(labelled)
    factor = ((n - 1) / n) ** 0.5
    w = np.array(fitted.stages[-1].coefficients) * factor
    b = fitted.stages[-1].intercept
    pdf = labelled.toPandas()
    x = pdf[FEATURES].to_numpy(float)
    z = (x - x.mean(0)) / x.std(0)
    p = 1 / (1 + np.exp(-(z @ w + b)))
    gradient = z.T @ (p - pdf["high_activity_target"]) / n + w / n
    assert np.abs(gradient).max() < 1e-4
    scored = model.score(fitted, labelled).toPandas()
    assert np.allclose(scored["risk_score"], p, atol=1e-9)
    names = model.coefficients(fitted, labelled.sparkSession, n).collect()
    assert [r["coefficient"] for r in names] == pytest.approx(list(w))
    assert names[0]["direction"] == "positive"


def standardised(pdf, names):
    import numpy as np

    x = pdf[names].to_numpy(float)
    return (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0)


def test_newton_reaches_the_optimum_of_every_set(labelled, spark):
    import numpy as np

    fits = newton.fit_sets(labelled, model.FEATURE_SETS)
    pdf = labelled.toPandas()
    y = pdf["high_activity_target"].to_numpy(float)
    for name, names in model.FEATURE_SETS.items():
        z, w = standardised(pdf, names), np.array(fits[name].weights)
        p = 1 / (1 + np.exp(-(z @ w + fits[name].intercept)))
        assert np.abs(z.T @ (p - y) + w).max() < 1e-8 and abs((p - y).sum()) < 1e-8
        scored = newton.score(fits[name], labelled).toPandas()
        assert np.allclose(scored["risk_score"], p, atol=1e-12)
    rows = newton.coefficients(fits["All six features"], spark).collect()
    assert [r["feature"] for r in rows] == FEATURES and rows[0]["direction"] == "positive"


def test_newton_equals_the_ml_fit(labelled):
    import numpy as np

    n = labelled.count()
    pipeline = model.train(labelled, tol=1e-13)
    fitted = newton.fit(labelled)
    weights = np.array(pipeline.stages[-1].coefficients) * ((n - 1) / n) ** 0.5
    assert np.abs(weights - fitted.weights).max() < 2e-5  # where the ML optimiser stops
    assert abs(pipeline.stages[-1].intercept - fitted.intercept) < 2e-5


def test_newton_reads_the_rows_once_a_step_for_all_sets(labelled, monkeypatch):
    passes = []
    real = newton._sums
    monkeypatch.setattr(newton, "_sums", lambda fit, name: passes.append(name) or real(fit, name))
    newton.fit_sets(labelled, model.FEATURE_SETS)
    assert passes[:4] == ["s0", "s1", "s2", "s3"] and passes.count("s0") < 15


def test_newton_is_not_held_up_by_the_rounding_of_the_loss(labelled, monkeypatch):
    """The loss of many rows carries rounding that may rise from pass to pass."""
    passes = []
    real = newton._sums

    def noisy(fit, name):
        loss, *others = real(fit, name)
        passes.append(name)
        return [(loss * (1 + 1e-11 * len(passes))).alias(f"{name}_0"), *others]

    exact = newton.fit(labelled)
    monkeypatch.setattr(newton, "_sums", noisy)
    fitted = newton.fit(labelled)
    assert len(passes) < 10
    assert fitted.weights == pytest.approx(exact.weights, abs=1e-9)


def test_newton_of_constant_features_and_single_classes(spark):
    rows = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 1), (3.0, 5.0, 1)], "a double, b double, high_activity_target int")
    fitted = newton.fit(rows, ["a", "b"])
    assert fitted.weights[1] == 0 and fitted.weights[0] > 0
    for few in (rows.filter("high_activity_target = 1"), rows.limit(0)):
        with pytest.raises(ValueError, match="both classes"):
            newton.fit(few, ["a"])


def test_model_roundtrip_and_feature_check(labelled, tmp_path, stamp):
    fitted = model.train(labelled, max_iter=20)
    model.save(fitted, str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    a = model.score(fitted, labelled).agg(F.sum("risk_score")).first()[0]
    assert model.score(again, labelled).agg(F.sum("risk_score")).first()[0] == pytest.approx(a)
    with pytest.raises(ValueError, match="expected"):
        model.load(str(tmp_path / "m"), ["avg_activity"])
    point = model.predict_point(again, labelled, 3, stamp(2)).collect()
    assert len(point) == 1 and 0 <= point[0]["risk_score"] <= 1
    assert model.predict_point(again, labelled, 3, stamp(9999)).count() == 0


def test_evaluation_and_ablation(labelled):
    parts = features.chronological_split(labelled)
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    out = {r["model"]: r for r in model.ablation(train, test).collect()}
    assert set(out) == set(model.FEATURE_SETS)
    full, without = out["All six features"], out["Without avg_activity"]
    assert full["roc_auc"] > 0.9 > without["roc_auc"]
    assert full["accuracy"] > without["accuracy"]


def test_confusion_zero_division(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "risk_score double, y int")
    r = signals.confusion(df, "risk_score", "y").first()
    assert (r["precision"], r["recall"], r["accuracy"], r["baseline_accuracy"]) == (0, 0, 1, 1)
    assert r["accuracy_warning"]


def test_risk_table_keeps_zero_baselines_and_refuses_missing(spark, stamp):
    scored = spark.createDataFrame(
        [(1, stamp(0), 0.5), (2, stamp(0), 0.49)],
        "grid_id int, feature_timestamp timestamp_ntz, risk_score double",
    )
    anomalies = spark.createDataFrame(
        [(1, stamp(0), None, None, False, "zero"), (2, stamp(0), 1.0, "HIGH", True, "r")],
        "grid_id int, timestamp timestamp_ntz, anomaly_score double, direction string, "
        "is_anomaly boolean, reason string",
    )
    rows = signals.risk_table(signals.combine_risk(scored, anomalies)).orderBy("grid_id").collect()
    assert [(r["risk_level"], r["anomaly_score"], r["is_anomaly"]) for r in rows] == [
        ("HIGH", None, 0), ("LOW", 1.0, 1),
    ]
    for left, right in ((scored.union(scored), anomalies), (scored, anomalies.union(anomalies))):
        with pytest.raises(Exception, match="for one grid and hour"):
            signals.combine_risk(left, right).collect()
    missing = signals.combine_risk(scored, anomalies.filter("grid_id = 1"))
    with pytest.raises(Exception, match="without anomaly"):
        signals.risk_table(missing).collect()
    assert signals.risk_table(missing, strict=False).count() == 2


def test_joins_of_filled_hours_are_not_broadcast(hours_frame):
    """Few rows are stored, filling multiplies them: the planner's size is that of the stored ones."""
    hours = hours_frame([(g, h, g + h) for g in (1, 2) for h in (0, 5000)])
    filled = features.fill_hours(sinks.stage_table(hours, "hours"))
    scored = filled.select("grid_id", F.col("timestamp").alias("feature_timestamp"), F.lit(0.5).alias("risk_score"))
    risk = signals.risk_table(signals.combine_risk(scored, anomaly.anomaly_scores(filled)))
    label = features.next_hour_label(scored, filled)
    for joined, rows in ((risk, 10002), (label, 10000)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert joined.count() == rows


def test_zone_shift_in_comparison(spark, stamp):
    alerts = spark.createDataFrame(
        [(1, stamp(0), "HIGH_ACTIVITY")], "grid_id int, timestamp timestamp_ntz, alert_type string"
    )
    test = spark.createDataFrame(
        [(1, stamp(4), 1, 0.9, 1)],
        "grid_id int, feature_timestamp timestamp_ntz, ml3_prediction int, ml3_probability "
        "double, high_activity_target int",
    )
    assert signals.alert_vs_model(test, alerts).first()["comparison_group"] == "ML3_ONLY"
    shifted = signals.alert_vs_model(test, alerts, zone="Asia/Dubai").first()
    assert shifted["comparison_group"] == "BOTH"

"""Plan shape: pruning, pushdown, join strategy, exchanges, no row-wise Python."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL
from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.operators import aggregate, alerts, anomaly, cleaning, features, geo, signals
from gridpulse.plans import catalog
from gridpulse.sources import sinks
from tools.compare import TABLES, comparable

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main_path(text: str) -> str:
    """The plan without its scalar subqueries."""
    return "\n".join(line for line in text.splitlines() if not line.lstrip().startswith(":"))


@pytest.fixture(scope="module")
def stored(spark):
    """Canonical activity, hourly and reference tables on disk."""
    activity = sinks.stage_table(catalog.activity(spark, SMALL), "activity")
    hourly = sinks.stage_table(
        aggregate.grid_hour(cleaning.clean_activity(activity), decimals=2), "hourly"
    )
    cells = sinks.stage_table(catalog.all_cells(spark, SMALL), "cells")
    return activity, hourly, cells


def test_valid_rows_equal_the_rows_without_reason(spark):
    df = catalog.defective(spark, SMALL)
    a = cleaning.valid_rows(df)
    b = cleaning.classify(df).filter("rejection_reason is null").drop("rejection_reason")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert a.count() + cleaning.rejected_rows(df).count() == df.count()


@pytest.fixture(autouse=True)
def whole_plan_text(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_cleaning_filters_reach_the_scan(stored):
    text = plan(cleaning.clean_activity(stored[0]))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    for part in ("IsNotNull(timestamp)", "GreaterThanOrEqual(grid_id,1)",
                 "LessThanOrEqual(grid_id,10000)"):
        assert part in pushed
    assert "internet_activity" in pushed


def test_scan_reads_only_used_columns(stored):
    text = plan(aggregate.hotspots(stored[1]))
    assert re.search(r"ReadSchema: struct<grid_id:int,total_activity:double>", text)
    assert "TakeOrderedAndProject" in text


def test_given_cutoff_reaches_the_scan(stored):
    text = plan(alerts.hotspot_feed(stored[1], 5, catalog.AS_OF))
    assert "LessThanOrEqual(timestamp,2024-01-20" in text


def test_date_predicate_prunes_partitions(spark, stored, tmp_path):
    sinks.write_by_date(stored[1], str(tmp_path / "h"))
    df = spark.read.parquet(str(tmp_path / "h")).filter("date = date'2024-01-15'")
    assert re.search(r"PartitionFilters: \[[^\]]*date", plan(df))
    assert len(df.inputFiles()) == 30 and df.count() > 0


def test_join_strategies(stored):
    _, hourly, cells = stored
    assert "BroadcastHashJoin" in plan(geo.enrich(hourly, cells))
    merged = plan(geo.enrich(hourly, cells, hint="merge"))
    assert "SortMergeJoin" in merged and "BroadcastHashJoin" not in merged


def test_broadcast_hint_depends_on_measured_size(stored):
    _, hourly, cells = stored
    assert broadcast_if_small(cells, max_rows=3) is cells
    assert broadcast_if_small(cells, max_bytes=100) is cells
    assert broadcast_if_small(cells) is not cells


def test_windows_share_one_exchange(stored):
    _, hourly, _ = stored
    for df in (
        alerts.alerts(hourly, floor=1.0),
        anomaly.anomaly_scores(hourly),
        features.grid_features(features.fill_hours(hourly), label_threshold=5.0),
    ):
        assert main_path(plan(df)).count("Exchange hashpartitioning") == 1


def test_baseline_needs_one_sort(stored):
    text = plan(anomaly.anomaly_scores(stored[1]))
    assert len(re.findall(r"\bSort \[", text)) == 1


def test_case_ranking_limits_before_the_exchange(stored):
    text = plan(anomaly.anomaly_cases(anomaly.anomaly_scores(stored[1])))
    assert text.count("WindowGroupLimit") >= 3
    assert "Partial" in text


def test_summary_scans_once(stored):
    assert plan(aggregate.network_summary(stored[1])).count("FileScan") == 1


@pytest.mark.parametrize(
    "name,most",
    [("activity_floor", 1), ("alerts", 2), ("alert_top_grids", 2), ("alerts_by_hour", 2), ("alert_summary", 3),
     ("alert_feed", 1), ("alert_feed_high", 2), ("feature_quantiles", 3), ("three_way", 4), ("three_way_overlap", 4),
     ("comparison_summary", 3), ("alert_type_overlap", 2), ("alert_table_checks", 4), ("star_checks", 6)],
)
def test_alerts_and_percentiles_read_stored_tables_only(spark, name, most):
    text = plan(QUERIES[name](spark, SMALL))
    assert text.count("FileScan") <= most and "events.parquet" not in text


def test_single_pass_reports(stored):
    _, hourly, _ = stored
    rows = features.grid_features(features.fill_hours(hourly), label_threshold=20.0)
    rows = sinks.stage_table(rows, "rows")
    for df in (
        signals.feature_means(rows), signals.feature_corr(rows), signals.threshold_rates(rows),
        signals.nearest_scores(rows.withColumn("risk_score", F.rand(1))),
    ):
        assert plan(df).count("FileScan") == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python_rows(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                 "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in text


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The event table with a third of all rows on one user."""
    folder = tmp_path_factory.mktemp("skewed")
    for table in ("events", "supplier"):
        df = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{table}.parquet")
        if table == "events":
            hot = F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0
            df = df.withColumn("user_id", F.when(hot, F.lit(4)).otherwise(F.col("user_id")))
        df.write.parquet(str(folder / f"{table}.parquet"))
    return str(folder)


@pytest.mark.parametrize(
    "name",
    ["grid_hour", "alerts", "anomaly_scores", "grid_features", "next_hour_label", "hotspots",
     "feature_quantiles", "ranking_metrics", "landing_verdict", "star_join", "three_way_overlap",
     "grid_summary", "raw_grain_checks", "chrono_split"],
)
def test_hot_cell_results_stay_exact(spark, skewed, name):
    con = duckdb.connect()
    for t in TABLES:
        if t in ("events", "supplier"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{skewed}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, skewed).toPandas(), con.sql(SQL[name]).df()
    floats = [c for c in got.columns if got[c].dtype == "float64" and want[c].dtype == "float64"]
    keys = comparable(got.drop(columns=floats)), comparable(want.drop(columns=floats))
    assert keys[0].equals(keys[1])
    order = sorted(c for c in got.columns if c not in floats)
    for df in (got, want):
        df.sort_values(order, inplace=True, ignore_index=True, key=lambda c: c.astype(str))
    for c in floats:  # last digit may differ where a value ends in a 5 there
        np.testing.assert_allclose(
            got[c].to_numpy(float), want[c].to_numpy(float), rtol=0, atol=1.5e-6, equal_nan=True
        )


def test_shared_folder_comes_from_the_session(spark):
    from gridpulse.session import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_intermediates_lie_in_a_folder_that_is_removed(spark):
    from gridpulse import session

    table = sinks.stage_table(spark.range(3), "t")
    root = session.scratch_dir(spark)
    assert root.startswith(session.shared_dir(spark)) and all(root in f for f in table.inputFiles())
    held = session._OWNED.pop(root)  # the other tests' tables stay
    session._OWNED["x"] = (held[0], spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent())
    session._remove("x")
    session._remove("x")
    session._OWNED[root] = held
    with pytest.raises(Exception):
        table.collect()

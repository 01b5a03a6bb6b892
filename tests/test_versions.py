"""Versioned tables, incremental refresh and as-of snapshots."""

from __future__ import annotations

import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gridpulse.operators import aggregate
from gridpulse.plans import refresh
from gridpulse.sources import versions


@pytest.fixture
def keyed(spark):
    return lambda rows: spark.createDataFrame(rows, "k string, v int")


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_touched_keys_are_replaced_and_others_keep_their_folders(spark, keyed, tmp_path):
    path = str(tmp_path / "t")
    versions.commit(keyed([("a", 1), ("b", 2), ("c", 3)]), path, "k")
    first = versions.latest(spark, path)
    second = versions.commit(keyed([("b", 20), ("d", 4)]), path, "k", ["b", "c", "d"])
    assert held(versions.read(spark, path)) == [("a", 1), ("b", 20), ("d", 4)]
    assert second.folders["a"] == first.folders["a"]
    assert versions.changed(spark, path, 1) == {"b", "c", "d"} and versions.changed(spark, path, None) == {"a", "b", "d"}
    assert held(versions.read(spark, path, number=1)) == [("a", 1), ("b", 2), ("c", 3)]
    assert held(versions.read(spark, path, ["b", "x"])) == [("b", 20)] and held(versions.read(spark, path, [])) == []
    with pytest.raises(ValueError, match="not touched"):
        versions.commit(keyed([("z", 1)]), path, "k", ["y"])
    with pytest.raises(Exception, match="null k"):
        versions.commit(keyed([(None, 1)]), path, "k")
    assert versions.numbers(spark, path) == [1, 2]


def test_a_writer_that_dies_before_the_commit_changes_nothing(spark, keyed, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.commit(keyed([("a", 1)]), path)
    monkeypatch.setattr(versions, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        versions.commit(keyed([("a", 2)]), path)
    monkeypatch.undo()
    assert held(versions.read(spark, path)) == [("a", 1)]
    bad = keyed([("a", 3)]).withColumn("v", F.raise_error(F.lit("task failed")).cast("int"))
    with pytest.raises(Exception, match="task failed"):
        versions.commit(bad, path)
    assert held(versions.read(spark, path)) == [("a", 1)]
    assert len(versions.sweep(spark, path, idle=-1)) == 2
    assert versions.sweep(spark, path, idle=-1) == [] and held(versions.read(spark, path)) == [("a", 1)]


def test_of_two_writers_the_second_is_refused(spark, keyed, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.commit(keyed([("a", 1)]), path)
    with pytest.raises(versions.ConcurrentCommit):
        versions.commit(keyed([("a", 5)]), path, base=0)
    publish = versions._publish

    def overtaken(spark, path, made):
        monkeypatch.setattr(versions, "_publish", publish)
        versions.commit(keyed([("a", 2)]), path)  # another writer is faster
        publish(spark, path, made)

    monkeypatch.setattr(versions, "_publish", overtaken)
    with pytest.raises(versions.ConcurrentCommit):
        versions.commit(keyed([("a", 3)]), path)
    assert held(versions.read(spark, path)) == [("a", 2)] and versions.numbers(spark, path) == [1, 2]
    assert [n for n, _ in versions._names(spark, f"{path}/_versions") if not n.endswith((".json", ".crc"))] == []


def test_sweep_keeps_what_the_last_versions_name(spark, keyed, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        versions.commit(keyed([("a", n)] if n else [("a", n), ("b", 9)]), path, "k", ["a", "b"] if not n else ["a"])
    assert versions.sweep(spark, path, keep=2) == []  # too young
    assert len(versions.sweep(spark, path, keep=2, idle=-1)) == 1  # the first folder still holds b
    assert versions.numbers(spark, path) == [3, 4]
    assert held(versions.read(spark, path)) == [("a", 3), ("b", 9)] and held(versions.read(spark, path, number=3)) == [("a", 2), ("b", 9)]


def activity(spark, days, seed=0, drop=lambda d, g: False):
    rng = random.Random(seed)
    rows = []
    for d in days:
        for hour in range(24):
            for g in range(1, 8):
                x = [rng.randrange(0, 400) / 100 for _ in range(5)]
                if rng.random() < 0.4 and not drop(d, g):
                    stamp = datetime(2024, 1, d, hour)
                    rows.append((stamp, g, 39, *x, x[0] + x[1], x[2] + x[3], sum(x), date(2024, 1, d)))
    schema = (
        "timestamp timestamp_ntz, grid_id int, country_code int, sms_in double, sms_out double, call_in double,"
        " call_out double, internet_activity double, total_sms double, total_calls double, total_activity double, date date"
    )
    return spark.createDataFrame(rows, schema)


def rounded(df):
    doubles = [c for c, t in df.dtypes if t.startswith(("double", "decimal"))]
    return held(df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in doubles}).select(sorted(df.columns)))


def test_refresh_equals_the_full_build_and_reads_changed_days_only(spark, tmp_path):
    path, full = str(tmp_path / "a"), str(tmp_path / "b")
    everything = activity(spark, range(1, 9))
    short = everything.filter((F.col("date") <= "2024-01-05") & ((F.col("date") != "2024-01-03") | (F.col("grid_id") > 2)))
    refresh.load_days(short, path, 2)
    assert refresh.refresh(spark, path)["daily_traffic"] == {f"2024-01-0{d}" for d in range(1, 6)}
    before = versions.latest(spark, f"{path}/hourly").folders
    again = everything.filter((F.col("date") > "2024-01-05") | (F.col("date") == "2024-01-03"))
    touched = {"2024-01-03", "2024-01-06", "2024-01-07", "2024-01-08"}
    assert refresh.load_days(again, path, 2) == touched
    done = refresh.refresh(spark, path)
    assert done["cells"] == touched and done["dashboard"] == touched
    assert done["cell_snapshots"] == {f"2024-01-0{d}" for d in range(3, 9)}
    after = versions.latest(spark, f"{path}/hourly").folders
    assert {k for k in before if before[k] == after[k]} == {"2024-01-01", "2024-01-02", "2024-01-04", "2024-01-05"}
    assert refresh.refresh(spark, path)["cells"] == set()

    refresh.load_days(everything, full, 2)
    refresh.refresh(spark, full)
    for name in [*refresh.BY_DATE, "cells", "cell_snapshots", "network_snapshots", "hourly"]:
        assert rounded(versions.read(spark, f"{path}/{name}")) == rounded(versions.read(spark, f"{full}/{name}")), name
    hourly = versions.read(spark, f"{full}/hourly")
    summary = aggregate.grid_summary(hourly)
    assert rounded(versions.read(spark, f"{path}/cells").select(summary.columns)) == rounded(summary)


def test_derived_tables_read_only_the_changed_days(spark, tmp_path):
    path = str(tmp_path / "a")
    refresh.load_days(activity(spark, range(1, 6)), path, 2)
    refresh.refresh(spark, path)
    for folder in versions.latest(spark, f"{path}/hourly").folders.values():
        if "2024-01-02" not in folder:  # an unread day may as well be gone
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/hourly/{folder}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    refresh.load_days(activity(spark, [2], seed=5), path, 2)
    done = refresh.refresh(spark, path)
    assert done["daily_summary"] == done["cells"] == {"2024-01-02"}


def test_days_that_vanish_are_taken_away(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = activity(spark, [1, 2])
    refresh.load_days(rows, path, 2)
    refresh.refresh(spark, path)
    versions.commit(versions.read(spark, f"{path}/hourly").limit(0), f"{path}/hourly", "date", ["2024-01-01"])
    refresh.refresh(spark, path)
    want = aggregate.grid_summary(aggregate.grid_hour(rows.filter("date = '2024-01-02'"), 2))
    assert rounded(versions.read(spark, f"{path}/cells").select(want.columns)) == rounded(want)
    assert set(versions.latest(spark, f"{path}/cell_snapshots").folders) == {"2024-01-02"}


@pytest.mark.parametrize("as_of", [datetime(2024, 1, 1, 3), datetime(2024, 1, 4, 13), datetime(2024, 1, 5), datetime(2024, 2, 1), datetime(2023, 1, 1)])
def test_summary_from_a_snapshot_equals_the_one_from_all_rows(spark, tmp_path, as_of):
    path = str(tmp_path / "a")
    rows = activity(spark, [1, 2, 4, 5])
    refresh.load_days(rows, path, 2)
    refresh.refresh(spark, path)
    got = refresh.network_summary_at(spark, path, as_of)
    want = aggregate.network_summary(aggregate.grid_hour(rows, 2), as_of)
    assert rounded(got) == rounded(want)
    text = got._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    read = set(re.findall(r"_part=(\d{4}-\d\d-\d\d)", got._jdf.queryExecution().executedPlan().toString()))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    before = [d for d in ("2024-01-01", "2024-01-02", "2024-01-04", "2024-01-05") if d < str(as_of.date())]
    assert text and read <= {str(as_of.date()), *before[-1:]}

"""Sources, sinks, composed jobs and streams on small files."""

from __future__ import annotations

import json

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from gridpulse.functions import geometry as geom
from gridpulse.operators import aggregate, cleaning, geo, landing, layout, quality, warehouse
from gridpulse.plans import batch
from gridpulse.plans import warehouse as warehouse_plan
from gridpulse.schemas import CLEAN_SCHEMA, HOURLY_SCHEMA
from gridpulse.sources import activity as source
from gridpulse.sources import grid, sinks, versions
from gridpulse.streaming import hotspots as live
from gridpulse.streaming import landing as landing_stream

HEADER = "datetime,CellID,countrycode,smsin,smsout,callin,callout,internet"


def day_file(folder, day, lines, header=HEADER):
    path = folder / f"sms-call-internet-mi-2013-11-{day:02d}.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    return path


def hours_of(day, cells=(1, 2), countries=(0, 39)):
    return [
        f"2013-11-{day:02d} {h:02d}:00:00,{c},{k},{h + 1},{c},,1.5,{k}"
        for h in range(24)
        for c in cells
        for k in countries
    ]


@pytest.fixture
def raw_folder(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    day_file(folder, 1, hours_of(1))
    bad = [
        ",1,39,1,1,1,1,1", "2013-11-02 00:00:00,,39,1,1,1,1,1",
        "2013-11-02 00:00:00,10001,39,1,1,1,1,1", "2013-11-02 00:00:00,1,7,-1,1,1,1,1",
        "oops,1,39,1,1,1,1,1", "2013-11-02 00:00:00,2,39,abc,1,1,1,1",
    ]
    day_file(folder, 2, hours_of(2) + bad)
    return folder


def square(cell):
    x = float(cell)
    return {
        "type": "Polygon",
        "coordinates": [[[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 1.0], [x, 0.0]]],
    }


def geojson(path, cells, **overrides):
    features = [
        {"type": "Feature", "id": 900 + c, "properties": {"cellId": c}, "geometry": square(c)}
        for c in cells
    ]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features, **overrides}))
    return str(path)


def test_typed_and_text_scans_agree(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    day_file(folder, 1, hours_of(1))
    typed = source.to_canonical(source.read_typed_csv(spark, str(folder)))
    text = cleaning.cast_columns(source.to_canonical(source.read_text_csv(spark, str(folder))))
    a = cleaning.clean_activity(typed.drop("source_file"))
    b = cleaning.clean_activity(text.drop("input_file_name"))
    assert quality.parity(a, b).filter("not matches").count() == 0
    assert typed.filter(F.col("source_file").endswith("2013-11-01.csv")).count() == 96
    checks = quality.ingest_acceptance(typed, expected_files=1).collect()
    assert all(r["passed"] for r in checks)


def test_csv_columns_are_read_by_name(spark, tmp_path):
    names = HEADER.split(",")
    swapped = ",".join([*names[:3], names[4], names[3], *names[5:]])
    folder = tmp_path / "swapped"
    folder.mkdir()
    day_file(folder, 1, ["2013-11-01 00:00:00,1,39,5,10,3,2,100"], header=swapped)
    for read in (source.read_typed_csv, source.read_text_csv):
        row = read(spark, str(folder)).first()
        assert (float(row["smsin"]), float(row["smsout"])) == (10.0, 5.0)
    short = tmp_path / "short"
    short.mkdir()
    day_file(short, 1, ["2013-11-01 00:00:00,1,39,5,10,3"], header=",".join(names[:6]))
    with pytest.raises(ValueError, match="callout"):
        source.read_text_csv(spark, str(short))
    day_file(folder, 2, ["2013-11-02 00:00:00,1,39,10,5,3,2,100"])
    with pytest.raises(Exception, match="header"):
        source.read_text_csv(spark, str(folder)).collect()


def test_wide_cell_ids_are_kept(spark, stamp):
    rows = [(stamp(0), c, 39, 1.0, None, None, None, None) for c in (1, 10_001, 3_000_000)]
    df = spark.createDataFrame(
        rows,
        "timestamp timestamp_ntz, grid_id int, country_code int, sms_in double, sms_out double, "
        "call_in double, call_out double, internet_activity double",
    )
    assert cleaning.clean_activity(df).count() == 1
    assert cleaning.clean_activity(df, (1, 2**31 - 1)).count() == 3
    assert cleaning.rejected_rows(df, (1, 2**31 - 1)).isEmpty()


def test_file_discovery(spark, raw_folder, tmp_path):
    files = source.require_files(spark, str(raw_folder))
    assert landing.named_like_contract(files).count() == 2
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        source.require_files(spark, str(tmp_path / "empty"))


def test_landing_verdicts(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    good = "2013-11-01 00:00:00,1,39,10,5,3,2,100"
    day_file(folder, 1, [good])
    day_file(folder, 2, ["2013-11-01 00:00:00,1,39,-10,5,3,2,100"])
    day_file(folder, 3, ["2013-11-01 00:00:00,1,39,,5,3,2,100"])
    day_file(folder, 4, [])
    day_file(folder, 5, ["2013-11-01 00:00:00,1,39,10,5,3"], header=HEADER.rsplit(",", 2)[0])
    day_file(folder, 6, ["x,100,1,2013-11-01 00:00:00,39,1,2,3,4"],
             header="note,internet,CellID,datetime,countrycode,smsin,smsout,callin,callout")
    day_file(folder, 7, ["bad,zz,,x,1,1,1,1"])
    day_file(folder, 8, [good, good + ",9"])
    day_file(folder, 9, [good, HEADER, good])
    day_file(folder, 10, [good + ",8"], header=HEADER + ",smsin")
    day_file(folder, 11, [good.replace(",1,39,", ",1.0,39,")])
    (folder / "sms-call-internet-mi-latest.csv").write_text(HEADER + "\n" + good + "\n")
    rows, headers = source.read_landing(spark, str(folder))
    headers, rows = landing.named_like_contract(headers), landing.named_like_contract(rows)
    verdict = {
        r["filename"][-6:-4]: (r["status"], r["row_count"], r["reason"])
        for r in landing.landing_verdict(rows, headers).collect()
    }
    ok = "File validated and routed to raw."
    assert verdict == {
        "01": ("ACCEPTED", 1, ok),
        "02": ("REJECTED", 1, "Negative activity values in smsin: 1"),
        "03": ("ACCEPTED", 1, ok),
        "04": ("REJECTED", 0, "File contains zero data rows."),
        "05": ("REJECTED", 0, "Missing required columns: ['callout', 'internet']"),
        "06": ("ACCEPTED", 1, ok),
        "07": ("REJECTED", 1, "Invalid datetime values: 1"),
        "08": ("REJECTED", 0, "Unable to read CSV: lines with too many fields: 1"),
        "09": ("REJECTED", 3, "Invalid datetime values: 1"),
        "10": ("ACCEPTED", 1, ok),
        "11": ("ACCEPTED", 1, ok),
    }
    again = cleaning.cast_columns(source.to_canonical(rows.drop("surplus_fields")))
    assert again.filter(F.col("file_name").endswith("11.csv")).first()["grid_id"] == 1
    moved = rows.filter(F.col("file_name").endswith("06.csv")).first()
    assert (moved["internet"], moved["CellID"], moved["callout"]) == ("100", "1", "4")


def test_ingest_stage_is_idempotent(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    day_file(folder, 1, hours_of(1))
    day_file(folder, 2, ["2013-11-02 00:00:00,1,39,-10,5,3,2,100"])
    args = (spark, str(folder), str(tmp_path / "raw"), str(tmp_path / "audit"))
    assert batch.ingest_stage(*args) == {
        "detected": 2, "accepted": 1, "rejected": 1, "skipped": 0,
    }
    day_file(folder, 3, hours_of(3))
    # an accepted file is known by its name and not opened again
    (folder / "sms-call-internet-mi-2013-11-01.csv").write_bytes(b"\xff\xfe")
    assert batch.ingest_stage(*args) == {
        "detected": 3, "accepted": 1, "rejected": 1, "skipped": 1,
    }
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2 * 96
    audit = spark.read.parquet(str(tmp_path / "audit"))
    assert audit.filter("status = 'SKIPPED'").first()["row_count"] == 0
    assert audit.count() == 5


def test_batch_job(spark, raw_folder, tmp_path):
    ref = geojson(tmp_path / "grid.geojson", [1, 2])
    out = str(tmp_path / "out")
    result = batch.run_batch(spark, str(raw_folder), out, ref, expected_grids=2)
    c = result.counters
    assert (c["input_rows"], c["rejected_rows"], c["clean_rows"]) == (198, 5, 193)
    assert c["missing_timestamp"] == 2 and c["negative_activity"] == 1
    assert c["missing_grid_id"] == 1 and c["invalid_grid_id"] == 1
    assert c["hourly_rows"] == c["enriched_rows"] == 96
    clean = spark.read.parquet(f"{out}/clean_activity")
    assert quality.schema_differences(clean, CLEAN_SCHEMA) == {
        "missing": [], "unexpected": [], "retyped": [],
    }
    assert clean.filter("input_file_name is null").count() == 0
    hourly = spark.read.parquet(f"{out}/hourly")
    assert quality.schema_differences(hourly, HOURLY_SCHEMA)["missing"] == []
    assert spark.read.parquet(f"{out}/enriched").filter("geometry is null").count() == 0
    board = spark.read.option("header", True).csv(f"{out}/dashboard")
    assert board.count() == 48 and "internet_share" not in board.columns
    assert spark.read.json(f"{out}/report").first()["reconciled"]
    again = batch.run_batch(spark, str(raw_folder), out, ref, expected_grids=2)
    assert again.counters == c
    assert spark.read.parquet(f"{out}/clean_activity").count() == 193


def test_reconciliation_failure():
    counters = {"input_rows": 5, "rejected_rows": 1, "clean_rows": 3, "hourly_rows": 2,
                "enriched_rows": 3}
    assert len(batch.reconciliation_failures(counters)) == 2


def test_usage_job(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    day_file(folder, 1, hours_of(1))
    out = batch.usage_job(source.read_typed_csv(spark, str(folder)), str(tmp_path / "usage"))
    assert out["daily_summary"].first()["active_grid_hours"] == 48
    assert {r["active_hours"] for r in out["grid_summary"].collect()} == {24}
    day_file(folder, 2, ["2013-11-02 00:00:00,0,39,1,1,1,1,1"])
    with pytest.raises(ValueError, match="invalid_grid_id"):
        batch.usage_job(source.read_typed_csv(spark, str(folder)))


def clean_rows(spark, folder):
    df = source.to_canonical(source.read_typed_csv(spark, str(folder), file_column="input_file_name"))
    return cleaning.clean_activity(df).select(*CLEAN_SCHEMA.fieldNames())


def test_storage_stage(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    day_file(folder, 1, hours_of(1))
    day_file(folder, 2, hours_of(2))
    clean = clean_rows(spark, folder)
    checks = batch.storage_stage(clean, aggregate.grid_hour(clean), str(tmp_path / "store"))
    assert checks.filter("not passed").count() == 0 and checks.count() == 12
    assert {p.name for p in (tmp_path / "store" / "hourly").iterdir() if p.is_dir()} == {
        "date=2013-11-01", "date=2013-11-02",
    }


def test_roundtrip_detects_damage(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    day_file(folder, 1, hours_of(1))
    hourly = aggregate.grid_hour(clean_rows(spark, folder))
    damaged = hourly.union(hourly.limit(1)).withColumn("geometry", F.lit("x"))
    failed = quality.roundtrip_checks(damaged, hourly, ["date", "timestamp", "grid_id"])
    assert {r["check"] for r in failed.filter("not passed").collect()} == {
        "row_count", "columns_differing", "geometry_absent", "duplicate_keys",
    }


def test_cadence(spark, stamp):
    hours = [0, 1, 2, 5, 24, 25]
    df = spark.createDataFrame([(stamp(h),) for h in hours], "timestamp timestamp_ntz")
    steps = {r["step_hours"]: r["occurrences"] for r in quality.cadence_steps(df).collect()}
    assert steps == {1: 3, 3: 1, 19: 1}
    assert quality.cadence_by_day(df).filter("valid").count() == 0
    whole = quality.cadence_global(df).first()
    assert (whole["distinct_timestamps"], whole["expected_timestamps"]) == (6, 26)


@pytest.mark.parametrize(
    "cells,overrides,failed",
    [
        ([1, 2], {}, set()),
        ([1, 2], {"type": "Feature"}, {"feature_collection"}),
        ([1], {}, {"feature_count", "distinct_ids"}),
        ([1, 1], {}, {"distinct_ids"}),
        ([1, 10001], {}, {"cell_id_range"}),
        ([1, None], {}, {"missing_cell_id", "distinct_ids"}),
        ([1, "x"], {}, {"invalid_cell_id", "distinct_ids"}),
    ],
)
def test_reference_validation(spark, tmp_path, cells, overrides, failed):
    path = tmp_path / "grid.geojson"
    features = [{"properties": {"cellId": c} if c else {}, "geometry": square(1)} for c in cells]
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features, **overrides}))
    checks = grid.reference_checks(grid.read_features(spark, str(path)), expected=2)
    assert {r["check"] for r in checks.filter("not passed").collect()} == failed


def test_geometry_text_and_centroids(spark):
    multi = {"type": "MultiPolygon", "coordinates": [square(3)["coordinates"]]}
    shapes = [(1, square(3)), (2, multi), (3, {"type": "Point", "coordinates": [1, 2]})]
    rows = [(i, json.dumps(g, separators=(",", ":"))) for i, g in shapes] + [(4, None), (5, "{")]
    df = spark.createDataFrame(rows, "id int, geometry string")
    g = F.col("geometry")
    out = df.select("id", geom.centroid_text(g).alias("c"), geom.centroid_text(g, True).alias("d"))
    got = {r["id"]: (r["c"], r["d"]) for r in out.collect()}
    assert got[1] == got[2] == ("3.400000,0.400000", "3.500000,0.500000")
    assert got[3] == got[4] == got[5] == (None, None)


@pytest.mark.parametrize("split", ["150b", "900b", "128m"])
@pytest.mark.parametrize("layout", ["compact", "indented", "type_last"])
def test_features_read_by_byte_ranges(spark, tmp_path, split, layout):
    """Strings with brackets, quotes and escapes, foreign members, any borders of the ranges."""
    odd = ["}", "{[", 'a"b}', "\\\\", '\\"]}', "é}]", ""]
    features = [
        {"type": "Feature", "properties": {"cellId": c, "name": odd[c % 7], "list": [{"a": [1]}, {}]}, "geometry": square(c)}
        for c in range(1, 60)
    ]
    head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": 'x"}]'}}}
    other = {"other": [{"properties": {"cellId": 99}, "geometry": None}, {}], "bbox": [1, 2]}
    document = {"features": features, **other, **head} if layout == "type_last" else {**head, "features": features, **other}
    path = tmp_path / "grid.geojson"
    path.write_text(json.dumps(document, ensure_ascii=False, indent=2 if layout == "indented" else None) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = grid.read_features(spark, str(path))
        tasks = spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert split == "128m" or tasks > 4
    got = {int(r["cell_id"]): (r["collection_type"], json.loads(r["geometry"])) for r in df.collect()}
    assert df.count() == 59 and got == {c: ("FeatureCollection", square(c)) for c in range(1, 60)}


@pytest.mark.parametrize(
    "text, rows",
    [
        ('{"type":"FeatureCollection","features":[]}', [("FeatureCollection", None, None)]),
        ('{"features":[{"properties":{}}],"type":"T"}', [("T", None, None)]),
        ('\ufeff{"type":"T","features":[null, {"properties":{"cellId":3},"geometry":null},null ]}', [("T", "3", None)]),
        ("", []),
    ],
)
def test_odd_feature_documents(spark, tmp_path, text, rows):
    (tmp_path / "grid.geojson").write_text(text)
    assert [tuple(r) for r in grid.read_features(spark, str(tmp_path / "grid.geojson")).collect()] == rows


def test_lookup_keeps_compact_geometry(spark, tmp_path):
    path = geojson(tmp_path / "grid.geojson", [1, 2])
    lookup = grid.load_grid_lookup(spark, path, expected=2).orderBy("grid_id").collect()
    assert json.loads(lookup[0]["geometry"]) == square(1)
    assert " " not in lookup[0]["geometry"]
    with pytest.raises(ValueError, match="feature_count"):
        grid.load_grid_lookup(spark, path, expected=3)


def test_enrichment_acceptance(spark, tmp_path, hours_frame):
    hourly = hours_frame([(1, 0, 1), (2, 0, 2), (3, 0, 3)])
    lookup = grid.load_grid_lookup(spark, geojson(tmp_path / "g.geojson", [1, 2]), expected=2)
    checks = geo.acceptance(hourly, geo.enrich(hourly, lookup), lookup, expected=2)
    assert {r["check"] for r in checks.filter("not passed").collect()} == {
        "coverage_percentage", "unmatched_grids",
    }
    assert [r["grid_id"] for r in geo.unmatched_grids(hourly, lookup).collect()] == [3]


def test_warehouse_and_derived_jobs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for d in range(1, 6):
        day_file(folder, d, hours_of(d, cells=(1, 2, 3)))
    hourly = sinks.stage_table(aggregate.grid_hour(clean_rows(spark, folder)), "hourly")
    path = str(tmp_path / "wh")
    lookup = grid.load_grid_lookup(spark, geojson(tmp_path / "g.geojson", [1, 2, 3]), expected=3)
    checks = warehouse_plan.build_warehouse(spark, hourly, lookup, path, expected_grids=3)
    assert checks.filter("not passed").count() == 0
    star = warehouse_plan.open_star(spark, path)
    assert star.count() == hourly.count() == 360
    dims = versions.read(spark, f"{path}/dim_time").orderBy("time_key").first()
    assert (dims["time_key"], dims["day_of_week"]) == (2013110100, 6)

    warehouse_plan.feature_job(star, f"{path}/features")
    warehouse_plan.feature_job(star, f"{path}/features")
    feature_rows = versions.read(spark, f"{path}/features")
    assert feature_rows.count() == 3 * (120 - 47)
    alerts = warehouse_plan.alert_job(hourly, str(tmp_path / "alerts"), floor=0.0, high_ratio=1.2)
    assert alerts.count() > 0
    anomalies = warehouse_plan.anomaly_job(hourly, str(tmp_path / "anomalies"))
    assert anomalies.count() == 360
    fitted, metrics = warehouse_plan.training_job(feature_rows, star, threshold=60.0)
    assert 0 <= metrics.first()["accuracy"] <= 1
    risk = warehouse_plan.risk_job(fitted, feature_rows, anomalies, f"{path}/risk")
    assert risk.count() == feature_rows.count()
    reports = warehouse_plan.comparison_job(
        fitted, feature_rows, star, alerts, anomalies, f"{path}/comparison", threshold=60.0
    )
    rows = sum(r["rows"] for r in reports["three_way_overlap"].collect())
    assert rows == reports["comparison_summary"].first()["total_comparison_rows"] > 0
    assert reports["outcome_rates"].count() == 5


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="internet_activity"):
        aggregate.grid_hour(spark.createDataFrame([(1,)], "grid_id int"))


def test_star_checks_find_damage(spark, hours_frame):
    hourly = hours_frame([(1, 0, 1), (2, 1, 2)])
    for c in ("sms_in", "sms_out", "call_in", "call_out", "total_sms", "total_calls"):
        hourly = hourly.withColumn(c, F.lit(0.0))
    lookup = spark.createDataFrame([(1, None), (1, None)], "grid_id int, geometry string")
    times, grids = warehouse.dim_time(hourly), warehouse.dim_grid(lookup)
    facts = warehouse.fact(hourly, times, grids)
    failed = warehouse.star_checks(hourly, facts, times, grids, expected_grids=2)
    assert {r["check"] for r in failed.filter("not passed").collect()} == {
        "duplicate_fact_keys", "duplicate_grid_ids",
    }


def test_replaced_table_can_read_its_target(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.commit(spark.range(3), path)
    versions.commit(versions.read(spark, path).unionAll(spark.range(2)), path)
    assert versions.read(spark, path).count() == 5


def test_csv_formats(spark, tmp_path, stamp):
    df = spark.createDataFrame([(stamp(1), 1.5)], "timestamp timestamp_ntz, v double")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"))
    parts = list((tmp_path / "c").glob("part-*.csv"))
    assert len(parts) == 1
    assert parts[0].read_text() == "timestamp,v\n2024-01-01 01:00:00,1.5\n"


def test_layout(spark, hours_frame):
    df = hours_frame([(g, h, 1) for g in range(1, 40) for h in range(48)]).withColumn(
        "date", F.to_date("timestamp")
    )
    one_day = df.filter("date = '2024-01-01'").repartition(8)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1k")
    try:
        placed = layout.by_date(one_day).withColumn("pid", F.spark_partition_id())
        parts = placed.groupBy("pid").agg(F.max("timestamp"), F.max("grid_id"), F.sum("total_activity"))
        assert len(parts.collect()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    key = F.concat_ws("|", "grid_id", "timestamp")
    a = layout.sample_rows(df, 0.1, 42, key)
    b = layout.sample_rows(df.repartition(7), 0.1, 42, key)
    assert 0.05 * df.count() < a.count() < 0.15 * df.count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert layout.sample_rows(df, 1.0, 42, key).count() == df.count()
    with layout.reused(df, ["grid_id"]) as kept:
        assert kept.columns == ["grid_id"] and kept.is_cached
    assert not kept.is_cached


def test_live_alerts_equal_batch(spark, tmp_path, stamp):
    folder = tmp_path / "events"
    rows = [(1, h, v) for h, v in enumerate([10, 10, 10, 50, 10])] + [(2, 3, 1)]
    data = [
        (stamp(h), g, k, v / 2, None, None, None, None)
        for g, h, v in rows
        for k in (0, 39)
    ]
    schema = (
        "timestamp timestamp_ntz, grid_id int, country_code int, sms_in double, sms_out double, "
        "call_in double, call_out double, internet_activity double"
    )
    frame = spark.createDataFrame(data, schema)
    frame.coalesce(1).write.parquet(str(folder))
    # a much later row moves the watermark past every open hour
    flush = spark.createDataFrame([(stamp(200), 9, 0, 1.0, None, None, None, None)], schema)
    base = spark.createDataFrame(
        [(g, h, 10.0) for g in (1, 2) for h in range(24)],
        "grid_id int, hour_of_day int, baseline_activity double",
    )
    args = (str(tmp_path / "alerts"), str(tmp_path / "checkpoint"))

    def drain():
        stream = spark.readStream.schema(schema).parquet(str(folder))
        alerts = live.hotspot_alerts(live.hourly_stream(stream), base)
        live.start(alerts, *args, once=True).awaitTermination()

    drain()
    flush.write.mode("append").parquet(str(folder))
    drain()
    got = [(r["grid_id"], r["timestamp"], r["current_activity"]) for r in
           spark.read.parquet(args[0]).collect()]
    hourly = aggregate.grid_hour(cleaning.clean_activity(frame))
    batch_rows = live.hotspot_alerts(hourly, base).collect()
    assert got == [(r["grid_id"], r["timestamp"], r["current_activity"]) for r in batch_rows]
    assert got == [(1, stamp(3), 50.0)]


def test_live_rules_equal_batch_across_a_restart(spark, tmp_path, stamp):
    """Spikes across the end of the first run, a gap of an hour, a late row, a cell without baseline."""
    folder = tmp_path / "events"
    schema = (
        "timestamp timestamp_ntz, grid_id int, country_code int, sms_in double, sms_out double, "
        "call_in double, call_out double, internet_activity double"
    )

    def write(rows):
        data = [(stamp(h), g, 39, float(v), None, None, None, None) for g, h, v in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(folder))

    base = spark.createDataFrame(
        [(g, h, 10.0) for g in (1, 2) for h in range(24)], "grid_id int, hour_of_day int, baseline_activity double"
    )
    args = (str(tmp_path / "alerts"), str(tmp_path / "checkpoint"))

    def drain():
        stream = spark.readStream.schema(schema).parquet(str(folder))
        live.start(live.rule_alerts(stream, base), *args, once=True).awaitTermination()

    runs = [
        [(1, 0, 10), (1, 1, 16), (1, 2, 40), (2, 0, 4), (2, 2, 12), (3, 0, 1), (3, 1, 9)],
        [(1, 2, 5), (1, 3, 70), (1, 4, 3), (1, 5, 6), (2, 3, 11), (2, 4, 30)],  # hour 2 is still open
        [(9, 300, 1)],
    ]
    for rows in runs:
        write(rows)
        drain()
    got = sorted((r["grid_id"], r["timestamp"], r["alert_type"], r["current_activity"]) for r in spark.read.parquet(args[0]).collect())
    totals = {}
    for g, h, v in [r for rows in runs[:2] for r in rows]:
        totals[g, h] = totals.get((g, h), 0.0) + v
    want = []
    for (g, h), v in totals.items():
        before = totals.get((g, h - 1), 0.0)
        rules = {"HIGH_ACTIVITY": v >= 20, "ACTIVITY_DROP": v <= 5, "ACTIVITY_SPIKE": before > 0 and v >= 1.5 * before}
        want += [(g, stamp(h), k, v) for k, fired in rules.items() if fired and g in (1, 2)]
    assert got == sorted(want) and (1, stamp(3), "ACTIVITY_SPIKE", 70.0) in got


def test_live_hotspots_on_file_and_folder(spark, tmp_path):
    from gridpulse.plans import catalog

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for name in ("supplier", "events"):
        frame = spark.read.parquet(f"{SMALL}/{name}.parquet")
        frame.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    run = catalog.registered()["live_hotspots"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    single = run(spark, SMALL)
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Rome")
        folder = run(spark, str(tmp_path))
        assert events.count() > 0 and single.count() > 0
        assert sorted(map(str, single.collect())) == sorted(map(str, folder.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_static_baseline(hours_frame):
    df = hours_frame([(1, 3, 1), (1, 27, 5), (1, 51, 3)])
    assert live.static_baseline(df).first()["baseline_activity"] == 3.0


def test_landing_stream_picks_up_new_files_once(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    day_file(folder, 1, hours_of(1))
    day_file(folder, 2, ["2013-11-02 00:00:00,1,39,-10,5,3,2,100"])
    paths = [str(tmp_path / n) for n in ("raw", "audit", "checkpoint")]

    def drain():
        landing_stream.start(spark, str(folder), *paths).awaitTermination()

    drain()
    drain()
    assert landing_stream.accepted(spark, paths[0]).count() == 96
    day_file(folder, 3, hours_of(3))
    drain()
    assert landing_stream.accepted(spark, paths[0]).count() == 192
    audit = landing_stream.audit(spark, paths[1])
    assert {(r["filename"][-6:-4], r["status"]) for r in audit.collect()} == {
        ("01", "ACCEPTED"), ("02", "REJECTED"), ("03", "ACCEPTED"),
    }

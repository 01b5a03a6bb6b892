"""Raw files to published activity tables.

Every stage reads the table the previous one wrote: no source is parsed twice,
nothing is cached, and a lost executor costs only its own tasks. Row counters
are read from the written tables: Parquet row counts need the footers only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.functions.activity import add_totals, null_cells, zero_nulls
from gridpulse.functions.times import add_time_features
from gridpulse.operators import aggregate, cleaning, geo, landing, quality
from gridpulse.schemas import AUDIT_SCHEMA, CLEAN_SCHEMA, EXPECTED_GRIDS, HOURLY_COLUMNS
from gridpulse.sources import activity as source
from gridpulse.sources import sinks
from gridpulse.sources.grid import load_grid_lookup


@dataclass
class BatchResult:
    status: str
    counters: dict[str, int] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)


def stage_classified(raw: DataFrame, path: str) -> dict[str, int]:
    """Cast, classify and store every raw row once, split by verdict; returns the counters.

    The counters come from two narrow columns of the stored table.
    """
    reason = F.col("rejection_reason")
    rows = cleaning.classify(cleaning.cast_columns(source.to_canonical(raw))).withColumns(
        {
            "null_cells": null_cells(),
            "verdict": F.when(reason.isNull(), F.lit("clean")).otherwise(F.lit("rejected")),
        }
    )
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        "verdict"
    ).parquet(path)
    stored = raw.sparkSession.read.parquet(path)
    return (
        stored.agg(
            F.count("*").alias("input_rows"),
            F.count_if(reason.isNotNull()).alias("rejected_rows"),
            F.coalesce(
                F.sum(F.when(reason.isNull(), F.col("null_cells"))), F.lit(0)
            ).alias("nulls_handled"),
            *[F.count_if(reason == r).alias(r) for r in cleaning.REASONS],
        )
        .first()
        .asDict()
    )


def staged_rows(spark: SparkSession, path: str, verdict: str) -> DataFrame:
    """Stored rows of one verdict (a partition of the staged table)."""
    staged = spark.read.parquet(path).filter(F.col("verdict") == verdict)
    return staged.drop("verdict", "null_cells")


def publish_clean(staged: DataFrame, path: str) -> int:
    clean = add_totals(add_time_features(zero_nulls(staged.drop("rejection_reason"))))
    sinks.write_by_date(clean.select(*CLEAN_SCHEMA.fieldNames()), path)
    return staged.sparkSession.read.parquet(path).count()


def publish_hourly(clean: DataFrame, path: str) -> int:
    sinks.write_by_date(aggregate.grid_hour(clean).select(*HOURLY_COLUMNS), path)
    return clean.sparkSession.read.parquet(path).count()


def publish_enriched(hourly: DataFrame, lookup: DataFrame, path: str) -> int:
    """Hourly rows with geometry, joined last and not kept upstream."""
    sinks.write_by_date(geo.enrich(hourly, lookup), path)
    return hourly.sparkSession.read.parquet(path).count()


def run_batch(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    reference_path: str,
    expected_grids: int = EXPECTED_GRIDS,
) -> BatchResult:
    """Raw CSV folder and GeoJSON to clean, rejected, hourly, enriched and dashboard outputs."""
    source.require_files(spark, input_path, "*.csv")
    names = ("staged", "clean_activity", "rejected", "hourly", "enriched", "dashboard", "report")
    paths = {name: f"{output_path}/{name}" for name in names}
    lookup = load_grid_lookup(spark, reference_path, expected_grids)
    raw = source.read_text_csv(spark, input_path)
    counters = stage_classified(raw, paths["staged"])

    sinks.write_parquet(staged_rows(spark, paths["staged"], "rejected"), paths["rejected"])
    staged = staged_rows(spark, paths["staged"], "clean")
    counters["clean_rows"] = publish_clean(staged, paths["clean_activity"])

    clean = spark.read.parquet(paths["clean_activity"])
    counters["hourly_rows"] = publish_hourly(clean, paths["hourly"])
    hourly = spark.read.parquet(paths["hourly"])
    counters["enriched_rows"] = publish_enriched(hourly, lookup, paths["enriched"])
    board = aggregate.dashboard(hourly, with_share=False)
    sinks.write_csv(board.orderBy("timestamp"), paths["dashboard"])

    failures = reconciliation_failures(counters)
    report = spark.range(1).select(
        *[F.lit(v).alias(k) for k, v in counters.items()], F.lit(not failures).alias("reconciled")
    )
    sinks.write_report(report, paths["report"])
    if failures:
        raise ValueError("; ".join(failures))
    return BatchResult("SUCCESS", counters, paths)


def reconciliation_failures(counters: dict[str, int]) -> list[str]:
    failures = []
    if counters["input_rows"] - counters["rejected_rows"] != counters["clean_rows"]:
        failures.append("input - rejected differs from clean rows")
    if counters["enriched_rows"] != counters["hourly_rows"]:
        failures.append("enrichment changed the row count")
    return failures


# --- single stages -----------------------------------------------------------


def ingest_stage(spark: SparkSession, landing_path: str, raw_path: str, audit_path: str) -> dict:
    """Landing gate: verdict per new file, audit records, accepted rows to the raw zone."""
    files = landing.named_like_contract(source.list_files(spark, landing_path))
    audit = _audit_or_empty(spark, audit_path)
    skipped = landing.skipped_files(files, audit)
    # names decide before anything is read; the driver lists the folder's files anyway
    new = [r["path"] for r in landing.new_files(files, audit).select("path").collect()]
    if not new:
        verdict = sinks.stage_table(skipped, "verdict")
        sinks.append_audit(landing.audit_records(verdict), audit_path)
        return landing.landing_summary(verdict).first().asDict()
    rows, headers = source.read_landing(spark, new)
    headers = sinks.stage_table(headers, "headers")
    judged = landing.landing_verdict(rows, headers)
    verdict = sinks.stage_table(judged.unionByName(skipped), "verdict")
    # Raw rows first, one folder per file, so a repeat after a failure replaces them.
    (
        landing.accepted_rows(rows, verdict)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("file_name")
        .parquet(raw_path)
    )
    sinks.append_audit(landing.audit_records(verdict), audit_path)
    return landing.landing_summary(verdict).first().asDict()


def _audit_or_empty(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return spark.createDataFrame([], AUDIT_SCHEMA)
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)


def storage_stage(clean: DataFrame, hourly: DataFrame, path: str, every: bool = False) -> DataFrame:
    """Write clean and hourly tables and return the round-trip checks of both (``every`` as there)."""
    spark = clean.sparkSession
    sinks.write_by_date(clean, f"{path}/clean_activity")
    sinks.write_by_date(hourly, f"{path}/hourly")
    sinks.write_csv(aggregate.dashboard(hourly).orderBy("timestamp"), f"{path}/dashboard")
    again_clean = spark.read.parquet(f"{path}/clean_activity")
    again_hourly = spark.read.parquet(f"{path}/hourly")
    keys = ["date", "timestamp", "grid_id"]
    checks = quality.roundtrip_checks(again_clean, clean, keys + ["country_code"], every)
    return checks.withColumn("table", F.lit("clean_activity")).unionByName(
        quality.roundtrip_checks(again_hourly, hourly, keys, every).withColumn("table", F.lit("hourly"))
    )


def usage_job(raw: DataFrame, output_path: str | None = None) -> dict[str, DataFrame]:
    """One batch of raw rows to hourly, daily and cell summaries (bad rows raise)."""
    clean = cleaning.clean_or_raise(source.to_canonical(raw))
    hourly = aggregate.grid_hour(clean)
    if output_path is not None:
        sinks.write_parquet(hourly, f"{output_path}/hourly")
        hourly = raw.sparkSession.read.parquet(f"{output_path}/hourly")
    out = {
        "hourly": hourly,
        "daily_summary": aggregate.daily_summary(hourly),
        "grid_summary": aggregate.grid_summary(hourly),
    }
    if output_path is not None:
        for name, df in out.items():
            sinks.write_csv(df, f"{output_path}/csv/{name}")
    return out

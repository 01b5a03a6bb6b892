"""Writers. All are distributed writes; none collects rows on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.schemas import INSERT_BATCH
from gridpulse.session import scratch_dir


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_date(df: DataFrame, path: str, tasks: int | None = None) -> None:
    """Date-partitioned Parquet, sorted by cell inside each file for min/max skipping.

    By default the rows are rebalanced by date: adaptive execution splits a
    heavy day over as many tasks as its bytes need and merges light days, so
    files come out near the advisory size at any scale. ``tasks`` fixes a plain
    hash layout instead. Dynamic overwrite replaces only the dates present.
    """
    laid = df.hint("rebalance", F.col("date")) if tasks is None else df.repartition(tasks, "date")
    (
        laid.sortWithinPartitions("date", "grid_id", "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    Cuts the lineage like a checkpoint and survives lost executors. The table
    lies in the application's scratch folder.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("timestampFormat", timestamp_format)
        .option("timestampNTZFormat", timestamp_format)
        .csv(path)
    )


def write_report(metrics: DataFrame, path: str) -> None:
    """Metrics rows as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def append_audit(records: DataFrame, path: str) -> None:
    """Append to the ingestion audit log."""
    records.write.mode("append").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Parallel batched inserts, one connection per partition."""
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table)
    writer.option("batchsize", INSERT_BATCH).options(**options).mode(mode).save()

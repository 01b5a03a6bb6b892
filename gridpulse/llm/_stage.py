"""Staged tables in the shared folder and connected components over them."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.session import scratch_dir


#: Rows of an Arrow batch: documents are long, and a batch is held by Spark and by the worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the application's scratch folder, which lies in the shared one and goes when the driver ends."""
    return f"{scratch_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def file_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a place in the shared folder, for tasks that write or read files of their own there."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it again: cuts the lineage and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    ``edges`` has the columns a, b (links in either direction; null ends and
    loops are left out). Alternates large-star and small-star steps until
    every node has one parent at most and no parent has one: each component is
    a star then, and the table of minima holds the answer. Minima combine
    before the shuffle and are written before they are joined, so that a hub's
    links can be split.
    """
    up = F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")
    now = stage(edges.where("a <> b").select(*up).distinct(), name)
    while True:
        least = stage(
            now.select(F.col("parent").alias("node"), "parent", F.lit(0).alias("up"))
            .unionByName(now.select(F.col("child").alias("node"), "parent", F.lit(1).alias("up")))
            .groupBy("node").agg(F.min("parent").alias("low"), F.sum("up").alias("parents"), F.min("up").alias("up")),
            name,
        )
        if least.where("parents > 1 or parents = 1 and up = 0").isEmpty():
            break
        large = stage(
            now.join(least, F.col("parent") == F.col("node")).select("child", F.col("low").alias("parent")), name
        )
        low = stage(large.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("low")), name)
        joined = large.join(low, F.col("child") == F.col("node"))
        last, now = now, stage(
            joined.where("parent <> low").select(F.col("parent").alias("child"), F.col("low").alias("parent"))
            .unionByName(low.select(F.col("node").alias("child"), F.col("low").alias("parent")))
            .distinct(),
            name,
        )
        discard(last, least, large, low)
    discard(now)
    return least.select("node", F.col("low").alias("component"))

"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
from functools import cache

from pyspark.sql import SparkSession


def build_session(app: str = "gridpulse", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; partition counts are left to it.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from
    spark-submit; ``conf`` only adds to that.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="gridpulse-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting (tests) falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder()


_OWNED: dict[str, object] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediates in the shared folder.

    ``remove_scratch`` deletes it, at the latest when the driver ends, so
    staged tables do not outlive the application that reads them.
    """
    context = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/gridpulse-{context.applicationId}"
    if path not in _OWNED:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        _OWNED[path] = (at.getFileSystem(context._jsc.hadoopConfiguration()), at)
        atexit.register(_remove, path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Delete all intermediates of this application; frames that read them fail afterwards."""
    _remove(scratch_dir(spark))


def _remove(path: str) -> None:
    fs, at = _OWNED.pop(path, (None, None))
    if fs is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone when the driver ends
            fs.delete(at, True)

"""Tables as versions: data folders that never move and one manifest per version.

A commit writes its rows to a new folder and then publishes a manifest that
lists the folders of the whole table, by key (a date) or as one. The
manifest is written aside and renamed to the next number, which fails if the
number is taken; so readers see a version whole or not at all, a writer that
dies leaves the table as it was, and of two writers that start from the same
version the second is refused. The rename needs a file system that refuses
to replace a file (HDFS and local ones do).
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = ""
_PART = "_part"
_MANIFEST = re.compile(r"(\d{20})\.json")


class ConcurrentCommit(RuntimeError):
    """Another writer has published a version meanwhile."""


@dataclass(frozen=True)
class Version:
    """``folders`` by key, relative to the table; ``source`` is the version of the table it was derived from."""

    number: int
    schema: dict
    folders: dict[str, str] = field(default_factory=dict)
    source: int | None = None


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, modification time in ms) of the entries of a folder, none if it does not exist."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at)]


def numbers(spark: SparkSession, path: str) -> list[int]:
    found = (_MANIFEST.fullmatch(name) for name, _ in _names(spark, f"{path}/_versions"))
    return sorted(int(m[1]) for m in found if m)


def version(spark: SparkSession, path: str, number: int) -> Version:
    fs, at = _fs(spark, f"{path}/_versions/{number:020d}.json")
    stream = fs.open(at)
    try:
        return Version(**json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> Version | None:
    held = numbers(spark, path)
    return version(spark, path, held[-1]) if held else None


def read(spark: SparkSession, path: str, keys: Iterable[str] | None = None, number: int | None = None) -> DataFrame:
    """A version (the latest by default), or only the folders of some keys; keys it has not are empty."""
    found = latest(spark, path) if number is None else version(spark, path, number)
    if found is None:
        raise FileNotFoundError(f"no version of {path}")
    schema = T.StructType.fromJson(found.schema)
    wanted = found.folders if keys is None else {k: found.folders[k] for k in sorted(set(keys) & set(found.folders))}
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{folder}" for folder in wanted.values()))


def changed(spark: SparkSession, path: str, since: int | None) -> set[str]:
    """Keys whose rows the latest version does not share with version ``since`` (all if None)."""
    now = latest(spark, path)
    now = now.folders if now else {}
    before = version(spark, path, since).folders if since is not None else {}
    return {k for k in now.keys() | before.keys() if now.get(k) != before.get(k)}


def _publish(spark: SparkSession, path: str, made: Version) -> None:
    fs, aside = _fs(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(asdict(made)).encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    _, target = _fs(spark, f"{path}/_versions/{made.number:020d}.json")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(fs.makeQualified(aside), fs.makeQualified(target), no_options)
    except Exception as error:
        fs.delete(aside, False)
        if fs.exists(target):
            raise ConcurrentCommit(f"version {made.number} of {path} exists") from error
        raise


def commit(
    df: DataFrame,
    path: str,
    key: str | None = None,
    touched: Iterable[str] | None = None,
    base: int | None = None,
    source: int | None = None,
) -> Version:
    """Write ``df`` and publish the next version.

    Without ``key`` the version is ``df``. With ``key`` (a column whose text
    is the key, not null) ``df`` holds the rows of the keys ``touched``: these
    are replaced, also by nothing, and all other keys keep their folders;
    without ``touched`` all keys are replaced. ``base`` is the version that
    ``df`` was made from (the latest by default); if another has been
    published since, nothing is, and ConcurrentCommit is raised. ``df`` may
    read the table it is committed to.
    """
    spark = df.sparkSession
    held = latest(spark, path)
    if base is not None and (held.number if held else 0) != base:
        raise ConcurrentCommit(f"{path} is at another version than {base}")
    folder = f"data/{uuid.uuid4().hex}"
    schema = df.schema.jsonValue()
    if key is None:
        df.write.parquet(f"{path}/{folder}")
        folders = {WHOLE: folder}
    else:
        text = F.col(key).cast("string")
        keyed = df.withColumn(_PART, F.when(F.assert_true(text.isNotNull(), f"null {key}").isNull(), text))
        keyed.hint("rebalance", F.col(_PART)).write.partitionBy(_PART).parquet(f"{path}/{folder}")
        made = {n.removeprefix(f"{_PART}="): f"{folder}/{n}" for n, _ in _names(spark, f"{path}/{folder}") if n.startswith(f"{_PART}=")}
        gone = None if touched is None else set(touched)
        if gone is not None and not set(made) <= gone:
            raise ValueError(f"rows of keys that are not touched: {sorted(set(made) - gone)[:5]}")
        kept = {k: f for k, f in held.folders.items() if k not in gone} if held and gone is not None else {}
        folders = kept | made
    out = Version((held.number if held else 0) + 1, schema, folders, source)
    _publish(spark, path, out)
    return out


def sweep(spark: SparkSession, path: str, keep: int = 2, idle: float = 86_400.0) -> list[str]:
    """Delete all versions but the last ``keep``, and data folders that none of these names; returns the folders.

    Folders written to in the last ``idle`` seconds stay, as a writer may not have published them yet.
    """
    held = numbers(spark, path)
    stay = held[-max(keep, 1) :]
    named = {f.split("/")[1] for n in stay for f in version(spark, path, n).folders.values()}
    for n in held[: len(held) - len(stay)]:
        fs, at = _fs(spark, f"{path}/_versions/{n:020d}.json")
        fs.delete(at, False)
    oldest = (time.time() - idle) * 1000
    gone = [name for name, at in _names(spark, f"{path}/data") if name not in named and at <= oldest]
    for name in gone:
        fs, at = _fs(spark, f"{path}/data/{name}")
        fs.delete(at, True)
    return sorted(gone)

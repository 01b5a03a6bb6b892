"""Activity readers: typed CSV, all-text CSV, landing lines, Parquet, event stream table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpulse.functions import times
from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.schemas import (
    FILE_GLOB,
    RAW_COLUMNS,
    RAW_SCHEMA,
    RAW_TEXT_SCHEMA,
    RAW_TO_CANONICAL,
)

# Which event type feeds which measure.
EVENT_CHANNELS = {
    "click": "sms_in",
    "view": "sms_out",
    "signup": "call_in",
    "purchase": "call_out",
    "error": "internet_activity",
}


def _with_file(df: DataFrame, name: str) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias(name))


def stream_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table as a file stream, whether it is one file or a folder of parts."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())


def _read_csv(
    spark: SparkSession, path: str, glob: str, schema: T.StructType, file_column: str
) -> DataFrame:
    """Files read by the names in their header, whatever the order of the columns.

    Missing columns raise before any data is read. The order is that of one
    file's first line; a file whose header differs from it fails the read.
    """
    reader = spark.read.option("header", True).option("pathGlobFilter", glob)
    present = reader.csv(path).columns
    missing = [c for c in schema.fieldNames() if c not in present]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    known = {f.name: f for f in schema.fields}
    ordered = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in present])
    rows = reader.option("enforceSchema", False).schema(ordered).csv(path)
    return _with_file(rows, file_column).select(*schema.fieldNames(), file_column)


def read_typed_csv(
    spark: SparkSession, path: str, glob: str = FILE_GLOB, file_column: str = "source_file"
) -> DataFrame:
    """Daily files with the declared types; no inference pass over the data."""
    return _read_csv(spark, path, glob, RAW_SCHEMA, file_column)


def read_text_csv(
    spark: SparkSession, path: str, glob: str = "*.csv", file_column: str = "input_file_name"
) -> DataFrame:
    """Every raw column as text; cast later with ``cleaning.cast_columns``."""
    return _read_csv(spark, path, glob, RAW_TEXT_SCHEMA, file_column)


def list_files(spark: SparkSession, path: str, glob: str = FILE_GLOB) -> DataFrame:
    """Input discovery as a frame (path, file_name, length); contents are pruned away."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    )


def require_files(spark: SparkSession, path: str, glob: str = FILE_GLOB) -> DataFrame:
    files = list_files(spark, path, glob)
    if files.isEmpty():
        raise FileNotFoundError(f"no input file matching {glob} in {path}")
    return files


def landing_lines(df: DataFrame) -> DataFrame:
    """Text-source rows (batch or stream) with file name, split offset and line order."""
    return df.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.regexp_replace("value", r"\r$", "").alias("line"),
    )


def parse_landing(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Landing lines to ``(rows, headers)``, each file read by its own header.

    Rows carry file_name, surplus_fields (fields beyond the header's) and the
    eight raw columns as text (NULL where the file or the line lacks the
    column; of a repeated column the first counts); headers carry file_name and
    the file's column list, so empty and malformed files keep a row.

    A file's header is its first line: the line of the split at offset 0 with
    the lowest id; only that line is no row. The per-file minimum combines
    map-side; the header frame (one row per file) is measured before it is
    broadcast to the line scan.
    """
    numbered = lines.withColumn("line_id", F.monotonically_increasing_id())
    headers = (
        numbered.filter(F.col("offset") == 0)
        .groupBy("file_name")
        .agg(F.min(F.struct("line_id", "line")).alias("first"))
        .select("file_name", F.col("first.line_id").alias("header_id"), "first.line")
        .select("file_name", "header_id", F.transform(F.split("line", ","), _unquote).alias("columns"))
    )
    fields = F.transform(F.split(F.col("line"), ",", -1), _unquote)

    def field(name: str) -> Column:
        place = F.array_position("columns", name).cast("int")
        return F.when(place > 0, F.nullif(F.get("fields", place - 1), F.lit(""))).alias(name)

    rows = (
        numbered.join(broadcast_if_small(headers), "file_name")
        .filter((F.col("line_id") != F.col("header_id")) & (F.trim("line") != ""))
        .withColumn("fields", fields)
        .select(
            "file_name",
            F.greatest(F.size("fields") - F.size("columns"), F.lit(0)).alias("surplus_fields"),
            *[field(c) for c in RAW_COLUMNS],
        )
    )
    return rows, headers.select("file_name", "columns")


def read_landing(
    spark: SparkSession, path: str | list[str], glob: str = FILE_GLOB
) -> tuple[DataFrame, DataFrame]:
    """``(rows, headers)`` of every file in the landing folder, or of the files given."""
    return parse_landing(landing_lines(spark.read.option("pathGlobFilter", glob).text(path)))


def _unquote(text):
    return F.trim(F.regexp_replace(text, '^\\s*"|"\\s*$', ""))


def to_canonical(df: DataFrame) -> DataFrame:
    """Rename the raw columns; any other column (provenance) is kept."""
    return df.withColumnsRenamed(RAW_TO_CANONICAL)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def events_as_activity(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical activity rows from an event table, plus the ``keep`` columns.

    One event is one row: its user is the grid cell, the ``k`` property the
    country code, and its value lands in the measure of its event type; the
    other four measures stay NULL.
    """
    return events.select(
        *keep,
        times.hour_floor(F.col("ts").cast("timestamp_ntz")).alias("timestamp"),
        (F.col("user_id") + 1).cast("int").alias("grid_id"),
        F.get_json_object("props", "$.k").cast("int").alias("country_code"),
        *[
            F.when(F.col("event_type") == kind, F.col("value")).alias(column)
            for kind, column in EVENT_CHANNELS.items()
        ],
    )

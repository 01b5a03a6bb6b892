"""Landing gate: accept or reject each daily file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.activity import whole_number
from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.schemas import AUDIT_SCHEMA, FILE_NAME_PATTERN, RAW_ACTIVITY, RAW_COLUMNS

# Audit reasons.
ACCEPTED_REASON = "File validated and routed to raw."
SKIPPED_REASON = "File with the same filename already exists in raw."
EMPTY_REASON = "File contains zero data rows."
UNREADABLE_REASON = "Unable to read CSV: lines with too many fields: "


def named_like_contract(files: DataFrame, column: str = "file_name") -> DataFrame:
    return files.filter(F.col(column).rlike(FILE_NAME_PATTERN))


def _unparsable(column: str, kind: str) -> Column:
    return F.expr(f"try_cast({column} as {kind})").isNull()


def _rules() -> list[tuple[str, Column, str]]:
    """(counter, predicate, reason prefix), in the order in which they decide."""
    rules = [
        ("bad_datetime", _unparsable("datetime", "timestamp_ntz"), "Invalid datetime values: "),
        ("bad_cell", whole_number("CellID").isNull(), "Invalid or missing CellID values: "),
        (
            "bad_country",
            whole_number("countrycode").isNull(),
            "Invalid or missing countrycode values: ",
        ),
    ]
    for c in RAW_ACTIVITY:
        rules += [
            (
                f"text_{c}",
                F.col(c).isNotNull() & _unparsable(c, "double"),
                f"Invalid non-numeric values in {c}: ",
            ),
            (
                f"negative_{c}",
                F.expr(f"try_cast({c} as double) < 0"),
                f"Negative activity values in {c}: ",
            ),
        ]
    return rules


def file_quality(rows: DataFrame) -> DataFrame:
    """Row and defect counts per file.

    Counters combine map-side, so a file holding most of the rows sends one
    partial row per task to its reducer.
    """
    if "surplus_fields" not in rows.columns:
        rows = rows.withColumn("surplus_fields", F.lit(0))
    return rows.groupBy("file_name").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("surplus_fields") > 0).alias("too_wide"),
        *[F.count_if(predicate).alias(name) for name, predicate, _ in _rules()],
    )


def landing_verdict(
    rows: DataFrame, headers: DataFrame | None = None, accepted: DataFrame | None = None
) -> DataFrame:
    """(filename, status, row_count, reason) per landing file; the first failing rule decides.

    ``headers`` (file_name, columns) adds the schema rule and keeps files
    without rows; ``accepted`` (filename) marks repeated deliveries SKIPPED.
    """
    verdict = file_quality(rows)
    wide = F.coalesce(F.col("too_wide") > 0, F.lit(False))
    unreadable = F.concat(F.lit(UNREADABLE_REASON), F.col("too_wide").cast("string"))
    reason = F.when(wide, unreadable).when(
        F.coalesce("row_count", F.lit(0)) == 0, F.lit(EMPTY_REASON)
    )
    if headers is not None:
        verdict = headers.join(verdict, "file_name", "left")
        expected = F.array(*[F.lit(c) for c in RAW_COLUMNS])
        missing = F.array_except(expected, "columns")
        quoted = F.transform(missing, lambda c: F.concat(F.lit("'"), c, F.lit("'")))
        text = F.concat(
            F.lit("Missing required columns: ["), F.array_join(quoted, ", "), F.lit("]")
        )
        schema_failed = F.size(missing) > 0
        reason = (
            F.when(schema_failed, text)
            .when(wide, unreadable)
            .when(F.coalesce("row_count", F.lit(0)) == 0, F.lit(EMPTY_REASON))
        )
        verdict = verdict.withColumn(
            "row_count", F.when(schema_failed, F.lit(0)).otherwise(F.col("row_count"))
        )
    reason = reduce(
        lambda chain, rule: chain.when(
            F.col(rule[0]) > 0, F.concat(F.lit(rule[2]), F.col(rule[0]).cast("string"))
        ),
        _rules(),
        reason,
    )
    verdict = verdict.withColumn("failure", reason)
    status = F.when(F.col("failure").isNotNull(), "REJECTED").otherwise("ACCEPTED")
    text = F.coalesce("failure", F.lit(ACCEPTED_REASON))
    count = F.when(wide, F.lit(0)).otherwise(F.coalesce("row_count", F.lit(0))).cast("long")
    if accepted is not None:
        known = accepted.select(F.col("filename").alias("file_name")).distinct()
        verdict = verdict.join(known.withColumn("seen", F.lit(True)), "file_name", "left")
        seen = F.col("seen").isNotNull()
        status = F.when(seen, "SKIPPED").otherwise(status)
        text = F.when(seen, SKIPPED_REASON).otherwise(text)
        count = F.when(seen, F.lit(0)).otherwise(count).cast("long")
    return verdict.select(
        F.col("file_name").alias("filename"),
        status.alias("status"),
        count.alias("row_count"),
        text.alias("reason"),
    )


def new_files(files: DataFrame, audit: DataFrame) -> DataFrame:
    """Files whose name was not accepted before."""
    accepted = audit.filter(F.col("status") == "ACCEPTED").select(
        F.col("filename").alias("file_name")
    )
    return files.join(accepted, "file_name", "left_anti")


def skipped_files(files: DataFrame, audit: DataFrame) -> DataFrame:
    """Verdict rows of the files whose name was accepted before; they are not opened."""
    accepted = audit.filter(F.col("status") == "ACCEPTED").select(
        F.col("filename").alias("file_name")
    )
    return files.join(accepted, "file_name", "left_semi").select(
        F.col("file_name").alias("filename"),
        F.lit("SKIPPED").alias("status"),
        F.lit(0).cast("long").alias("row_count"),
        F.lit(SKIPPED_REASON).alias("reason"),
    )


def landing_summary(verdict: DataFrame) -> DataFrame:
    status = F.col("status")
    return verdict.agg(
        F.count("*").alias("detected"),
        F.count_if(status == "ACCEPTED").alias("accepted"),
        F.count_if(status == "REJECTED").alias("rejected"),
        F.count_if(status == "SKIPPED").alias("skipped"),
    )


def audit_records(verdict: DataFrame) -> DataFrame:
    return verdict.withColumn("processed_at", F.current_timestamp()).select(
        *AUDIT_SCHEMA.fieldNames()
    )


def accepted_rows(rows: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of the accepted files only."""
    names = verdict.filter(F.col("status") == "ACCEPTED").select(
        F.col("filename").alias("file_name")
    )
    return rows.drop("surplus_fields").join(broadcast_if_small(names), "file_name", "left_semi")

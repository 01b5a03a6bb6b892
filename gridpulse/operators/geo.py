"""Geometry enrichment and its coverage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.functions import geometry as geom
from gridpulse.functions.checks import check_rows, require_columns, zero
from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.operators.quality import out_of_grid
from gridpulse.schemas import ENRICHED_COLUMNS, EXPECTED_GRIDS


def enrich(df: DataFrame, lookup: DataFrame, hint: str | None = "broadcast") -> DataFrame:
    """Left join to the cell geometry; the row count does not change.

    The lookup holds one row per cell id and is broadcast after its size is
    measured. ``hint`` may name another strategy ("merge", "shuffle_hash") or
    be None to leave the choice to the optimizer.
    """
    require_columns(lookup, ["grid_id", "geometry"])
    dim = lookup.dropDuplicates(["grid_id"])
    if hint == "broadcast":
        dim = broadcast_if_small(dim)
    elif hint:
        dim = dim.hint(hint)
    return df.join(dim, "grid_id", "left")


def add_centroid(df: DataFrame, drop_closing: bool = False) -> DataFrame:
    return df.withColumn("centroid", geom.centroid_text(F.col("geometry"), drop_closing))


def enriched_contract(df: DataFrame) -> DataFrame:
    return df.select(*ENRICHED_COLUMNS)


def coverage(enriched: DataFrame) -> DataFrame:
    """One row: cells with activity, matched, unmatched, percentage.

    Grouped by cell first, so the geometry text never takes part in a distinct.
    """
    return _coverage(enriched).drop("rows")


def _coverage(enriched: DataFrame) -> DataFrame:
    """``coverage`` with the number of rows, from the same aggregate."""
    cells = enriched.groupBy("grid_id").agg(
        F.max(F.col("geometry").isNotNull()).alias("matched"), F.count("*").alias("n")
    )
    stats = cells.agg(
        F.count("*").alias("activity_grids"),
        F.count_if("matched").alias("matched_grids"),
        F.count_if(~F.col("matched")).alias("unmatched_grids"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    )
    percent = F.coalesce(
        F.try_divide(F.col("matched_grids") * 100.0, F.col("activity_grids")), F.lit(0.0)
    )
    return stats.withColumn("coverage_percentage", percent)


def unmatched_grids(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Cells with activity but without geometry."""
    known = lookup.filter(F.col("geometry").isNotNull()).select("grid_id")
    return df.select("grid_id").distinct().join(known, "grid_id", "left_anti")


def spot_check(lookup: DataFrame, grid_ids: list[int]) -> DataFrame:
    """Centroids of chosen cells."""
    return lookup.filter(F.col("grid_id").isin(grid_ids)).select(
        "grid_id", geom.centroid_text(F.col("geometry")).alias("centroid")
    )


def top_grids(hourly: DataFrame, lookup: DataFrame, limit: int = 10) -> DataFrame:
    """Busiest cells with geometry; the join happens after the limit."""
    totals = hourly.groupBy("grid_id").agg(F.sum("total_activity").alias("total_activity"))
    top = totals.orderBy(F.desc("total_activity"), F.asc("grid_id")).limit(limit)
    dim = broadcast_if_small(lookup.dropDuplicates(["grid_id"]))
    return (
        top.join(dim, "grid_id", "left")
        .select("grid_id", "geometry", "total_activity")
        .orderBy(F.desc("total_activity"), F.asc("grid_id"))
    )


def acceptance(
    hourly: DataFrame, enriched: DataFrame, lookup: DataFrame, expected: int = EXPECTED_GRIDS
) -> DataFrame:
    """Enrichment acceptance as check rows."""
    ref = lookup.agg(
        F.count("*").alias("n"),
        F.count_distinct("grid_id").alias("ids"),
        F.count_if(out_of_grid()).alias("bad"),
        F.count_if(F.col("geometry").isNull()).alias("no_geometry"),
    )
    figures = F.struct("rows", "coverage_percentage", "unmatched_grids").alias("cover")
    stats = (
        ref.withColumn("hourly_rows", hourly.agg(F.count("*").alias("n")).scalar())
        .withColumn("cover", _coverage(enriched).select(figures).scalar())
        .select(
            "*", F.col("cover.rows").alias("enriched_rows"), F.col("cover.coverage_percentage").alias("percent"),
            F.col("cover.unmatched_grids").alias("unmatched"),
        )
    )
    return check_rows(
        stats,
        {
            "reference_rows": (F.col("n"), F.col("n") == expected),
            "reference_ids": (F.col("ids"), F.col("ids") == expected),
            "reference_out_of_range": zero("bad"),
            "reference_without_geometry": zero("no_geometry"),
            "row_count_preserved": (
                F.col("enriched_rows"),
                F.col("enriched_rows") == F.col("hourly_rows"),
            ),
            "coverage_percentage": (F.col("percent"), F.col("percent") == 100.0),
            "unmatched_grids": zero("unmatched"),
        },
    )

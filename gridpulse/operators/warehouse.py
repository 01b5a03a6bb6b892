"""Star schema: time and grid dimensions, activity fact, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions import geometry as geom
from gridpulse.functions.checks import check_rows, require_columns, zero
from gridpulse.functions.sizing import broadcast_if_small
from gridpulse.functions.times import add_time_features, time_key
from gridpulse.schemas import DIM_GRID_COLUMNS, DIM_TIME_COLUMNS, FACT_COLUMNS, MEASURES


def dim_time(rows: DataFrame) -> DataFrame:
    """One row per distinct hour of any frame with a ``timestamp``."""
    stamps = rows.select("timestamp").distinct()
    return (
        add_time_features(stamps)
        .withColumn("time_key", time_key(F.col("timestamp")))
        .select(*DIM_TIME_COLUMNS)
    )


def dim_grid(lookup: DataFrame) -> DataFrame:
    """One row per cell; grid_key equals grid_id."""
    shape = F.col("geometry")
    return lookup.select(
        F.col("grid_id").alias("grid_key"),
        "grid_id",
        geom.latitude(shape).alias("latitude"),
        geom.longitude(shape).alias("longitude"),
        shape.alias("geometry_reference"),
    ).select(*DIM_GRID_COLUMNS)


def fact(hourly: DataFrame, times: DataFrame, grids: DataFrame) -> DataFrame:
    """Hourly rows with their dimension keys; both key lookups are measured, then broadcast."""
    require_columns(hourly, ["timestamp", "grid_id", *MEASURES])
    time_keys = broadcast_if_small(times.select("time_key", "timestamp"))
    grid_keys = broadcast_if_small(grids.select("grid_key", "grid_id"))
    joined = hourly.join(time_keys, "timestamp").join(grid_keys, "grid_id")
    return joined.select(*FACT_COLUMNS)


def star(facts: DataFrame, times: DataFrame, grids: DataFrame) -> DataFrame:
    """Fact rows with their cell id and time attributes; the source of the service queries."""
    time_dim = broadcast_if_small(times)
    grid_dim = broadcast_if_small(grids.select("grid_key", "grid_id"))
    return (
        facts.join(time_dim, "time_key")
        .join(grid_dim, "grid_key")
        .select("grid_id", "timestamp", "date", "hour", *MEASURES)
    )


def star_checks(
    hourly: DataFrame, facts: DataFrame, times: DataFrame, grids: DataFrame,
    expected_grids: int | None = None,
) -> DataFrame:
    """Counts, key uniqueness, orphans and geometry-free fact as check rows.

    One aggregate per table: the fact is grouped by its keys and looks up the
    dimensions' keys; the other figures join it as one-row subqueries.
    """
    in_time = broadcast_if_small(times.select("time_key", F.lit(True).alias("timed")).dropDuplicates(["time_key"]))
    in_grid = broadcast_if_small(grids.select("grid_key", F.lit(True).alias("placed")).dropDuplicates(["grid_key"]))
    keys = facts.groupBy("time_key", "grid_key").agg(F.count("*").alias("n"))
    placed = keys.join(in_time, "time_key", "left").join(in_grid, "grid_key", "left")

    def orphans(found: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(found).isNull(), F.col("n"))), F.lit(0))

    def counted(df: DataFrame, key: str) -> Column:
        per_key = df.groupBy(key).agg(F.count("*").alias("n"))
        rows = F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
        return per_key.agg(F.struct(rows, F.count_if(F.col("n") > 1).alias("dups")).alias("s")).scalar()

    source = hourly.agg(F.struct(F.count("*").alias("rows"), F.count_distinct("timestamp").alias("hours")).alias("s")).scalar()
    geometry = int(any(c.startswith("geometry") for c in facts.columns))
    stats = (
        placed.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count_if(F.col("n") > 1).alias("fact_dups"),
            orphans("timed").alias("time_orphans"),
            orphans("placed").alias("grid_orphans"),
        )
        .withColumns({"source": source, "time": counted(times, "time_key"), "grid": counted(grids, "grid_id")})
        .select(
            "*", F.col("source.rows").alias("source_rows"), F.col("source.hours").alias("source_hours"),
            F.col("time.rows").alias("times"), F.col("time.dups").alias("time_dups"),
            F.col("grid.rows").alias("grids"), F.col("grid.dups").alias("grid_dups"),
        )
    )
    grid_total = F.col("grids") if expected_grids is None else F.lit(expected_grids)
    return check_rows(
        stats,
        {
            "fact_rows": (F.col("rows"), F.col("rows") == F.col("source_rows")),
            "dim_time_rows": (F.col("times"), F.col("times") == F.col("source_hours")),
            "dim_grid_rows": (F.col("grids"), F.col("grids") == grid_total),
            "duplicate_fact_keys": zero("fact_dups"),
            "duplicate_time_keys": zero("time_dups"),
            "duplicate_grid_ids": zero("grid_dups"),
            "orphan_time_keys": zero("time_orphans"),
            "orphan_grid_keys": zero("grid_orphans"),
            "geometry_in_fact": (F.lit(geometry), F.lit(geometry == 0)),
        },
    )

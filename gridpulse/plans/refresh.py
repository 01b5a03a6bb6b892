"""Derived tables kept up to date by the days that changed.

Tables are versioned by date. Each version of a derived table names the
version of its source, so what changed since is the difference of two
manifests: no table is searched for it, untouched days are not read, and a
run that failed half-way is completed by the next. Days are replaced whole,
as a corrected daily file replaces the one before.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.operators import aggregate, snapshots
from gridpulse.sources import versions

#: Tables by date derived from the hourly rows of the same date.
BY_DATE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "daily_traffic": aggregate.daily_traffic,
    "daily_summary": aggregate.daily_summary,
    "dashboard": lambda hourly: aggregate.dashboard(hourly).withColumn("date", F.to_date("timestamp")),
    "cell_days": snapshots.cell_days,
    "network_days": snapshots.network_days,
}


def load_days(clean: DataFrame, path: str, decimals: int | None = None) -> set[str]:
    """Replace the hourly rows of the dates that ``clean`` holds; returns these dates."""
    hourly = aggregate.grid_hour(clean, decimals=decimals)
    spark = clean.sparkSession
    before = versions.latest(spark, f"{path}/hourly")
    touched = {str(r["date"]) for r in clean.select("date").distinct().collect()}  # as many as the calendar has
    versions.commit(hourly, f"{path}/hourly", "date", touched)
    return versions.changed(spark, f"{path}/hourly", before.number if before else None)


def _since(spark: SparkSession, target: str) -> int | None:
    held = versions.latest(spark, target)
    return held.source if held else None


def refresh(spark: SparkSession, path: str) -> dict[str, set[str]]:
    """Bring all derived tables to the latest hourly version; returns the dates recomputed for each."""
    source = f"{path}/hourly"
    now = versions.latest(spark, source).number
    done = {}
    for name, derive in BY_DATE.items():
        target = f"{path}/{name}"
        touched = versions.changed(spark, source, _since(spark, target))
        if touched:
            versions.commit(derive(versions.read(spark, source, touched, now)), target, "date", touched, source=now)
        done[name] = touched
    done["cells"] = _refresh_cells(spark, path)
    done["cell_snapshots"] = _refresh_snapshots(spark, path)
    return done


def _refresh_cells(spark: SparkSession, path: str) -> set[str]:
    """Totals per cell: what changed days held is taken away, what they hold now is added."""
    days, target = f"{path}/cell_days", f"{path}/cells"
    since, now = _since(spark, target), versions.latest(spark, days).number
    touched = versions.changed(spark, days, since)
    if not touched:
        return touched
    columns = [*snapshots.SUMS, "active_hours"]
    parts = versions.read(spark, days, touched, now).select("grid_id", *columns)
    if since is not None:
        old = versions.read(spark, days, touched, since).select("grid_id", *[(-F.col(c)).alias(c) for c in columns])
        parts = parts.unionByName(old).unionByName(versions.read(spark, target).select("grid_id", *columns))
    sums = [F.sum(c).cast(snapshots.EXACT).alias(c) for c in snapshots.SUMS]
    cells = parts.groupBy("grid_id").agg(*sums, F.sum("active_hours").alias("active_hours")).filter("active_hours > 0")
    versions.commit(cells, target, source=now)
    return touched


def _refresh_snapshots(spark: SparkSession, path: str) -> set[str]:
    """Cumulative snapshots from the first changed day on, starting from the one before it."""
    days, target = f"{path}/cell_days", f"{path}/cell_snapshots"
    now = versions.latest(spark, days)
    touched = versions.changed(spark, days, _since(spark, target))
    if not touched:
        return touched
    held = versions.latest(spark, target)
    first = min(touched)
    earlier = [d for d in (held.folders if held else ()) if d < first]
    later = sorted(d for d in now.folders if d >= first)
    replaced = set(later) | {d for d in (held.folders if held else ()) if d >= first}

    def before(name: str, empty: DataFrame) -> DataFrame:
        return versions.read(spark, f"{path}/{name}", [max(earlier)]) if earlier else empty

    cell_rows = versions.read(spark, days, later, now.number)
    base = before("cell_snapshots", cell_rows.limit(0))
    dates = [date.fromisoformat(d) for d in later]
    network_rows = versions.read(spark, f"{path}/network_days", later)
    network = snapshots.network_snapshots(network_rows, before("network_snapshots", network_rows.limit(0)))
    versions.commit(network, f"{path}/network_snapshots", "date", replaced)
    versions.commit(snapshots.cell_snapshots(cell_rows, base, dates), target, "date", replaced, source=now.number)
    return replaced


def network_summary_at(spark: SparkSession, path: str, as_of: datetime) -> DataFrame:
    """The network summary at a cutoff: the snapshot of the last date before its day, and that day."""
    day = str(as_of.date())
    earlier = [d for d in versions.latest(spark, f"{path}/cell_snapshots").folders if d < day]
    last = [max(earlier)] if earlier else []
    return snapshots.network_summary_at(
        versions.read(spark, f"{path}/cell_snapshots", last),
        versions.read(spark, f"{path}/network_snapshots", last),
        versions.read(spark, f"{path}/hourly", [day]),
        as_of,
    )

"""GeoJSON geometry text without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def outer_ring(geometry: Column) -> Column:
    """Outer ring of a Polygon, or of the first part of a MultiPolygon; else NULL."""
    kind = F.get_json_object(geometry, "$.type")
    coordinates = F.get_json_object(geometry, "$.coordinates")
    polygon = F.from_json(coordinates, _POLYGON)
    multi = F.from_json(coordinates, _MULTI)
    ring = F.when(kind == "Polygon", F.get(polygon, 0)).when(
        kind == "MultiPolygon", F.get(F.get(multi, 0), 0)
    )
    return F.filter(ring, lambda p: F.size(p) >= 2)


def vertex_mean(geometry: Column, axis: int, drop_closing: bool = False) -> Column:
    """Mean of one coordinate over the ring's vertices.

    The repeated closing vertex counts by default, which puts the centroid of
    a unit square at 0.4; ``drop_closing`` leaves it out.
    """
    ring = outer_ring(geometry)
    if drop_closing:
        ring = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))
    total = F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + F.get(p, axis))
    return F.when(F.size(ring) > 0, total / F.size(ring))


def longitude(geometry: Column, drop_closing: bool = False) -> Column:
    return vertex_mean(geometry, 0, drop_closing)


def latitude(geometry: Column, drop_closing: bool = False) -> Column:
    return vertex_mean(geometry, 1, drop_closing)


def centroid_text(geometry: Column, drop_closing: bool = False) -> Column:
    """`lon,lat` with 6 decimals; NULL for missing or unsupported geometry."""
    lon, lat = longitude(geometry, drop_closing), latitude(geometry, drop_closing)
    text = F.format_string("%.6f,%.6f", lon, lat)
    return F.when(lon.isNotNull() & lat.isNotNull(), text)

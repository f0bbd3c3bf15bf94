"""Distances and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEAN_RADIUS_M = 6371008.8  # address completion and duplicate matching
ROUND_RADIUS_M = 6371000.0  # name matching


def _finite(value: Column) -> Column:
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(~bad, value)


def distance_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, radius: float = MEAN_RADIUS_M) -> Column:
    """Haversine distance, NULL when a coordinate is missing or not finite."""
    la, oa, lb, ob = (F.radians(_finite(c)) for c in (lat_a, lon_a, lat_b, lon_b))
    half = lambda x: F.sin(x / 2) * F.sin(x / 2)
    h = half(lb - la) + F.cos(la) * F.cos(lb) * half(ob - oa)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


# 30 m is at most 0.00028 degrees of latitude; of longitude, 0.0006 up to 63
# degrees north or south.  Cells are larger than that in both axes.
LAT_CELL_30M = 0.0003
LON_CELL_30M = 0.0006


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def neighbour_cells(lat: Column, lon: Column, lat_size: float, lon_size: float) -> Column:
    """The 3 x 3 cells around a point, as an array of struct(cy, cx)."""
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return F.array(
        *[
            F.struct((cell(lat, lat_size) + dy).alias("cy"), (cell(lon, lon_size) + dx).alias("cx"))
            for dy, dx in steps
        ]
    )


def home_cell(lat: Column, lon: Column, lat_size: float, lon_size: float) -> Column:
    return F.struct(cell(lat, lat_size).alias("cy"), cell(lon, lon_size).alias("cx"))

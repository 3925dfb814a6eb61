"""Coordinates and distances as Column factories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6_371_000.0


def local_xy(nodes: DataFrame, *, lon="x_udeg", lat="y_udeg", whole: bool = True) -> DataFrame:
    """nodes with x, y: metres about the mean of all coordinates, rounded to whole metres on demand."""
    mean = nodes.agg(F.avg(lon).alias("_lon0"), F.avg(lat).alias("_lat0"))
    own = nodes.crossJoin(F.broadcast(mean))  # one row
    rad = lambda c: F.radians(F.col(c) / 1e6)
    x = RADIUS * F.cos(rad("_lat0")) * (rad(lon) - rad("_lon0"))
    y = RADIUS * (rad(lat) - rad("_lat0"))
    if whole:
        x, y = F.rint(x).cast("int"), F.rint(y).cast("int")
    return own.select(*nodes.columns, x.alias("x"), y.alias("y"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres between points in microdegrees."""
    f1, f2 = F.radians(lat1 / 1e6), F.radians(lat2 / 1e6)
    turn = F.radians(lon2 / 1e6) - F.radians(lon1 / 1e6)
    part = 0.5 - F.cos(f2 - f1) / 2 + F.cos(f1) * F.cos(f2) * (1 - F.cos(turn)) / 2
    return 2 * RADIUS * F.asin(F.sqrt(part))


def haversine_dm(*points: Column) -> Column:
    return F.floor(10 * haversine_m(*points))


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def euclid_int(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whole metres, rounded down; 64-bit throughout."""
    dx, dy = x1.cast("long") - x2.cast("long"), y1.cast("long") - y2.cast("long")
    return F.floor(F.sqrt((dx * dx + dy * dy).cast("double")))

"""Coordinates and attitude: geographic to local metres and back, quaternions to angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapframe.functions.nulls import col

EARTH_RADIUS_M = 6378137.0


def to_local(lat: Column | str, lon: Column | str, origin: tuple[float, float]) -> tuple[Column, Column]:
    """(x, y) in metres east and north of ``origin`` (latitude, longitude in degrees), on a plane that touches it."""
    lat0, lon0 = origin
    x = F.radians(col(lon) - F.lit(lon0)) * F.lit(EARTH_RADIUS_M * math.cos(math.radians(lat0)))
    y = F.radians(col(lat) - F.lit(lat0)) * F.lit(EARTH_RADIUS_M)
    return x, y


def to_geographic(x: Column | str, y: Column | str, origin: tuple[float, float]) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees; the inverse of :func:`to_local`. The origin is checked on the driver."""
    lat0, lon0 = origin
    if not (math.isfinite(lat0) and math.isfinite(lon0)):
        raise ValueError("origin must be finite")
    if not -90 < lat0 < 90:
        raise ValueError("origin latitude must lie between the poles")
    if not -180 <= lon0 <= 180:
        raise ValueError("origin longitude must lie within 180 degrees")
    lat = F.lit(lat0) + F.degrees(col(y) / F.lit(EARTH_RADIUS_M))
    lon = F.lit(lon0) + F.degrees(col(x) / F.lit(EARTH_RADIUS_M * math.cos(math.radians(lat0))))
    return lat, lon


def checked_geographic(lat: Column, lon: Column) -> Column:
    """True where a result is a valid place; raises for one beyond the poles or the antimeridian."""
    good = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.when(lat.isNull() | lon.isNull() | good, F.lit(True)).otherwise(F.raise_error("trajectory leaves the valid range of latitude or longitude").cast("boolean"))


def quaternion_angles(x: Column | str, y: Column | str, z: Column | str, w: Column | str) -> tuple[Column, Column, Column]:
    """(roll, pitch, yaw) in radians of a quaternion, normalised first; NULL for a zero quaternion."""
    x, y, z, w = col(x), col(y), col(z), col(w)
    norm = F.nullif(F.sqrt(x * x + y * y + z * z + w * w), F.lit(0.0))
    x, y, z, w = x / norm, y / norm, z / norm, w / norm
    roll = F.atan2(2.0 * (w * x + y * z), 1.0 - 2.0 * (x * x + y * y))
    lean = 2.0 * (w * y - z * x)
    pitch = F.asin(F.when(lean.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), lean))))
    yaw = F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))
    return roll, pitch, yaw

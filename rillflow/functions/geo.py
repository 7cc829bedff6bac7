"""Positions on a sphere, as column expressions.  Latitude and longitude in degrees, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_000.0


def _chord(degrees: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.cos(F.radians(degrees)))))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Chord length from the differences of both angles."""
    return RADIUS * F.sqrt(F.pow(_chord(lat2 - lat1), 2) + F.pow(_chord(lon2 - lon1), 2))


def move(lat: Column, lon: Column, dlat: Column, dlon: Column, metres: Column) -> tuple[Column, Column]:
    """The position so many metres along a direction; a zero direction doesn't move."""
    norm = F.sqrt(dlat * dlat + dlon * dlon)
    step = F.coalesce(F.try_divide(metres * F.lit(180.0 / 3.141592653589793 / RADIUS), norm), F.lit(0.0))
    return lat + dlat * step, lon + dlon * step


def parse_position(line: Column) -> Column:
    """``lat\\tlon\\tts`` -> struct; of more than three fields the last three; null if malformed."""
    parts = F.split(line, "\t")
    last = F.slice(parts, -3, 3)
    lat, lon, ts = (F.get(last, F.lit(i)) for i in range(3))
    lat, lon, ts = lat.try_cast("double"), lon.try_cast("double"), ts.try_cast("long")
    ok = (F.size(parts) >= 3) & lat.isNotNull() & lon.isNotNull() & ts.isNotNull()
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon"), ts.alias("ts")))


def pace(length: Column, duration_ms: Column) -> Column:
    """Pace as duration * 1000 / (60 * length); 0 for no length."""
    return F.coalesce(F.try_divide(duration_ms * 1000.0, 60.0 * length), F.lit(0.0))

"""Distances, bearings and point-in-polygon as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
DETOUR = 1.3


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # null where a place is unknown


def road_km(km: Column) -> Column:
    return km * DETOUR


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x, y = F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))


def turn_angle(incoming: Column, outgoing: Column) -> Column:
    """Signed angle in (-180, 180]: negative to the left."""
    a = F.pmod(outgoing - incoming + 180, F.lit(360.0)) - 180
    return F.when(a == -180, 180.0).otherwise(a)


def drive_seconds(km: Column, base_kmh: float = 60.0) -> Column:
    """30 km at the base speed, up to 150 km at 80 km/h or more, the rest at 100 km/h or more."""
    near = F.least(km, F.lit(30.0)) / base_kmh
    middle = F.greatest(F.least(km, F.lit(150.0)) - 30, F.lit(0.0)) / max(base_kmh, 80.0)
    far = F.greatest(km - 150, F.lit(0.0)) / max(base_kmh, 100.0)
    return (near + middle + far) * 3600


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule for a ring array<struct<lon,lat>>."""
    n = F.size(ring)

    def crossing(p, i):
        q = F.element_at(ring, F.when(i == 0, n).otherwise(i))
        cut = (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"]
        return ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < cut)

    return F.size(F.filter(F.transform(ring, crossing), lambda x: F.coalesce(x, F.lit(False)))) % 2 == 1


def in_polygons(lat: Column, lon: Column, polygons: Column) -> Column:
    """Polygons are arrays of rings, the first outer, the others holes."""
    inside = lambda rings: in_ring(lat, lon, F.element_at(rings, 1)) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1))), lambda r: in_ring(lat, lon, r))
    return F.exists(polygons, inside)

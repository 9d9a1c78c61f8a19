"""Distances, projections and repairs of positions as Column expressions (PRJ-6, 18-20, 31, FLT-5, GEO-4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres, metres of a degree, the map's envelope.
EARTH_M = 6371008.8
DEGREE_M = 111320.0
ENVELOPE = {"lat": (-11.5, 6.5), "lon": (94.5, 141.5)}

COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def projected(lat: Column, lon: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north on a local equirectangular projection (PRJ-19)."""
    return lon * F.cos(F.radians(lat0)) * DEGREE_M, lat * DEGREE_M


def unprojected(x: Column, y: Column, lat0: Column) -> tuple[Column, Column]:
    return y / DEGREE_M, x / (F.cos(F.radians(lat0)) * DEGREE_M)


def repaired(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Latitude and longitude, swapped where only that can be meant (PRJ-6)."""
    swap = (F.abs(lat) > 90) & (F.abs(lon) <= 90)
    return F.when(swap, lon).otherwise(lat), F.when(swap, lat).otherwise(lon)


def on_map(lat: Column, lon: Column) -> Column:
    """Whether a position is known and inside the map's envelope (FLT-5)."""
    inside = lat.between(*map(F.lit, ENVELOPE["lat"])) & lon.between(*map(F.lit, ENVELOPE["lon"]))
    return F.coalesce(inside, F.lit(False))


def repaired_by_envelope(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The other variant: swapped if the position lies on the map only the other way round."""
    swap = ~on_map(lat, lon) & on_map(lon, lat)
    return F.when(swap, lon).otherwise(lat), F.when(swap, lat).otherwise(lon)


def distance_ramp(km: Column, zero: float, full: float) -> Column:
    """0 at ``zero`` km, 1 at ``full`` km, straight between; null stays null (PRJ-20)."""
    if full <= zero:
        return F.when(km.isNotNull(), (km >= full).cast("double"))
    return F.when(km.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (km - zero) / (full - zero))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees from north (PRJ-31)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    turn = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(turn + 360.0, F.lit(360.0))


def compass(degrees: Column) -> Column:
    """One of eight points."""
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.pmod(F.floor(degrees / 45.0 + 0.5), F.lit(8)) + 1).cast("int"))


def ring_area_km2(ring: Column, lat0: Column) -> Column:
    """Area of a ring [[lon, lat], ...] by the shoelace formula on the local projection (GEO-4)."""
    scale = F.cos(F.radians(lat0)) * DEGREE_M * DEGREE_M / 1e6
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, following, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2 * scale


def polygon_area_km2(rings: Column, lat0: Column) -> Column:
    """Outer ring less the holes."""
    each = F.transform(rings, lambda r: ring_area_km2(r, lat0))
    return F.aggregate(F.slice(each, 2, F.greatest(F.size(each) - 1, F.lit(0))), F.element_at(each, 1), lambda s, t: s - t)


def let(value: Column, out: Callable[[Column], Column]) -> Column:
    """``out`` of a value that is made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), out), 1)


def contains(rings: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test of a point against all rings of a polygon at once: holes flip it back (GEO-1, GEO-2).

    An edge counts if its ends lie on either side of the latitude, the lower end included, and it
    crosses right of the point.
    """

    def crossings(ring):
        following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        hit = lambda p, q: ((p[1] > lat) != (q[1] > lat)) & (lon < (q[0] - p[0]) * (lat - p[1]) / (q[1] - p[1]) + p[0])
        return F.aggregate(F.zip_with(ring, following, lambda p, q: F.when(p[1] == q[1], 0).otherwise(hit(p, q).cast("int"))), F.lit(0), lambda s, t: s + t)

    return F.pmod(F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, t: s + t), F.lit(2)) == 1

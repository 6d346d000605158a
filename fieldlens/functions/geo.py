"""Angles and the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def wrap(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def image_angle(dx: Column, dy: Column) -> Column:
    """Degrees counter-clockwise from east of a point about a centre, y downward."""
    return wrap(F.degrees(F.atan2(-dy, dx)) + 360)


def compass(angle: Column) -> Column:
    return wrap(90 - angle)


def separation(a: Column, b: Column) -> Column:
    d = wrap(F.abs(a - b))
    return F.least(d, 360 - d)


def circular_mean(angle: Column) -> Column:
    """Aggregate: the mean direction in degrees."""
    return wrap(F.degrees(F.atan2(F.sum(F.sin(F.radians(angle))), F.sum(F.cos(F.radians(angle))))) + 360)


def project(x: Column, y: Column, angle: Column, length: Column) -> tuple[Column, Column]:
    """The point length away at an image angle."""
    return x + F.cos(F.radians(angle)) * length, y - F.sin(F.radians(angle)) * length


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def destination(lat: Column, lng: Column, bearing: Column, meters: Column | float) -> tuple[Column, Column]:
    """(lat, lng) that many meters away along a great circle."""
    d = (meters if isinstance(meters, Column) else F.lit(float(meters))) / EARTH_M
    t, p = F.radians(bearing), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    return F.degrees(q), lng + F.degrees(F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q)))


def wedge(lat: Column, lng: Column, azimuth: Column, meters: float, view: float = 60.0, step: float = 5.0, inner: float = 0.0) -> Column:
    """Closed polygon of a sector as an array of (lat, lng): its centre, or an inner arc, and an outer arc."""
    bearings = F.array(*[azimuth - view / 2 + k * step for k in range(math.floor(view / step) + 1)])

    def arc(radius: float) -> Column:
        return F.transform(bearings, lambda t: F.struct(destination(lat, lng, t, radius)[0].alias("lat"), destination(lat, lng, t, radius)[1].alias("lng")))

    centre = F.array(F.struct(lat.cast("double").alias("lat"), lng.cast("double").alias("lng")))
    if inner > 0:
        first = F.slice(arc(inner), 1, 1)
        return F.concat(arc(inner), F.reverse(arc(meters)), first)
    return F.concat(centre, arc(meters), centre)


def azimuth_bonus(site_angle: Column, azimuth: Column, most: float = 40.0, upto: float = 65.0) -> Column:
    """How well a sector's image angle confirms its azimuth: most when equal, falling to 0 at upto degrees."""
    d = separation(compass(site_angle), azimuth)
    return F.when(azimuth.isNull() | (d > upto), 0.0).otherwise(most * (upto - d) / upto)


def valid_position(lat: Column, lng: Column) -> tuple[Column, Column]:
    """(latitude, longitude), north and west by convention; null where out of range or no number."""
    a, o = F.abs(lat.try_cast("double")), -F.abs(lng.try_cast("double"))
    ok = (a <= 90) & (o >= -180) & ~F.isnan(a) & ~F.isnan(o)
    return F.when(ok, a), F.when(ok, o)


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """A vector turned by an angle in degrees."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return x * c - y * s, x * s + y * c


def held_in_place(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """How far to shift a plane turned by minus the angle about its middle, so that the point x, y from there stays."""
    rx, ry = rotate(x, y, -angle)
    return x - rx, y - ry


def dragged(angle: Column, pixels: Column, around: Column) -> Column:
    """The view's angle after a drag over some pixels of a panorama that is around pixels wide."""
    return wrap(angle - pixels / around * 360)

"""Vector algebra over triples of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    """Length one; a null vector stays as it is."""
    n = length(a)
    safe = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return a[0] / safe, a[1] / safe, a[2] / safe


def azimuth(a: Vector) -> Column:
    """Compass bearing in degrees, 0 to 360, clockwise from y."""
    deg = F.degrees(F.atan2(a[0], a[1]))
    return F.when(deg < 0, deg + 360.0).otherwise(deg)


def inclination(a: Vector) -> Column:
    """Degrees from the z axis; 0 for a null vector."""
    n = length(a)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a[2] / F.when(n == 0, F.lit(1.0)).otherwise(n))))))


def about_axis(a: Vector, axis: int, degrees: float) -> Vector:
    """Rotation about a coordinate axis, anticlockwise seen against it."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    p, q = [k for k in range(3) if k != axis]
    if axis == 1:
        p, q = q, p
    out = list(a)
    out[p], out[q] = a[p] * c - a[q] * s, a[p] * s + a[q] * c
    return out[0], out[1], out[2]


def tilted(p: Vector, pivot: tuple[float, float, float], bearing: float, dip: float) -> Vector:
    """Points tilted about a pivot: down by ``dip`` degrees towards compass ``bearing``."""
    v = (p[0] - pivot[0], p[1] - pivot[1], p[2] - pivot[2])
    v = about_axis(v, 2, bearing)
    v = about_axis(v, 0, -dip)
    v = about_axis(v, 2, -bearing)
    return v[0] + pivot[0], v[1] + pivot[1], v[2] + pivot[2]


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    return length(cross(minus(b, a), minus(c, a))) / 2


def triangle_normal(a: Vector, b: Vector, c: Vector) -> Vector:
    return unit(cross(minus(b, a), minus(c, a)))

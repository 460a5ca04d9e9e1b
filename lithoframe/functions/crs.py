"""Coordinate reference systems: axis order, offsets, direction of z, rotation, units."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


#: The directions of x and y, and those orders that are right handed seen from above.
AXIS_ORDERS = ("easting northing", "northing easting", "westing southing", "southing westing", "northing westing", "westing northing")
RIGHT_HANDED = ("northing easting", "southing westing", "westing northing")


def switched(x: Column, y: Column, old: str, new: str) -> tuple[Column, Column]:
    """x and y of one axis order in another."""
    east_north = {}
    for value, way in zip((x, y), old.split()):
        east_north[way[0] in "ew"] = value if way[0] in "en" else -value
    return tuple(east_north[way[0] in "ew"] if way[0] in "en" else -east_north[way[0] in "ew"] for way in new.split())


@dataclass(frozen=True)
class Crs:
    """A local system: its origin, in its own axis order, and its rotation (radians).

    Axis orders name the directions of x and y. The rotation that takes global to local
    coordinates is anticlockwise where the axes are left handed seen from above (as
    easting northing with depth), clockwise where they are right handed.
    """

    x_offset: float = 0.0
    y_offset: float = 0.0
    z_offset: float = 0.0
    rotation: float = 0.0
    z_up: bool = False
    global_z_up: bool = False
    axis_order: str = "easting northing"
    global_axis_order: str = "easting northing"
    xy_metres: float = 1.0
    z_metres: float = 1.0

    def __post_init__(self) -> None:
        if not {self.axis_order, self.global_axis_order} <= set(AXIS_ORDERS):
            raise ValueError(f"no axis order: {self.axis_order}, {self.global_axis_order}")

    @property
    def right_handed_xy(self) -> bool:
        return self.axis_order in RIGHT_HANDED

    @property
    def _turn(self) -> float:
        return -self.rotation if self.right_handed_xy else self.rotation

    def to_local(self, p: Point) -> Point:
        x, y, z = p
        x, y = switched(x, y, self.global_axis_order, self.axis_order)
        if self.z_up != self.global_z_up:
            z = -z
        return _rotated((x - self.x_offset, y - self.y_offset, z - self.z_offset), self._turn)

    def to_global(self, p: Point) -> Point:
        x, y, z = _rotated(p, -self._turn)
        x, y, z = x + self.x_offset, y + self.y_offset, z + self.z_offset
        if self.z_up != self.global_z_up:
            z = -z
        return *switched(x, y, self.axis_order, self.global_axis_order), z

    def to_other(self, p: Point, other: Crs) -> Point:
        """``p`` in the system ``other``; units differ by their lengths in metres."""
        x, y, z = self.to_global(p)
        xy, zz = self.xy_metres / other.xy_metres, self.z_metres / other.z_metres
        return other.to_local((x * xy, y * xy, z * zz))


def _rotated(p: Point, angle: float) -> Point:
    if angle == 0.0:
        return p
    c, s = F.lit(math.cos(angle)), F.lit(math.sin(angle))
    return p[0] * c - p[1] * s, p[0] * s + p[1] * c, p[2]

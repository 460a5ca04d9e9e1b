"""Coordinates and vectors: points of the embeddings."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions import vectors as v
from lithoframe.functions.crs import AXIS_ORDERS, Crs
from lithoframe.plans import POINTS, points, q6, query, sdsum, dsum, sq6

LOCAL = Crs(x_offset=1000.0, y_offset=2000.0, z_offset=50.0, rotation=math.radians(30.0), z_up=False, global_z_up=True, axis_order="northing easting")
OTHER = Crs(x_offset=400.0, y_offset=-100.0, z_offset=10.0, rotation=math.radians(-15.0), xy_metres=0.3048, z_metres=0.3048, global_z_up=True, axis_order="northing easting")
_C, _S = repr(math.cos(math.radians(30.0))), repr(math.sin(math.radians(30.0)))
_C2, _S2 = repr(math.cos(math.radians(15.0))), repr(math.sin(math.radians(15.0)))


def _xyz() -> v.Vector:
    return tuple(F.col(c) for c in "xyz")


def _out(df: DataFrame, p) -> DataFrame:
    return df.select("id", *(q6(c).alias(n) for c, n in zip(p, "xyz")))


_TO_LOCAL = f"select id, (y - 1000.0) * {_C}::double + (x - 2000.0) * {_S}::double as x, (x - 2000.0) * {_C}::double - (y - 1000.0) * {_S}::double as y, -z - 50.0 as z from points"
_TO_GLOBAL = f"select id, x * {_S}::double + y * {_C}::double + 2000.0 as x, x * {_C}::double - y * {_S}::double + 1000.0 as y, -(z + 50.0) as z from points"


def _q(inner: str) -> str:
    return f"with {POINTS}, r as ({inner}) select id, {sq6('x')} as x, {sq6('y')} as y, {sq6('z')} as z from r"


@query(_q(_TO_LOCAL))
def crs_to_local(spark: SparkSession, d: str) -> DataFrame:
    return _out(points(spark, d), LOCAL.to_local(_xyz()))


@query(_q(_TO_GLOBAL))
def crs_to_global(spark: SparkSession, d: str) -> DataFrame:
    return _out(points(spark, d), LOCAL.to_global(_xyz()))


@query(
    f"with {POINTS}, g as ({_TO_GLOBAL}), s as (select id, y / 0.3048::double - 400.0 as a, x / 0.3048::double + 100.0 as b, -(z / 0.3048::double) - 10.0 as z from g), "
    f"r as (select id, a * {_C2}::double - b * {_S2}::double as x, a * {_S2}::double + b * {_C2}::double as y, z from s) select id, {sq6('x')} as x, {sq6('y')} as y, {sq6('z')} as z from r"
)
def crs_to_other(spark: SparkSession, d: str) -> DataFrame:
    return _out(points(spark, d), LOCAL.to_other(_xyz(), OTHER))


#: What x and y of easting northing are in each axis order, and the sine that turns them.
_ORDERS = {"easting northing": ("x", "y", _S), "northing easting": ("y", "x", f"-{_S}"), "westing southing": ("-x", "-y", _S), "southing westing": ("-y", "-x", f"-{_S}"), "northing westing": ("y", "-x", _S), "westing northing": ("-x", "y", f"-{_S}")}


@query(f"with {POINTS}, o as (" + " union all ".join(f"select id, '{o}' as axes, {a} - 1000.0 as u, {b} - 2000.0 as v, {s}::double as s, z from points" for o, (a, b, s) in _ORDERS.items()) + f") select id, axes, {sq6(f'u * {_C}::double - v * s')} as x, {sq6(f'u * s + v * {_C}::double')} as y, {sq6('z - 50.0')} as z from o")
def crs_axis_orders(spark: SparkSession, d: str) -> DataFrame:
    """Points in local systems of every axis order."""
    found = []
    for order in AXIS_ORDERS:
        local = Crs(x_offset=1000.0, y_offset=2000.0, z_offset=50.0, rotation=math.radians(30.0), axis_order=order)
        found.append(points(spark, d).select("id", F.lit(order).alias("axes"), *(q6(c).alias(n) for c, n in zip(local.to_local(_xyz()), "xyz"))))
    return reduce(DataFrame.unionByName, found)


@query(f"with {POINTS} select id, {sq6('x')} as x, {sq6('y')} as y, {sq6('z')} as z from points")
def crs_there_and_back(spark: SparkSession, d: str) -> DataFrame:
    """To a local system and back, through one of another axis order."""
    one = Crs(x_offset=10.0, y_offset=-20.0, rotation=0.7, axis_order="southing westing", z_up=True)
    other = Crs(x_offset=3.0, rotation=-0.2, axis_order="northing westing")
    p = one.to_other(one.to_local(_xyz()), other)
    return _out(points(spark, d), other.to_global(p))


@query(f"with {POINTS}, u as (select id, x, y, z, sqrt(x * x + y * y + z * z) as n from points) select id, {sq6('x / n')} as ux, {sq6('x * 0.5 - y * 0.25 + z * 2.0')} as dot, {sq6('y * 2.0 + z * 0.25')} as cross_x, {sq6('z * 0.5 - x * 2.0')} as cross_y, {sq6('-x * 0.25 - y * 0.5')} as cross_z from u")
def vector_algebra(spark: SparkSession, d: str) -> DataFrame:
    other = tuple(F.lit(x) for x in (0.5, -0.25, 2.0))
    c = v.cross(_xyz(), other)
    return points(spark, d).select("id", q6(v.unit(_xyz())[0]).alias("ux"), q6(v.dot(_xyz(), other)).alias("dot"), *(q6(x).alias(f"cross_{n}") for x, n in zip(c, "xyz")))


@query(f"with {POINTS} select id, {sq6('case when degrees(atan2(x, y)) < 0 then degrees(atan2(x, y)) + 360 else degrees(atan2(x, y)) end')} as azimuth, {sq6('degrees(acos(z / sqrt(x * x + y * y + z * z)))')} as inclination from points")
def vector_azimuth(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", q6(v.azimuth(_xyz())).alias("azimuth"), q6(v.inclination(_xyz())).alias("inclination"))


@query(_q(f"select id, x * {_C}::double - y * {_S}::double as x, x * {_S}::double + y * {_C}::double as y, z from points"))
def vector_rotate(spark: SparkSession, d: str) -> DataFrame:
    return _out(points(spark, d), v.about_axis(_xyz(), 2, 30.0))


@query(
    f"with {POINTS}, a as (select id, (x - 0.1) * {_C}::double - (y - 0.2) * {_S}::double as p, (x - 0.1) * {_S}::double + (y - 0.2) * {_C}::double as q, z from points), "
    f"b as (select id, p, q * {_C2}::double + z * {_S2}::double as q, z * {_C2}::double - q * {_S2}::double as z from a) "
    f"select id, {sq6(f'p * {_C}::double + q * {_S}::double + 0.1')} as x, {sq6(f'q * {_C}::double - p * {_S}::double + 0.2')} as y, {sq6('z')} as z from b"
)
def points_tilt(spark: SparkSession, d: str) -> DataFrame:
    """Points tilted about a pivot by 15 degrees towards a bearing of 30."""
    return _out(points(spark, d), v.tilted(_xyz(), (0.1, 0.2, 0.0), 30.0, 15.0))


@query(f"with {POINTS} select label, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1, {sdsum('x')} / count(x) as cx, {sdsum('y')} / count(y) as cy, {sdsum('z')} / count(z) as cz from points group by label")
def points_bounding_box(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    box = [f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))]
    return p.groupBy("label").agg(*box, *((dsum(F.col(c)) / F.count(c)).alias(f"c{c}") for c in "xyz"))


@query(f"with {POINTS} select id, x, y, z from points where x between -0.1 and 0.15 and y between -0.2 and 0.1 and z between -0.3 and 0.3")
def points_trim_box(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).filter("x between -0.1 and 0.15 and y between -0.2 and 0.1 and z between -0.3 and 0.3").select("id", "x", "y", "z")


@query(f"with {POINTS}, q as (select * from points where id % 100 = 0), r as (select q.id, p.id as nearest, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) as d from q join points p on p.id <> q.id), n as (select *, row_number() over (partition by id order by floor(d * 1e9), nearest) as nth from r) select id, nearest, {sq6('d')} as distance from n where nth = 1")
def points_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other point of each of a stated set of queries, seen from above: by rings of tiles, widened where a ring is empty."""
    from lithoframe.operators.nearest import nearest_xy

    p = points(spark, d)
    found = nearest_xy(p.filter("id % 100 = 0"), p, tile=0.05, other=True)
    return found.select("id", "nearest", q6(F.col("distance")).alias("distance"))


@query(f"with {POINTS}, r as (select q.id, p.id as nearest, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) as d from points q join points p on p.id <> q.id), n as (select *, row_number() over (partition by id order by floor(d * 1e9), nearest) as nth from r) select id, nearest, {sq6('d')} as distance from n where nth = 1")
def points_nearest_other(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other point of every point, seen from above."""
    from lithoframe.operators.nearest import nearest_xy

    p = points(spark, d)
    return nearest_xy(p, p, tile=0.05, other=True).select("id", "nearest", q6(F.col("distance")).alias("distance"))


@query(f"with {POINTS} select id, x, y, row_number() over (partition by label order by x, y, id)::integer as place from points")
def points_xy_sorted(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", "x", "y", F.expr("row_number() over (partition by label order by x, y, id)").alias("place"))

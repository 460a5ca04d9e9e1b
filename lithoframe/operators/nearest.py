"""Nearest neighbours by tiles."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.storage import settled

#: Largest number of tiles along an axis: beyond it tile numbers lose their meaning.
_TILES = 2**40
#: Points that the first tiles hold on average, or up to four times as many.
_IN_TILE = 4


def nearest_xy(queries: DataFrame, points: DataFrame, tile: float, other: bool = False) -> DataFrame:
    """id, nearest and distance (seen from above) for each query point; ties go to the smaller id.

    A query looks in the 3 by 3 tiles about its own, at first of size ``tile`` or, where that would hold many points on average, a half, a quarter ... of it. It is done if its nearest hit is
    closer than one tile, for no point outside can be closer; the others go on with
    tiles of twice the size or more, so that far points cost no more than near ones. The last
    tile spans all queries and points, so that none is left then. With ``other`` a
    point is no neighbour of a query with its id. Queries and points without finite
    coordinates are left out; only without any candidate has a query no row.
    """
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xy")
    queries, points = queries.filter(finite), points.filter(finite)
    ends = [f(F.col(c).cast("double")).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))]
    box = queries.select("x", "y").unionByName(points.select("x", "y")).agg(*ends).first()
    left = queries.select("id", F.col("x").alias("qx"), F.col("y").alias("qy"))
    if box.x0 is None or points.isEmpty():
        return left.limit(0).join(points.select(F.col("id").alias("nearest")).limit(0)).select("id", "nearest", F.lit(0.0).alias("distance"))
    extent = max(box.x1 - box.x0, box.y1 - box.y0)
    if extent > tile * _TILES:
        tile = extent / _TILES
    last = max(0, math.ceil(math.log2(extent / tile))) + 1 if extent > 0 else 0
    # where points are dense, tiles of some points each come first, so that pairs grow with the points
    many, area = points.count(), (box.x1 - box.x0) * (box.y1 - box.y0)
    fit = math.sqrt(area * _IN_TILE / many) if area > 0 else tile
    done, k = [], min(0, max(math.ceil(math.log2(fit / tile)), math.ceil(math.log2(max(extent, tile) / _TILES / tile))))
    while True:
        size = tile * 2**k
        at = lambda c, low: F.floor((F.col(c) - low) / size)  # noqa: B023, E731
        around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
        q = left.withColumn("o", around).select("id", "qx", "qy", (at("qx", box.x0) + F.col("o.a")).alias("tx"), (at("qy", box.y0) + F.col("o.b")).alias("ty"))
        p = points.select(F.col("id").alias("nearest"), "x", "y", at("x", box.x0).alias("tx"), at("y", box.y0).alias("ty"))
        d = F.sqrt((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2)
        pairs = q.join(p, ["tx", "ty"])
        if other:
            pairs = pairs.filter(F.col("nearest") != F.col("id"))
        # whole billionths; a far distance has no others, and no room in a long
        rough = F.when(F.col("distance") < 1e6, F.floor(F.col("distance") * 1e9).cast("double")).otherwise(F.col("distance") * 1e9)
        best = pairs.withColumn("distance", d).groupBy("id").agg(F.min_by(F.struct("nearest", "distance"), F.struct(rough, F.col("nearest"))).alias("m"))
        # the last tiles hold everything, however far
        found = best.select("id", "m.*").filter(F.lit(k == last) | (F.col("distance") < size))
        found = settled(found)
        done.append(found)
        left = settled(left.join(found.select("id"), "id", "left_anti"))
        if k == last or left.isEmpty():
            break
        # where nothing was found, far larger tiles are worth a try
        k = min(last, k + (4 if found.isEmpty() else 1))
    return reduce(DataFrame.unionByName, done)

"""Faces of a regular grid that stand for a surface, and the two sides into which faces cut the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.operators.connections import labelled
from lithoframe.operators.surfaces import hits_on_lattice
from lithoframe.storage import settled

_XYZ = {"i": "x", "j": "y", "k": "z"}


def surface_faces(corners: DataFrame, extent: dict[str, int], size: dict[str, float], axis: str) -> DataFrame:
    """k, j, i of the cells whose face towards the next cell along ``axis`` stands for the surface.

    A face does where the line between the two cell centres meets a triangle (x0 ... z2).
    Lines along an axis are a lattice in the plane of the other two, so that each triangle
    meets just the lines within its bounds.
    """
    a, b = (x for x in "ijk" if x != axis)
    # in cell centres: 0 is the centre of the first cell
    scaled = {f"{n}{k}": F.col(f"{_XYZ[x]}{k}") / size[x] - 0.5 for n, x in zip("xyz", (a, b, axis)) for k in range(3)}
    hits = hits_on_lattice(corners.select(*(c.alias(n) for n, c in scaled.items())), extent[a], extent[b])
    at = F.floor("z")
    found = hits.withColumn("f", at).filter((F.col("f") >= 0) & (F.col("f") < extent[axis] - 1))
    return found.select(*(F.col({a: "x", b: "y", axis: "f"}[x]).cast("long").alias(x) for x in "kji")).distinct()


def sides(cells: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cell_id and upper of ``cells(cell_id, k, j, i)``, and one row with whether the cut is a curtain.

    ``faces(k, j, i, axis)`` lie between a cell and the next one along axis. Cells that
    hang together without passing a face are a part; the part of the first cell is one
    side, all others the other. upper is the side with the smaller mean k; where the means
    differ by 0.001 at most, the faces are a curtain. Raises ValueError where the faces
    leave a way round or through, so that all cells hang together.
    """
    at = cells.select("cell_id", "k", "j", "i")
    shut = faces.select("k", "j", "i", "axis").distinct()
    w = Window.partitionBy("j", "i").orderBy("k")
    floors = shut.filter("axis = 'k'").select((F.col("k") + 1).alias("k"), "j", "i", F.lit(True).alias("roofed"))
    starts = F.col("roofed").isNotNull() | ~F.coalesce(F.lag("k").over(w) == F.col("k") - 1, F.lit(False))
    # open stretches along k are the nodes, each named by its topmost cell
    runs = settled(at.join(floors, ["k", "j", "i"], "left").withColumn("starts", starts).withColumn("run", F.last(F.when(F.col("starts"), F.col("cell_id")), ignorenulls=True).over(w)).select("cell_id", "k", "j", "i", "run"))
    edges = None
    for axis in "ji":
        there = runs.select(F.col("run").alias("b"), *((F.col(x) - (1 if x == axis else 0)).alias(x) for x in "kji"))
        part = runs.join(there, ["k", "j", "i"]).join(shut.filter(F.col("axis") == axis), ["k", "j", "i"], "left_anti").select(F.col("run").alias("a"), "b")
        edges = part if edges is None else edges.unionByName(part)
    parts = labelled(edges.distinct(), runs.select(F.col("run").alias("id")).distinct())
    first = runs.agg(F.min_by("run", "cell_id").alias("corner"))
    seed = parts.join(F.broadcast(first), parts.id == first.corner).select(F.col("part").alias("seed"))
    sided_runs = parts.join(F.broadcast(seed), parts.part == seed.seed, "left").select(F.col("id").alias("run"), F.col("seed").isNotNull().alias("one"))
    one = runs.join(sided_runs, "run").select("cell_id", "one")
    if one.filter("one").limit(1).count() and one.filter("not one").isEmpty():
        raise ValueError("the faces do not part the cells")
    sided = at.join(one, "cell_id")
    means = sided.agg(F.avg(F.when(F.col("one"), F.col("k"))).alias("a"), F.avg(F.when(~F.col("one"), F.col("k"))).alias("b"))
    upper = F.when(F.coalesce(F.col("a") > F.col("b"), F.lit(False)), ~F.col("one")).otherwise(F.col("one"))
    curtain = means.select((F.abs(F.col("a") - F.col("b")) <= 0.001).alias("curtain"))
    return sided.crossJoin(F.broadcast(means)).select("cell_id", upper.alias("upper")), curtain

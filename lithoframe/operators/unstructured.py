"""Unstructured grids: cell_faces(cell, face), face_nodes(face, seq, node) and nodes(node, x, y, z).

All of these grow with the grid, and rows spread from few bytes look small to the
optimizer: joins between them are merges, never sent to all tasks through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.vectors import Vector, cross, dot, minus


def tetra_volume(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    return F.abs(dot(minus(b, a), cross(minus(c, a), minus(d, a)))) / 6.0


def pyramid_volume(apex: Vector, a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """Volume over a base a, b, c, d; one that isn't flat counts as bilinear, half way between its two pairs of triangles."""
    return (tetra_volume(apex, a, b, c) + tetra_volume(apex, a, c, d) + tetra_volume(apex, b, c, d) + tetra_volume(apex, b, d, a)) / 2.0


def cell_centre(corners: list[Vector]) -> Vector:
    """The mean of a cell's corners."""
    return tuple(sum((p[n] for p in corners), F.lit(0.0)) / float(len(corners)) for n in range(3))


def external_faces(cell_faces: DataFrame) -> DataFrame:
    """Faces that one cell uses."""
    return cell_faces.groupBy("face").agg(F.count("*").alias("cells")).filter("cells = 1").select("face")


def centres(cell_faces: DataFrame, face_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean of the distinct nodes of each cell."""
    used = cell_faces.join(face_nodes.hint("merge"), "face").select("cell", "node").distinct().join(nodes.hint("merge"), "node")
    return used.groupBy("cell").agg(*(F.avg(c).alias(c) for c in "xyz"))


def volumes(cell_faces: DataFrame, face_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Volume of each cell: tetrahedra of its centre, the centre of a face, and each edge of the face (for cells that their centres see whole)."""
    w = Window.partitionBy("face").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = face_nodes.join(nodes.hint("merge"), "node")
    edges = placed.withColumns({f"n{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in "xyz"} | {f"f{c}": F.avg(c).over(Window.partitionBy("face")) for c in "xyz"})
    middle = centres(cell_faces, face_nodes, nodes).select("cell", *(F.col(c).alias(f"c{c}") for c in "xyz"))
    rows = cell_faces.join(edges.hint("merge"), "face").join(middle.hint("merge"), "cell")
    corner = lambda p: tuple(F.col(f"{p}{c}") for c in "xyz")
    return rows.groupBy("cell").agg(F.sum(tetra_volume(corner("c"), corner("f"), corner(""), corner("n"))).alias("volume"))

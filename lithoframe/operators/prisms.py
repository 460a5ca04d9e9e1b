"""Vertical prism grids: triangles (t, n0, n1, n2) seen from above, each a column of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.operators.surfaces import CORNERS


def side_factors(side: int) -> tuple[Column, Column]:
    """Normal length and flow length of the side opposite corner ``side`` of a triangle with corners x0, y0 ... x2, y2.

    Flow goes from the triangle's centre to the middle of the side; the normal length is the
    side's length across that direction.
    """
    x, y = ([F.col(f"{c}{k}") for k in range(3)] for c in "xy")
    a, b = (side + 1) % 3, (side + 2) % 3
    fx = (x[a] + x[b]) / 2.0 - (x[0] + x[1] + x[2]) / 3.0
    fy = (y[a] + y[b]) / 2.0 - (y[0] + y[1] + y[2]) / 3.0
    flow = F.sqrt(fx * fx + fy * fy)
    return F.abs((x[b] - x[a]) * fy - (y[b] - y[a]) * fx) / F.nullif(flow, F.lit(0.0)), flow


def plan_area() -> Column:
    """Area of a triangle seen from above."""
    c = lambda n: F.col(n)
    return F.abs((c("x1") - c("x0")) * (c("y2") - c("y0")) - (c("x2") - c("x0")) * (c("y1") - c("y0"))) / 2.0


def half_transmissibility(cells: DataFrame, perms: tuple[str, str, str], thickness: str, darcy: float, perm_k: str | None = None, ntg: str | None = None, by_height: bool = False, tolerance: float = 1e-6) -> DataFrame:
    """``cells`` with half: the half-cell transmissibilities of top, base and the sides opposite each corner.

    ``perms`` name the permeabilities towards the three sides; without ``perm_k`` their mean
    counts vertically. Null where the half axis is shorter than ``tolerance``. Sides count
    by their length alone, as in the model, unless ``by_height``, which takes their area;
    ``ntg`` reduces sides only.
    """
    vertical = F.col(perm_k) if perm_k else sum((F.col(p) for p in perms[1:]), F.col(perms[0])) / 3.0
    half = F.col(thickness) / 2.0
    through = F.when(half >= tolerance, vertical * plan_area() / half) * darcy
    sides = []
    for n, perm in enumerate(perms):
        length, flow = side_factors(n)
        t = F.when(flow >= tolerance, F.col(perm) * length / flow)
        if ntg:
            t = t * F.col(ntg)
        if by_height:
            t = t * F.col(thickness)
        sides.append(t * darcy)
    return cells.withColumn("half", F.array(through, through, *sides))


def shared_sides(triangles: DataFrame) -> DataFrame:
    """t0, side0, t1, side1: pairs of triangles on either side of an edge, side being the number of the opposite corner; t0 is below t1.

    One grouping by edge; edges of one triangle, or of more than two, which no plane has, connect nothing.
    """
    sides = F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.lit(k).alias("side")) for k, (p, q) in enumerate((CORNERS[(k + 1) % 3], CORNERS[(k + 2) % 3]) for k in range(3))))
    flat = triangles.select("t", F.explode(sides).alias("e")).select("e.a", "e.b", F.struct("t", "e.side").alias("s"))
    pairs = flat.groupBy("a", "b").agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.count("*").alias("n")).filter("n = 2 and s0.t <> s1.t")
    return pairs.select(*(F.col(f"s{k}.{c}").alias(f"{c}{k}") for k in (0, 1) for c in ("t", "side")))


def _joined(a: Column, b: Column) -> Column:
    """Of two half cells in series; none where either is 0, null where either is."""
    return F.when((a == 0) | (b == 0), 0.0).otherwise(1.0 / (1.0 / a + 1.0 / b))


def transmissibility(halves: DataFrame, triangles: DataFrame) -> DataFrame:
    """t0, layer0, t1, layer1 and trans of prisms that meet, of ``halves(t, layer, half)``: across sides within a layer, and from each layer to the next."""
    own = halves.select("t", "layer", "half")
    a = own.select(F.col("t").alias("t0"), F.col("layer").alias("layer0"), F.col("half").alias("half0"))
    b = own.select(F.col("t").alias("t1"), F.col("layer").alias("layer1"), F.col("half").alias("half1"))
    flat = a.join(shared_sides(triangles), "t0").withColumn("layer1", F.col("layer0")).join(b, ["t1", "layer1"])
    flat = flat.withColumn("trans", _joined(F.get("half0", F.col("side0") + 2), F.get("half1", F.col("side1") + 2)))
    down = a.withColumns({"t1": F.col("t0"), "layer1": F.col("layer0") + 1}).join(b, ["t1", "layer1"])
    down = down.withColumn("trans", _joined(F.get("half0", F.lit(1)), F.get("half1", F.lit(0))))
    columns = ["t0", "layer0", "t1", "layer1", "trans"]
    return flat.select(*columns).unionByName(down.select(*columns))

"""Boxes of cells: columns k0, k1, j0, j1, i0, i1, first and last index of each axis from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "kji"


def _end(box: str, axis: str, side: int) -> Column:
    return F.col(f"{box}.{axis}{side}")


def union(a: str, b: str) -> Column:
    """The smallest box that holds both of two box structs."""
    ends = [f(_end(a, x, n), _end(b, x, n)).alias(f"{x}{n}") for x in AXES for n, f in ((0, F.least), (1, F.greatest))]
    return F.struct(*ends)


def intersection(a: str, b: str) -> Column:
    """The box that two box structs share; null where they share no cell."""
    low = {x: F.greatest(_end(a, x, 0), _end(b, x, 0)) for x in AXES}
    high = {x: F.least(_end(a, x, 1), _end(b, x, 1)) for x in AXES}
    shared = F.lit(True)
    for x in AXES:
        shared &= low[x] <= high[x]
    return F.when(shared, F.struct(*(e.alias(f"{x}{n}") for x in AXES for n, e in ((0, low[x]), (1, high[x])))))


def cells_in(box: str) -> Column:
    """How many cells a box struct holds; none if it is null."""
    n = F.lit(1).cast("long")
    for x in AXES:
        n = n * (_end(box, x, 1) - _end(box, x, 0) + 1)
    return F.coalesce(n, F.lit(0).cast("long"))


def holds(box: str, k: Column, j: Column, i: Column) -> Column:
    inside = F.lit(True)
    for x, c in zip(AXES, (k, j, i)):
        inside &= c.between(_end(box, x, 0), _end(box, x, 1))
    return inside


def without_external_faces(faces: DataFrame, extent: dict[str, int], all_k: bool = False) -> DataFrame:
    """Rows of face boxes (k0 ... i1, face as K-, K+, J- ...) that are not on the outside of the grid; with ``all_k`` no K faces at all."""
    outside = F.lit(False)
    for x in AXES:
        outside |= (F.col("face") == f"{x.upper()}-") & (F.col(f"{x}0") <= 0)
        outside |= (F.col("face") == f"{x.upper()}+") & (F.col(f"{x}1") >= extent[x] - 1)
    if all_k:
        outside |= F.col("face").startswith("K")
    return faces.filter(~outside)

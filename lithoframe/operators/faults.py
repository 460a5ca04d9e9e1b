"""Faults of a grid whose columns have pillars of their own: throws, fault finding, and what lies against what across an edge.

``corners`` has j, i (column), jp, ip (0 or 1: which of its pillars), k (layer boundary) and z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.operators import intervals
from lithoframe.operators.connections import labelled
from lithoframe.operators.steps import once


def edge_offsets(corners: DataFrame) -> DataFrame:
    """j, i, axis (the edge to the next column along j or i), pillar (0 or 1), k and offset: the next column's depth less the column's own at a shared pillar."""
    found = None
    for axis, along, across in (("i", "ip", "jp"), ("j", "jp", "ip")):
        own = corners.filter(F.col(along) == 1).select("j", "i", F.col(across).alias("pillar"), "k", "z")
        step = {a: F.col(a) - (1 if a == axis else 0) for a in "ji"}
        other = corners.filter(F.col(along) == 0).select(step["j"].alias("j"), step["i"].alias("i"), F.col(across).alias("pillar"), "k", F.col("z").alias("other"))
        part = own.join(other, ["j", "i", "pillar", "k"]).select("j", "i", F.lit(axis).alias("axis"), "pillar", "k", (F.col("other") - F.col("z")).alias("offset"))
        found = part if found is None else found.unionByName(part)
    return found


def throws(corners: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Greatest, mean and least offset, regardless of its direction, of each edge between columns that a fault splits."""
    size = F.abs("offset")
    per = edge_offsets(corners).groupBy("j", "i", "axis").agg(F.max(size).alias("most"), F.avg(size).alias("mean"), F.min(size).alias("least"))
    return per.filter(F.col("most") > tolerance)


def found_faults(corners: DataFrame, ni: int, tolerance: float = 0.001) -> DataFrame:
    """j, i, axis of split edges and fault: edges that meet at a pillar belong to one fault, named by its smallest pillar."""
    split = throws(corners, tolerance).select("j", "i", "axis")
    at = lambda j, i: (j * (ni + 1) + i).cast("long")
    first = at(F.when(F.col("axis") == "j", F.col("j") + 1).otherwise(F.col("j")), F.when(F.col("axis") == "i", F.col("i") + 1).otherwise(F.col("i")))
    second = at(F.col("j") + 1, F.col("i") + 1)
    ends = split.withColumns({"a": first, "b": second})
    nodes = ends.select(F.col("a").alias("id")).unionByName(ends.select(F.col("b").alias("id"))).distinct()
    parts = labelled(ends.select("a", "b"), nodes)
    return ends.join(parts.withColumnRenamed("id", "a"), "a").select("j", "i", "axis", F.col("part").alias("fault"))


def overlap(a_top: tuple[Column, Column], a_base: tuple[Column, Column], b_top: tuple[Column, Column], b_base: tuple[Column, Column]) -> Column:
    """Mean height, between two pillars, over which two faces lie against each other.

    Tops and bases run straight from one pillar to the other. What they share is straight
    between the places where two of them cross, so that a sum over those pieces is exact.
    """
    cuts = []
    for p, q in ((a_top, b_top), (a_base, b_base), (a_top, b_base), (b_top, a_base)):
        left, right = p[0] - q[0], p[1] - q[1]
        cuts.append(F.when(left * right < 0, left / (left - right)))
    places = F.array_sort(F.array_compact(F.array(F.lit(0.0), *cuts, F.lit(1.0))))

    def height(s: Column) -> Column:
        at = lambda p: p[0] + s * (p[1] - p[0])
        return F.greatest(F.lit(0.0), F.least(at(a_base), at(b_base)) - F.greatest(at(a_top), at(b_top)))

    state = F.struct(F.lit(0.0).alias("s"), height(F.lit(0.0)).alias("h"), F.lit(0.0).alias("total"))
    step = lambda t, s: F.struct(s.alias("s"), height(s).alias("h"), (t["total"] + (s - t["s"]) * (t["h"] + height(s)) / 2.0).alias("total"))
    return F.aggregate(places, state, step, lambda t: t["total"])


def juxtaposed(layers: DataFrame, edges: DataFrame, least: float = 1e-6) -> DataFrame:
    """Pairs of layers that lie against each other across column edges, with the fraction of either face (area0, area1).

    ``layers`` has column, k and t0, b0, t1, b1 (top and base at the two pillars of the
    edge, in the order of ``edges``(edge, column0, column1)); both sides carry edge.
    """
    a = layers.select("edge", F.col("column").alias("column0"), F.col("k").alias("k0"), *(F.col(c).alias(f"a_{c}") for c in ("t0", "b0", "t1", "b1")))
    b = layers.select("edge", F.col("column").alias("column1"), F.col("k").alias("k1"), *(F.col(c).alias(f"b_{c}") for c in ("t0", "b0", "t1", "b1")))
    # layers of a column don't overlap: those that meet are the ones whose depth ranges do
    reach = {"a": a.join(edges, ["edge", "column0"]), "b": b.join(edges, ["edge", "column1"]).drop("column0")}
    for side in "ab":
        ends = {f"{side}_low": F.least(f"{side}_t0", f"{side}_t1"), f"{side}_high": F.greatest(f"{side}_b0", f"{side}_b1")}
        reach[side] = reach[side].withColumns(ends)
    pairs = intervals.overlapping(reach["a"].drop("column1"), reach["b"], ["edge"], ("a_low", "a_high"), ("b_low", "b_high"))
    pair = lambda c, side: (F.col(f"{side}_{c}0"), F.col(f"{side}_{c}1"))
    shared = overlap(pair("t", "a"), pair("b", "a"), pair("t", "b"), pair("b", "b"))
    own = lambda side: (F.col(f"{side}_b0") - F.col(f"{side}_t0") + F.col(f"{side}_b1") - F.col(f"{side}_t1")) / 2.0
    part = lambda side: F.coalesce(F.col("shared") / F.nullif(own(side), F.lit(0.0)), F.lit(0.0))
    out = once(once(pairs, shared=shared), area0=part("a"), area1=part("b"))
    return out.filter((F.col("area0") > least) | (F.col("area1") > least)).select("edge", "column0", "k0", "column1", "k1", "area0", "area1")

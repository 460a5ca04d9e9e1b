"""Connection sets: pairs of cell faces, with filters, merges, pinch-outs and inherited features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.storage import settled


def by_layers(connections: DataFrame, first: int | None, last: int | None, layer_size: int, both: bool = True) -> DataFrame:
    """Connections whose cells lie in a range of layers, both or either; an open bound is no condition."""

    def inside(cell: str) -> Column:
        k = F.floor(F.col(cell) / layer_size)
        low = F.lit(True) if first is None else k >= first
        return low & (F.lit(True) if last is None else k <= last)

    a, b = inside("cell0"), inside("cell1")
    return connections.filter((a & b) if both else (a | b))


def by_cells(connections: DataFrame, cells: DataFrame, both: bool = True) -> DataFrame:
    """Connections whose cells are in ``cells(cell_id)``, both or either: joins, whose smaller side Spark may broadcast."""
    for c in ("cell0", "cell1"):
        marked = cells.select(F.col("cell_id").alias(c)).distinct().withColumn(f"__{c}", F.lit(True))
        connections = connections.join(marked, c, "left")
    a, b = F.coalesce("__cell0", F.lit(False)), F.coalesce("__cell1", F.lit(False))
    return connections.filter((a & b) if both else (a | b)).drop("__cell0", "__cell1")


def pinch_outs(cells: DataFrame, pinched: str, active: str | None = None, gap_below: str | None = None) -> DataFrame:
    """Pairs (cell0 above, cell1 below) that meet across one or more pinched-out cells of their column.

    Only pinched-out cells lie between the two. With ``active`` named, neither end may be
    inactive; with ``gap_below``, no gap between layers may follow the upper cell.
    """
    w = Window.partitionBy("j", "i").orderBy("k")
    alive = F.col(active) if active else F.lit(True)
    real = cells.filter(~F.col(pinched)).withColumn("__alive", alive)
    pairs = real.withColumns({"cell1": F.lead("cell_id").over(w), "k1": F.lead("k").over(w), "__alive1": F.lead("__alive").over(w)}).filter(F.col("k1") > F.col("k") + 1)
    if gap_below:
        pairs = pairs.filter(~F.col(gap_below))
    return pairs.filter("__alive and __alive1").select(F.col("cell_id").alias("cell0"), "cell1", (F.col("k1") - F.col("k") - 1).alias("skipped"))


def gap_connections(cells: DataFrame, gap_below: str, base: str, top: str, active: str | None = None, tolerance: float = 0.001) -> DataFrame:
    """Pairs (cell0 above, cell1 below) of neighbouring layers with a gap between them that has no thickness.

    ``base`` and ``top`` name the mean depths of a cell's lower and upper faces (null or NaN without geometry).
    """
    w = Window.partitionBy("j", "i").orderBy("k")
    n = cells.withColumns({"cell1": F.lead("cell_id").over(w), "__k1": F.lead("k").over(w), "__top1": F.lead(top).over(w), "__alive1": F.lead(F.col(active) if active else F.lit(True)).over(w)})
    thick = F.col("__top1") - F.col(base)
    thin = F.coalesce(~F.isnan(thick) & (thick < tolerance), F.lit(False))
    alive = (F.col(active) if active else F.lit(True)) & F.col("__alive1")
    return n.filter(F.col(gap_below) & (F.col("__k1") == F.col("k") + 1) & thin & alive).select(F.col("cell_id").alias("cell0"), "cell1")


def merged_multipliers(faces: DataFrame, how: str, fill: float = 1.0) -> DataFrame:
    """One multiplier for each face key (cell_id, axis): least, greatest or product where several sets have it; negative ones are refused."""
    refused = F.raise_error(F.lit("a multiplier is negative")).cast("double")
    v = F.when(F.col("multiplier") < 0, refused).otherwise(F.coalesce("multiplier", F.lit(fill)))
    by = {"min": F.min(v), "max": F.max(v), "product": F.product(v)}[how]
    return faces.groupBy("cell_id", "axis").agg(by.alias("multiplier"), F.count("*").alias("sets"))


def distinct_faces(faces: DataFrame) -> DataFrame:
    """Connections without duplicates, whichever way round their cells stand."""
    a, b = F.least("cell0", "cell1"), F.greatest("cell0", "cell1")
    return faces.select(a.alias("cell0"), b.alias("cell1"), "feature").groupBy("cell0", "cell1").agg(F.min("feature").alias("feature"))


def numbered(names: DataFrame, name: str) -> DataFrame:
    """``names`` with number: the places (from 0) of distinct names in their order, without a sort in one task."""
    parts = settled(names.select(name).distinct().repartitionByRange(name).withColumn("__part", F.spark_partition_id()))
    # a row for each task of the sort
    before = parts.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(name)) - 1
    return parts.withColumn("__nth", within).join(F.broadcast(before), "__part").select(name, (F.col("__before") + F.col("__nth")).alias("number"))


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sets as one; features keep theirs by name, and their numbers are those of all names in order."""
    both = first.select("cell0", "cell1", "name").unionByName(second.select("cell0", "cell1", "name"))
    return both.join(numbered(both, "name").withColumnRenamed("number", "feature"), "name")


def inherited(connections: DataFrame, source: DataFrame) -> DataFrame:
    """Features by (cell, face) of either side: the first side that has one decides."""
    low = source.groupBy("cell", "face").agg(F.min("feature").alias("found"))
    for side in ("0", "1"):
        part = low.select(F.col("cell").alias(f"cell{side}"), F.col("face").alias(f"face{side}"), F.col("found").alias(f"found{side}"))
        connections = connections.join(part, [f"cell{side}", f"face{side}"], "left")
    return connections.withColumn("feature", F.coalesce("found0", "found1")).drop("found0", "found1")


def connection_transmissibility(connections: DataFrame, half: DataFrame, tolerance: float = 1e-5, least_area: float = 1e-4) -> DataFrame:
    """Transmissibility of each connection from the half cells of its sides (cell, face, t) and fractional areas."""
    for side in ("0", "1"):
        part = half.select(F.col("cell").alias(f"cell{side}"), F.col("face").alias(f"face{side}"), F.col("t").alias(f"t{side}"))
        connections = connections.join(part, [f"cell{side}", f"face{side}"], "left")
    a, b = F.col("t0") * F.col("area0"), F.col("t1") * F.col("area1")
    none = F.coalesce(F.col("t0"), F.lit(0.0)) < tolerance
    for c in ("t1", "area0", "area1"):
        none = none | (F.coalesce(F.col(c), F.lit(0.0)) < (tolerance if c == "t1" else least_area))
    return connections.withColumn("t", F.when(none, 0.0).otherwise(1.0 / (1.0 / a + 1.0 / b)))


def column_summary(values: DataFrame, value: str) -> DataFrame:
    """Mean, least and greatest of the values on the K faces of each column, and how many there are."""
    v = F.col(value)
    return values.groupBy("j", "i").agg(F.avg(v).alias("mean_value"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(v).alias("faces"))


def shadow(cells: DataFrame, face: str) -> DataFrame:
    """Where a cell stands to the K faces of its column that are set (face k lies below cell k): 0 no face, 1 above all, 2 below all, 3 between."""
    w = Window.partitionBy("j", "i").orderBy("k")
    above = F.max(F.col(face).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # from below upwards, so that this frame grows with its sort as well
    below = F.max(F.col(face).cast("int")).over(Window.partitionBy("j", "i").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    code = F.when(F.coalesce(below, F.lit(0)) == 1, 1).otherwise(0) + F.when(F.coalesce(above, F.lit(0)) == 1, 2).otherwise(0)
    return cells.withColumn("shadow", code)


def labelled(edges: DataFrame, nodes: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """id and part: the smallest id that each node reaches over edges (a, b).

    Minima of neighbours are taken and followed by pointer jumping until nothing
    changes; every round's lineage is cut.
    """
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settled(nodes.select("id", F.col("id").alias("part")))
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("id").alias("b"), "part"), "b").groupBy(F.col("a").alias("id")).agg(F.min("part").alias("near"))
        low = label.join(near, "id", "left").select("id", F.least("part", F.coalesce("near", "part")).alias("part"), F.col("part").alias("was"))
        jump = low.select(F.col("id").alias("part"), F.col("part").alias("further"))
        new = settled(low.join(jump, "part", "left").select("id", F.least("part", F.coalesce("further", "part")).alias("part"), "was"))
        if new.filter("part <> was").isEmpty():
            return new.select("id", "part")
        label = new.select("id", "part")
    raise RuntimeError("labels did not settle")

"""Grids derived from others by moving their pillars: faults healed or scaled, draped to a surface, between two grids.

All take ``pillars.Pillars``, whose points are spread by pillar; what moves is one shift for
each pillar, so that a job is a few groupings and joins by pillar, whatever the layers are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.operators import space
from lithoframe.operators.lines import with_hits
from lithoframe.operators.pillars import SPOTS, Pillars, layer_sides, pillars_at, spots, standing
from lithoframe.storage import settled

XYZ = ("x", "y", "z")


def _plain(grid: Pillars) -> DataFrame:
    """The columns' corners with plain: the pillar that theirs is, or is split from."""
    return grid.columns.join(grid.splits.withColumnRenamed("of", "plain"), "pillar", "left").withColumn("plain", F.coalesce("plain", "pillar"))


def unsplit_points(grid: Pillars) -> DataFrame:
    """pillar (plain ones only), boundary and the mean of the points that the columns around it have there; points without geometry don't count."""
    # a pillar's point counts for each column that stands on it
    each = grid.points.join(standing(grid).select("pillar", "plain", F.bit_count("around").alias("many")), "pillar")
    mean = lambda c: F.sum(F.col(c).cast("double") * F.col("many")) / F.sum(F.when(F.col(c).isNotNull(), F.col("many")))
    return each.groupBy(F.col("plain").alias("pillar"), "boundary").agg(*(mean(c).alias(c) for c in XYZ))


def _ends(points: DataFrame, *others: int) -> DataFrame:
    """pillar, a and b (its first and last points with geometry) and at0 ... (those at other boundaries), written once; points are to be written down."""
    reach = settled(points.filter("z is not null").groupBy("pillar").agg(F.min("boundary").alias("first"), F.max("boundary").alias("last")).coalesce(1))
    some = points.join(reach, "pillar").filter(F.col("boundary").isin(*others) | (F.col("boundary") == F.col("first")) | (F.col("boundary") == F.col("last")))
    at = lambda b: F.max(F.when(F.col("boundary") == b, F.struct(*XYZ)))
    return settled(some.groupBy("pillar").agg(at(F.col("first")).alias("a"), at(F.col("last")).alias("b"), *(at(F.lit(o)).alias(f"at{k}") for k, o in enumerate(others))))


def unsplit(grid: Pillars) -> Pillars:
    """The grid with all faults healed: either side moves to the middle, on the line of the fault alone."""
    columns = _plain(grid).select("j", "i", "jp", "ip", F.col("plain").alias("pillar"))
    return Pillars(grid.layers, columns, grid.splits.filter("false"), unsplit_points(grid))


def _moved(grid: Pillars, shifts: DataFrame) -> Pillars:
    """The grid with ``shifts(pillar, dx, dy, dz)`` added to all points of a pillar; others stay."""
    points = grid.points.join(shifts, "pillar", "left").select("pillar", "boundary", *(F.expr(f"{c} + coalesce(d{c}, 0)").alias(c) for c in XYZ))
    return grid._replace(points=points)


def draped(grid: Pillars, triangles: DataFrame, boundary: int = 0) -> Pillars:
    """The grid with each pillar moved so that its point at ``boundary`` lies on the surface ``triangles(t, x0 ... z2)``.

    A pillar counts as the straight line through its first and last points, faults
    healed; split pillars move with the one that they are split from, so that throws and
    thicknesses along pillars stay. Of several hits that of the greatest t counts. Raises,
    when it runs, where a pillar with points has no hit or no point at the boundary.
    """
    healed = settled(unsplit_points(grid).filter("z is not null"))
    lines = _ends(healed, boundary).withColumnRenamed("at0", "at")
    # lines reach as far as the surface does: two numbers
    ends = triangles.agg(F.min(F.least("z0", "z1", "z2")).alias("high"), F.max(F.greatest("z0", "z1", "z2")).alias("low"))
    rise = F.nullif(F.expr("b.z - a.z"), F.lit(0.0))
    reach = lambda c, end: F.col(f"a.{c}") + (F.col(end) - F.col("a.z")) * (F.col(f"b.{c}") - F.col(f"a.{c}")) / rise
    # a little room for what rounding does at the edges of triangles
    room = lambda c: (F.least(reach(c, "high"), reach(c, "low")) - 1e-6, F.greatest(reach(c, "high"), reach(c, "low")) + 1e-6)
    lines = lines.crossJoin(F.broadcast(ends)).withColumn("line", space.box(x=room("x"), y=room("y")))
    surface = triangles.withColumn("triangle", space.box(**{c: tuple(F.col(f"{c}{k}") for k in range(3)) for c in "xy"}))
    pairs = space.overlapping(lines.select("pillar", "a", "b", "line"), "line", surface, "triangle", "xy")
    at, way = tuple(F.col(f"a.{c}") for c in XYZ), tuple(F.col(f"b.{c}") - F.col(f"a.{c}") for c in XYZ)
    hits = with_hits(pairs, "u", at, way, *(tuple(F.col(f"{c}{k}") for c in XYZ) for k in range(3))).filter("u is not null")
    last = hits.groupBy("pillar").agg(F.max_by("u", "t").alias("u"))
    missed = F.raise_error(F.concat(F.lit("no point of the surface for pillar "), F.col("pillar").cast("string"))).cast("double")
    on = lines.join(last, "pillar", "left")
    shift = {c: F.coalesce(F.col(f"a.{c}") + F.col("u") * (F.col(f"b.{c}") - F.col(f"a.{c}")) - F.col(f"at.{c}"), missed).alias(f"d{c}") for c in XYZ}
    shifts = settled(on.select("pillar", *shift.values()))
    split = grid.splits.join(shifts.withColumnRenamed("pillar", "of"), "of").drop("of")
    return _moved(grid, settled(shifts.unionByName(split)))


def scaled_throws(grid: Pillars, factor: float, boundary: int = 0, reach: int = 0) -> Pillars:
    """The grid with throws, measured at ``boundary``, ``factor`` times as large, one shift for all layers of a pillar.

    Points without geometry there leave their pillar as it is. With ``reach``, pillars up
    to so many cells away follow by a share that shrinks with every step: the mean over
    the cells around of what their neighbours have moved, along their own slope.
    """
    plain = settled(_plain(grid))
    top = unsplit_points(grid).filter(F.col("boundary") == boundary).select(F.col("pillar").alias("plain"), *(F.col(c).alias(f"m{c}") for c in XYZ))
    torn = grid.splits.select("pillar", F.col("of").alias("plain")).unionByName(grid.splits.select(F.col("of").alias("pillar"), F.col("of").alias("plain")).distinct())
    own = grid.points.filter(F.col("boundary") == boundary).select("pillar", *XYZ)
    shifts = torn.join(own, "pillar", "left").join(top, "plain", "left").select("pillar", "plain", *(F.coalesce((F.col(c) - F.col(f"m{c}")) * (factor - 1.0), F.lit(0.0)).alias(f"d{c}") for c in XYZ))
    shifts = settled(shifts)
    if reach:
        other = plain.select("j", "i", F.col("jp").alias("jp1"), F.col("ip").alias("ip1"), F.col("pillar").alias("by"))
        beside = plain.select("j", "i", "jp", "ip", "plain").join(other, ["j", "i"]).filter("(jp = jp1) <> (ip = ip1)").select("plain", "by")
        ends = _ends(grid.points)
        slopes = ends.select("pillar", *(F.coalesce(F.expr(f"(b.{c} - a.{c}) / nullif(b.z - a.z, 0)"), F.lit(0.0)).alias(f"s{c}") for c in "xy"))
        beside, slopes = settled(beside), settled(slopes)
    for left in range(reach, 0, -1):
        decay = (2.0**left - 1.0) / (2.0 ** (left + 1) - 1.0)
        near = beside.join(shifts.select(F.col("pillar").alias("by"), "dz"), "by").join(shifts.select("plain").distinct(), "plain", "left_anti")
        new = near.groupBy("plain").agg((F.avg("dz") * decay).alias("dz")).withColumn("pillar", F.col("plain")).join(slopes, "pillar")
        shifts = settled(shifts.unionByName(new.select("pillar", "plain", (F.col("dz") * F.col("sx")).alias("dx"), (F.col("dz") * F.col("sy")).alias("dy"), "dz")))
    return _moved(grid, shifts.drop("plain"))


def interpolated(a: Pillars, b: Pillars, nj: int, ni: int, share: float = 0.5, tolerance: float = 0.01) -> Pillars:
    """The grid between two of the same extent, at ``share`` of the way from ``a`` to ``b``.

    Cells' corners are taken on the way and stand on pillars anew, so that a pillar is
    split where either grid's is, unless what remains of the throw is within ``tolerance``.
    Cells with a corner that has no geometry in either grid have none between them.
    """
    if not 0.0 <= share <= 1.0:
        raise ValueError("the share lies between 0 and 1")
    both = _at_places(a).join(_at_places(b).withColumnsRenamed({c: f"b{c}" for c in ("around", "sides", *XYZ)}), ["pj", "pi", "kk"])
    both = both.withColumns({"around": F.col("around").bitwiseAND(F.col("baround")), "sides": F.col("sides").bitwiseAND(F.col("bsides"))}).filter("around <> 0 and sides <> 0")
    both = both.select("pj", "pi", "kk", "around", "sides", *((F.col(c) * (1.0 - share) + F.col(f"b{c}") * share).alias(c) for c in XYZ))
    own = lambda n, kp: F.expr(f"shiftright(around, {n}) & 1 = 1 and shiftright(sides, {kp}) & 1 = 1")
    mask = sum((F.when(own(n, kp), 1 << (2 * n + kp)).otherwise(0) for n, kp in SPOTS), F.lit(0))
    met = settled(both.groupBy("pj", "pi", "kk").agg(*spots(own, mask)))
    # cells with an undefined corner lose the others
    void = lambda n, kp: F.expr(f"mask & {1 << (2 * n + kp)} <> 0 and (" + " or ".join(f"{c}{n}{kp} is null or isnan({c}{n}{kp})" for c in XYZ) + ")")
    cell = [F.when(void(n, kp), F.struct((F.col("kk") - kp).alias("k"), (F.col("pj") - n // 2).alias("j"), (F.col("pi") - n % 2).alias("i"))) for n, kp in SPOTS]
    holes = met.select(F.explode(F.array_compact(F.array(*cell))).alias("c")).select("c.*").distinct()
    lost = [F.struct((F.col("k") + kp).alias("kk"), (F.col("j") + n // 2).alias("pj"), (F.col("i") + n % 2).alias("pi"), F.lit(1 << (2 * n + kp)).alias("bit")) for n, kp in SPOTS]
    holes = settled(holes.select(F.explode(F.array(*lost)).alias("l")).groupBy("l.pj", "l.pi", "l.kk").agg(F.bit_or("l.bit").alias("lost")))
    if holes.isEmpty():
        met = met.withColumn("lost", F.lit(0))
    else:
        met = met.join(holes, ["pj", "pi", "kk"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
        met = met.withColumns({f"{c}{n}{kp}": F.when(F.col("lost").bitwiseAND(1 << (2 * n + kp)) == 0, F.col(f"{c}{n}{kp}")) for n, kp in SPOTS for c in XYZ})
    live = {f"a{n}": F.expr(f"if(mask & {3 << (2 * n)} <> 0, mask & ~lost & {3 << (2 * n)} <> 0, null)") for n in range(4)}
    return pillars_at(met.withColumns(live).drop("lost"), nj, ni, tolerance=tolerance)


def _at_places(grid: Pillars) -> DataFrame:
    """pj, pi, kk (layers above), around (bits of the columns), sides (bit kp of the top below and the base above), x, y, z: the points as the corners of cells have them."""
    sides = layer_sides(grid.layers)
    top, base = (sides.select(F.col(c).alias("boundary"), "kk", F.lit(bit).alias("sides")).filter("boundary is not null") for c, bit in (("top", 1), ("base", 2)))
    sides = top.unionByName(base).groupBy("boundary", "kk").agg(F.bit_or("sides").alias("sides"))
    return grid.points.join(standing(grid), "pillar").join(F.broadcast(sides), "boundary").select("pj", "pi", "kk", "around", "sides", *XYZ)

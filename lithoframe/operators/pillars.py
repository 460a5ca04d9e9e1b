"""Grids from corner points: gaps between layers, pillars, split pillars, and which pillar each column's corner stands on.

``corners`` has a row for each corner of a cell: k, j, i, kp, jp, ip (0 or 1), x, y, z and,
if wanted, active. A pillar (j, i) is met by one to four columns. The column that leads it
is the first active one; others whose points lie within a tolerance of the leader's at
every layer boundary stand on the same pillar, the rest on split ones, which again are
shared by those that lie together. Cells are shuffled once, whole and by blocks; the places
where their corners meet are written down, and what follows are groupings by pillar over
them. What is broadcast has a row for each layer at most.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.storage import settled

#: The four corners around a pillar, in the order in which they are looked at.
AROUND = [(0, 0), (0, 1), (1, 0), (1, 1)]


class Pillars(NamedTuple):
    """``layers``: k, raw (its first boundary), gap_after. ``columns``: j, i, jp, ip, pillar. ``splits``: pillar (a number after those of all plain ones), of (the plain one it splits from). ``points``: pillar, boundary, x, y, z."""

    layers: DataFrame
    columns: DataFrame
    splits: DataFrame
    points: DataFrame


#: The corners of a cell (kp, jp, ip), in the order of the bits of its mask.
CELL = [(kp, jp, ip) for kp in (0, 1) for jp in (0, 1) for ip in (0, 1)]
#: Cells along each axis of a block, whose corners meet in one task.
BLOCK = 16


def packed(corners: DataFrame) -> DataFrame:
    """k, j, i, active, hole (a null or NaN among the corners), mask (bits of those there are, as ``CELL`` has them) and x000 ... z111: a row for each cell."""
    active = F.coalesce(F.col("active"), F.lit(True)) if "active" in corners.columns else F.lit(True)
    own = lambda p: (F.col("kp") == p[0]) & (F.col("jp") == p[1]) & (F.col("ip") == p[2])
    hole = F.lit(False)
    for c in "xyz":
        hole = hole | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    mask = F.coalesce(*(F.when(own(p), F.lit(1 << m)) for m, p in enumerate(CELL)))
    each = [F.max(F.when(own(p), F.col(c).cast("double"))).alias("{}{}{}{}".format(c, *p)) for p in CELL for c in "xyz"]
    return corners.groupBy("k", "j", "i").agg(F.max(active).alias("active"), F.max(hole).alias("hole"), F.bit_or(mask).alias("mask"), *each)


def _known(cells: DataFrame, treat_as_nan: str | None, dot_tolerance: float, morse_tolerance: float) -> DataFrame:
    """Packed cells with gone in place of hole, by the rules of ``defined``."""
    ends = {"main": ((0, 0, 0), (1, 1, 1)), "j0": ((0, 0, 0), (1, 0, 1)), "j1": ((0, 1, 0), (1, 1, 1)), "i0": ((0, 0, 0), (1, 1, 0)), "i1": ((0, 0, 1), (1, 1, 1))}
    wanted = {None: [], "inactive": [], "dots": ["main"], "ij_dots": ["j0", "j1", "i0", "i1"], "morse": ["j0", "j1", "i0", "i1"]}[treat_as_nan]
    step = lambda name, c: F.col("{}{}{}{}".format(c, *ends[name][1])) - F.col("{}{}{}{}".format(c, *ends[name][0]))
    drop = F.lit(treat_as_nan == "inactive")
    for name in wanted:
        drop = drop | ((F.abs(step(name, "x")) < dot_tolerance) & (F.abs(step(name, "y")) < dot_tolerance) & (F.abs(step(name, "z")) < dot_tolerance))
    if treat_as_nan == "morse":
        flat = lambda name: step(name, "x") * step(name, "x") + step(name, "y") * step(name, "y")
        longest = cells.filter(F.col("active") & ~F.col("hole")).agg(*(F.max(F.greatest(flat(f"{a}0"), flat(f"{a}1"))).alias(f"most_{a}") for a in "ji"))
        cells = cells.join(F.broadcast(longest))  # one row
        for a in "ji":
            drop = drop | (F.greatest(flat(f"{a}0"), flat(f"{a}1")) > morse_tolerance**2 * F.col(f"most_{a}"))
    cells = cells.withColumn("gone", F.col("hole") | (~F.col("active") & F.coalesce(drop, F.lit(False))))
    return cells.withColumn("active", F.col("active") & ~F.col("gone")).drop("hole", "most_j", "most_i")


def _spread(cells: DataFrame, *keys: str) -> DataFrame:
    """The corners of known cells again: k, j, i, kp, jp, ip, active, x, y, z, which are null in those without geometry."""
    each = [F.when(F.col("mask").bitwiseAND(1 << m) != 0, F.struct(*(F.lit(v).alias(a) for a, v in zip(("kp", "jp", "ip"), p)), *(F.col("{}{}{}{}".format(c, *p)).alias(c) for c in "xyz"))) for m, p in enumerate(CELL)]
    rows = cells.select("k", "j", "i", *keys, "active", "gone", F.explode(F.array_compact(F.array(*each))).alias("c"))
    return rows.select("k", "j", "i", *keys, "c.kp", "c.jp", "c.ip", *(F.when(~F.col("gone"), F.col(f"c.{c}")).alias(c) for c in "xyz"), "active")


def defined(corners: DataFrame, treat_as_nan: str | None = None, dot_tolerance: float = 1.0, morse_tolerance: float = 5.0) -> DataFrame:
    """``corners`` with active and x, y, z nulled in cells without geometry, which are inactive too.

    Those are cells with a null or NaN coordinate and, of the inactive ones, by
    ``treat_as_nan``: all ("inactive"), those whose main diagonal ("dots") or any of whose
    I or J face diagonals ("ij_dots") is shorter than ``dot_tolerance`` along every axis,
    and ("morse") also those with such a diagonal over ``morse_tolerance`` times as long,
    seen from above, as the longest of an active cell.
    """
    return _spread(_known(packed(corners), treat_as_nan, dot_tolerance, morse_tolerance))


#: What a place has of each column n around it: x, y, z of the base of the layer above (kp 1) and of the top of that below (kp 0).
SPOTS = [(n, kp) for n in range(4) for kp in (0, 1)]


def spots(own, mask: Column) -> list[Column]:
    """Aggregates of rows of corners into a place: mask (bit 2 n + kp of each spot that there is) and x00 ... z31; ``own(n, kp)`` tells whose row it is."""
    each = [F.max(F.when(own(n, kp), F.col(c))).alias(f"{c}{n}{kp}") for n, kp in SPOTS for c in "xyz"]
    return [F.bit_or(mask).alias("mask"), *each]


def places(cells: DataFrame) -> DataFrame:
    """pj, pi, kk (layers above), mask, x00 ... z31, a0 ... a3 (whether a column is active there): a row for each place where corners of known cells meet.

    A cell goes as one row to each block that its corners lie in, mostly one, and is
    spread there.
    """
    blocks = F.array_distinct(F.array(*(F.struct(*(F.floor((F.col(a) + d) / BLOCK).alias(f"b{a}") for a, d in zip("kji", p))) for p in CELL)))
    dealt = cells.withColumn("b", F.explode(blocks)).select("*", "b.*").drop("b").repartition("bk", "bj", "bi")
    at = _spread(dealt, "bk", "bj", "bi").withColumns({"kk": F.col("k") + F.col("kp"), "pj": F.col("j") + F.col("jp"), "pi": F.col("i") + F.col("ip"), "n": 2 * F.col("jp") + F.col("ip")})
    for a, b in (("kk", "bk"), ("pj", "bj"), ("pi", "bi")):
        at = at.filter(F.floor(F.col(a) / BLOCK) == F.col(b))
    mask = F.expr("shiftleft(1, 2 * n + kp)")
    live = [F.max(F.when(F.col("n") == n, F.col("active"))).alias(f"a{n}") for n in range(4)]
    return at.groupBy("bk", "bj", "bi", "pj", "pi", "kk").agg(*spots(lambda n, kp: (F.col("n") == n) & (F.col("kp") == kp), mask), *live).drop("bk", "bj", "bi")


def layer_gaps(places: DataFrame, max_void: float = 0.1) -> DataFrame:
    """k, gap_after and raw (the number of the layer's first boundary): a gap stands where a corner's base and the top below it are further apart than ``max_void`` along any axis."""
    void = F.greatest(*(F.abs(F.col(f"{c}{n}0") - F.col(f"{c}{n}1")) for n in range(4) for c in "xyz"))
    tops = sum(1 << (2 * n) for n in range(4))
    widest = places.groupBy("kk").agg(F.max(void).alias("void"), F.max(F.col("mask").bitwiseAND(tops) != 0).alias("top"))
    layers = widest.filter("top").select(F.col("kk").alias("k")).join(widest.select((F.col("kk") - 1).alias("k"), "void"), "k", "left")
    gap = F.coalesce(F.col("void") > max_void, F.lit(False))
    # a row for each layer
    above = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return layers.select("k", gap.alias("gap_after")).withColumn("raw", F.col("k") + F.coalesce(F.sum(F.col("gap_after").cast("long")).over(above), F.lit(0)))


def layer_sides(layers: DataFrame) -> DataFrame:
    """kk and its boundaries: base (of the layer above) and top (of that below), the same without a gap; null where there is no layer. Written once."""
    base = layers.select((F.col("k") + 1).alias("kk"), (F.col("raw") + 1).alias("base"))
    return settled(layers.select(F.col("k").alias("kk"), F.col("raw").alias("top")).join(base, "kk", "full").coalesce(1))


def boundary_points(places: DataFrame, layers: DataFrame) -> DataFrame:
    """pj, pi, boundary, there (bit n of each column that there is), p0 ... p3 (each column's own point) and a0 ... a3; points on either side of a closed void are moved to its middle."""

    def point(n: int, kind: str) -> Column:
        own = lambda c, kp: F.col(f"{c}{n}{kp}")
        if kind == "both":
            return F.struct(*(F.coalesce((own(c, 0) + own(c, 1)) / 2.0, own(c, 0), own(c, 1)).alias(c) for c in "xyz"))
        return F.struct(*(own(c, int(kind == "base")).alias(c) for c in "xyz"))

    def there(kind: str) -> Column:
        bits = {"both": 3, "base": 2, "top": 1}[kind]
        return sum((F.when(F.col("mask").bitwiseAND(bits << (2 * n)) != 0, 1 << n).otherwise(0) for n in range(4)), F.lit(0))

    side = lambda kind: F.struct(F.col("top" if kind == "top" else "base").alias("boundary"), there(kind).alias("there"), *(point(n, kind).alias(f"p{n}") for n in range(4)))
    sides = F.when(F.col("base") == F.col("top"), F.array(side("both"))).otherwise(F.array(side("base"), side("top")))
    at = places.join(F.broadcast(layer_sides(layers)), "kk").select("pj", "pi", *(f"a{n}" for n in range(4)), F.explode(sides).alias("s"))
    return at.select("pj", "pi", "s.*", *(f"a{n}" for n in range(4))).filter("there <> 0")


def _apart(a: str, b: str) -> Column:
    return F.greatest(*(F.abs(F.col(a)[c] - F.col(b)[c]) for c in "xyz"))


def grid_pillars(corners: DataFrame, nj: int, ni: int, max_void: float = 0.1, split: bool = True, tolerance: float = 0.01, treat_as_nan: str | None = None, dot_tolerance: float = 1.0, morse_tolerance: float = 5.0) -> Pillars:
    """The pillars of a grid of ``nj`` by ``ni`` columns from the corner points of its cells.

    Voids between layers that nowhere exceed ``max_void`` are closed at their middle,
    others are gaps, with boundaries of their own. Pillars have the numbers
    j * (ni + 1) + i; split ones follow, in order. A point is null where no cell has
    geometry. A column that shares no defined point with the leader is on a split pillar.
    ``corners`` may be ``packed`` already, which spares a shuffle.
    """
    cells = corners if "x000" in corners.columns else packed(corners)
    met = places(_known(cells, treat_as_nan, dot_tolerance, morse_tolerance))
    return pillars_at(settled(met), nj, ni, max_void, split, tolerance)


def pillars_at(places: DataFrame, nj: int, ni: int, max_void: float = 0.1, split: bool = True, tolerance: float = 0.01) -> Pillars:
    """The pillars of a grid whose ``places`` are written down: several passes go over them."""
    layers = settled(layer_gaps(places, max_void).coalesce(1))
    at = boundary_points(places, layers)
    pairs = [(a, b) for a in range(4) for b in range(a)]
    by_pillar = at.groupBy("pj", "pi").agg(*(F.max(f"a{n}").alias(f"a{n}") for n in range(4)), *(F.max(_apart(f"p{a}", f"p{b}")).alias(f"d{b}{a}") for a, b in pairs))

    # null: no column there
    order = [F.when(F.col(f"a{n}").isNotNull(), F.struct((~F.col(f"a{n}")).alias("idle"), F.lit(n).alias("n"))) for n in range(4)]
    leader = F.array_min(F.array_compact(F.array(*order)))["n"]
    near = lambda a, b: F.coalesce(F.element_at("near", (a * 4 + b + 1).cast("int")), F.lit(False))
    matrix = F.array(*(F.lit(True) if a == b else F.col(f"d{min(a, b)}{max(a, b)}") <= tolerance for a in range(4) for b in range(4)))

    def step(state: Column, n: Column) -> Column:
        """The corners that lead split pillars so far, and which of them each corner uses (-1: the leader's)."""
        fits = F.filter(state["extras"], lambda e: near(n, e))
        place = F.when((F.lit(split) == F.lit(False)) | near(n, F.col("leader")), F.lit(-1)).when(F.size(fits) > 0, F.array_position(state["extras"], fits[0]).cast("int") - 1).otherwise(F.size(state["extras"]))
        there = F.element_at("there", (n + 1).cast("int"))
        more = F.when(there & (place == F.size(state["extras"])), F.concat(state["extras"], F.array(n))).otherwise(state["extras"])
        return F.struct(more.alias("extras"), F.concat(state["uses"], F.array(F.when(there, place))).alias("uses"))

    pairwise = by_pillar.select("pj", "pi", leader.alias("leader"), matrix.alias("near"), F.array(*(F.col(f"a{n}").isNotNull() for n in range(4))).alias("there"))
    start = F.struct(F.array().cast("array<int>").alias("extras"), F.array().cast("array<int>").alias("uses"))
    used = pairwise.withColumn("got", F.aggregate(F.array(*(F.lit(n) for n in range(4))), start, step)).select("pj", "pi", "leader", "got.extras", "got.uses")

    # dense numbers in the order of pillars: within a row of them, after the sums of the rows before, of which there are nj + 1
    rows = used.groupBy("pj").agg(F.sum(F.size("extras")).alias("in_row"))
    before = Window.orderBy("pj").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("pj", F.coalesce(F.sum("in_row").over(before), F.lit(0)).alias("rows_before"))
    along = Window.partitionBy("pj").orderBy("pi").rowsBetween(Window.unboundedPreceding, -1)
    numbered = used.withColumn("row_before", F.coalesce(F.sum(F.size("extras")).over(along), F.lit(0))).join(rows, "pj")
    plain = (F.col("pj") * (ni + 1) + F.col("pi")).cast("long")
    first = F.lit((nj + 1) * (ni + 1)) + F.col("rows_before") + F.col("row_before")
    pillars = settled(numbered.select("pj", "pi", plain.alias("plain"), first.cast("long").alias("first"), "leader", "extras", "uses"))

    corner = pillars.select("pj", "pi", "plain", "first", F.posexplode("uses").alias("n", "use")).filter(F.col("use").isNotNull())
    jp, ip = F.col("n").bitwiseAND(2) / 2, F.col("n").bitwiseAND(1)
    columns = corner.select(
        (F.col("pj") - jp).cast("long").alias("j"), (F.col("pi") - ip).cast("long").alias("i"), jp.cast("int").alias("jp"), ip.cast("int").alias("ip"), F.when(F.col("use") < 0, F.col("plain")).otherwise(F.col("first") + F.col("use")).alias("pillar")
    )
    splits = pillars.select("plain", "first", F.posexplode("extras").alias("e", "n")).select((F.col("first") + F.col("e")).alias("pillar"), F.col("plain").alias("of"))
    # whose points a pillar takes: its leader's, or the first of those on the split one
    heads = F.concat(F.array(F.struct(F.col("plain").alias("pillar"), F.col("leader").alias("n"))), F.transform("extras", lambda n, e: F.struct((F.col("first") + e).alias("pillar"), n.alias("n"))))
    own = at.join(pillars.select("pj", "pi", heads.alias("heads")), ["pj", "pi"]).select("boundary", "there", F.array(*(f"p{n}" for n in range(4))).alias("p"), F.explode("heads").alias("h"))
    points = own.filter(F.expr("shiftright(there, h.n) & 1 = 1")).select("h.pillar", "boundary", F.expr("p[h.n]").alias("own")).select("pillar", "boundary", "own.*")
    return Pillars(layers, columns, splits, points)


def corner_points(pillars: Pillars) -> DataFrame:
    """j, i, jp, ip, k (boundary), x, y, z: each column's corners as they stand on its pillars, as ``faults`` takes them."""
    return pillars.columns.join(pillars.points, "pillar").select("j", "i", "jp", "ip", F.col("boundary").alias("k"), "x", "y", "z")


def standing(pillars: Pillars) -> DataFrame:
    """pillar, plain (the one it is, or is split from), pj, pi and around (bit 2 jp + ip of each column that stands on it), written once."""
    n = F.expr("shiftleft(1, 2 * jp + ip)")
    own = pillars.columns.groupBy("pillar").agg(F.max(F.col("j") + F.col("jp")).alias("pj"), F.max(F.col("i") + F.col("ip")).alias("pi"), F.bit_or(n).alias("around"))
    return settled(own.join(pillars.splits.withColumnRenamed("of", "plain"), "pillar", "left").withColumn("plain", F.coalesce("plain", "pillar")).coalesce(1))


def throws(pillars: Pillars, tolerance: float = 0.001) -> DataFrame:
    """j, i, axis, most, mean and least of the edges between columns that pillars split, as ``faults.throws`` has them.

    The columns around a place are brought together once; each edge there is a pair of them.
    """
    own = pillars.points.join(standing(pillars), "pillar")
    at = own.groupBy("plain", "boundary").agg(F.max("pj").alias("pj"), F.max("pi").alias("pi"), *(F.max(F.when(F.expr(f"shiftright(around, {n}) & 1 = 1"), F.col("z"))).alias(f"z{n}") for n in range(4)))
    # column n = 2 jp + ip has j = pj - jp and i = pi - ip
    edges = [F.struct((F.col("pj") - p // 2).alias("j"), (F.col("pi") - p % 2).alias("i"), F.lit(axis).alias("axis"), F.abs(F.col(f"z{q}") - F.col(f"z{p}")).alias("size")) for axis, p, q in (("i", 1, 0), ("i", 3, 2), ("j", 2, 0), ("j", 3, 1))]
    per = at.select(F.explode(F.array(*edges)).alias("e")).filter("e.size is not null").groupBy("e.j", "e.i", "e.axis")
    return per.agg(F.max("e.size").alias("most"), F.avg("e.size").alias("mean"), F.min("e.size").alias("least")).filter(F.col("most") > tolerance)

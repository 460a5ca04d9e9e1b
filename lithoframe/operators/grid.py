"""Cellular grids: neighbours, half-cell and face transmissibility, volumes, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.vectors import Vector, cross, dot, minus
from lithoframe.operators.steps import once

#: Darcy's constant with lengths in metres and feet.
DARCY = {"m": 8.527017e-5, "ft": 1.127116e-3}
TOLERANCE = 1e-9
AXES = {"k": ("j", "i"), "j": ("k", "i"), "i": ("k", "j")}


def half_transmissibility(axis: str, perm: Column, ntg: Column, lengths: dict[str, float], units: str = "m") -> Column:
    """Half-cell transmissibility of a regular grid; net to gross counts for J and I only."""
    a, b = AXES[axis]
    area = lengths[a] * lengths[b]
    t = perm * F.lit(DARCY[units] * area / (0.5 * lengths[axis]))
    return t if axis == "k" else t * ntg


def with_neighbour(cells: DataFrame, axis: str, columns: list[str]) -> DataFrame:
    """``cells`` with ``next_<column>`` of the neighbour one further along ``axis``, null where there is none."""
    w = Window.partitionBy(*AXES[axis]).orderBy(axis)
    there = F.lead(axis).over(w) == F.col(axis) + 1
    return cells.withColumns({f"next_{c}": F.when(there, F.lead(c).over(w)) for c in columns})


def series(a: Column, b: Column, multiplier: Column | float = 1.0) -> Column:
    """Transmissibility of two half cells in series; nothing passes where either is null, NaN or below tolerance."""
    closed = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b) | (a < TOLERANCE) | (b < TOLERANCE)
    return F.when(closed, F.lit(0.0)).otherwise(F.lit(multiplier) / (1.0 / a + 1.0 / b) if not isinstance(multiplier, Column) else multiplier / (1.0 / a + 1.0 / b))


def face_transmissibility(cells: DataFrame, axis: str, half: str) -> DataFrame:
    """A row for each internal face along ``axis`` with its transmissibility; ``half`` names the half-cell column."""
    faces = with_neighbour(cells, axis, ["cell_id", half]).filter(F.col("next_cell_id").isNotNull())
    return faces.withColumn("transmissibility", series(F.col(half), F.col(f"next_{half}")))


def irregular_half(half_vector: Vector, area: Vector, perm: Column, units: str = "m", tolerance: float = 1e-6) -> Column:
    """Half-cell transmissibility from the vector cell centre to face and the face's projected areas; null for degenerate cells."""
    d2 = dot(half_vector, half_vector)
    return F.when(d2 < tolerance * tolerance, F.lit(None)).otherwise(F.abs(F.lit(DARCY[units]) * perm * dot(half_vector, area) / d2))


def with_corners(corners: DataFrame) -> DataFrame:
    """k, j, i and p (map of kp, jp, ip as the digits of a string to struct x, y, z) of each cell of ``corners(k, j, i, kp, jp, ip, x, y, z)``."""
    place = F.concat(*(F.col(c).cast("string") for c in ("kp", "jp", "ip")))
    # eight entries
    return corners.groupBy("k", "j", "i").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("at"), F.struct(*(F.col(c).cast("double").alias(c) for c in "xyz")).alias("p")))).alias("p"))


def corner_halves(cells: DataFrame, perm: dict[str, Column], ntg: Column | float = 1.0, units: str = "m", tolerance: float = 1e-6) -> DataFrame:
    """``cells`` (with p, as ``with_corners`` has it) with half_<axis>_0 and half_<axis>_1, the half-cell transmissibilities of the lower and upper face along each axis.

    The half axis runs along the mean of an axis' four edges; a face's area is that of its
    two triangles, as seen along x, y and z. Each value is for the whole face; net to gross
    counts for J and I only. Null where the half axis is shorter than ``tolerance`` or a
    corner is undefined.
    """

    def at(axis: str, side: int, *others: int) -> Column:
        place = {axis: side} | dict(zip((x for x in "kji" if x != axis), others))
        return F.col("__p" + "".join(str(place[x]) for x in "kji"))

    of = lambda q: tuple(q[c] for c in "xyz")
    ring = [(0, 0), (0, 1), (1, 1), (1, 0)]
    places = [f"{k}{j}{i}" for k in (0, 1) for j in (0, 1) for i in (0, 1)]
    out = once(cells, **{f"__p{x}": F.col("p")[x] for x in places})
    for axis in "kji":
        held = {}
        edges = [minus(of(at(axis, 1, *r)), of(at(axis, 0, *r))) for r in ring]
        for n, c in enumerate("xyz"):
            held[f"__{axis}{c}"] = 0.125 * F.abs(edges[0][n] + edges[1][n] + edges[2][n] + edges[3][n])
        for side in (0, 1):
            a, b, c, d = (of(at(axis, side, *r)) for r in ring)
            first, second = cross(minus(b, a), minus(c, a)), cross(minus(c, a), minus(d, a))
            for n, x in enumerate("xyz"):
                held[f"__{axis}{side}{x}"] = 0.5 * (F.abs(first[n]) + F.abs(second[n]))
        # one axis at a time, as a longer step would be too much for one compiled method
        out = once(out, **held)
        way = tuple(F.col(f"__{axis}{c}") for c in "xyz")
        length2 = dot(way, way)
        net = F.lit(1.0) if axis == "k" else ntg if isinstance(ntg, Column) else F.lit(ntg)
        for side in (0, 1):
            area = tuple(F.col(f"__{axis}{side}{c}") for c in "xyz")
            out = out.withColumn(f"half_{axis}_{side}", F.when(length2 >= tolerance * tolerance, F.lit(DARCY[units]) * net * perm[axis] * dot(way, area) / length2))
        out = out.drop(*held)
    return out.drop(*(f"__p{x}" for x in places))


def corner_transmissibility(cells: DataFrame, axis: str) -> DataFrame:
    """A row for each face between a cell and the next one along ``axis``, from their halves (``corner_halves``); both cells hold the whole face."""
    faces = with_neighbour(cells, axis, ["cell_id", f"half_{axis}_0"]).filter(F.col("next_cell_id").isNotNull())
    return faces.withColumn("transmissibility", series(F.col(f"half_{axis}_1"), F.col(f"next_half_{axis}_0")))


def hexahedron_volume(p: dict[tuple[int, int, int], Vector]) -> Column:
    """Volume of a cell given by its eight corners (kp, jp, ip): six pyramids on bilinear faces about the mean of the corners."""
    centre = tuple(sum((q[c] for q in p.values()), F.lit(0.0)) / 8.0 for c in range(3))
    total = F.lit(0.0)
    faces = [
        ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)),
        ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)), ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)),
        ((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)),
    ]
    for a, b, c, d in (tuple(p[x] for x in f) for f in faces):
        ra, ab, ac, ad = minus(a, centre), minus(b, a), minus(c, a), minus(d, a)
        # both diagonals count half each: the mean of the two ways to halve the face
        first = dot(ra, cross(ab, ac)) + dot(ra, cross(ac, ad))
        rb, bc, bd = minus(b, centre), minus(c, b), minus(d, b)
        second = dot(rb, cross(bc, bd)) + dot(ra, cross(ab, ad))
        total = total + (first + second) / 2.0
    return F.abs(total) / 6.0


def with_volume(cells: DataFrame, corners: dict[tuple[int, int, int], Vector], out: str = "volume") -> DataFrame:
    """``cells`` with their volumes from the eight corners; corners are columns first, so that none is computed for each face anew."""
    names = {k: tuple(f"__{''.join(map(str, k))}{c}" for c in "xyz") for k in corners}
    placed = cells.withColumns({n: c for k, v in corners.items() for n, c in zip(names[k], v)})
    found = hexahedron_volume({k: tuple(F.col(n) for n in v) for k, v in names.items()})
    return placed.withColumn(out, found).drop(*(n for v in names.values() for n in v))


def thickness(tops: list[Column], bases: list[Column]) -> Column:
    """Mean difference of depth over a cell's pillars."""
    return sum((b - t for t, b in zip(tops, bases)), F.lit(0.0)) / float(len(tops))


def pinched_out(thick: Column, tolerance: float = 0.001) -> Column:
    """Cells without thickness (null or NaN), or of ``tolerance`` at most."""
    return thick.isNull() | F.isnan(thick) | (thick <= tolerance)


def column_inactive(cells: DataFrame, active: str = "active") -> DataFrame:
    """j, i and whether all cells of the column are inactive."""
    return cells.groupBy("j", "i").agg((~F.bool_or(active)).alias("inactive"))


def infilled(cells: DataFrame, tolerance: float = 0.01, sign: float = 1.0) -> DataFrame:
    """``cells(k, j, i, depth, thickness, x, y)`` with the geometry of inactive ones (depth 0 within ``tolerance``, or null) filled in.

    Between two active cells of a column the inactive ones share the void between them;
    above the first and below the last they are pinched out at its top and base. Depth
    grows with k, or falls (``sign`` -1). Columns without active cells stay as they are, and so do
    voids whose active cells overlap.
    """
    w = Window.partitionBy("j", "i").orderBy("k")
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("j", "i").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.coalesce(F.abs("depth") > tolerance, F.lit(False))
    own = F.when(active, F.struct("k", "depth", "thickness", "x", "y"))
    c = cells.withColumns({"__active": active, "__a": F.last(own, ignorenulls=True).over(back), "__b": F.last(own, ignorenulls=True).over(ahead)})
    top = F.col("__a.depth") + sign * F.col("__a.thickness") / 2.0
    base = F.col("__b.depth") - sign * F.col("__b.thickness") / 2.0
    count = F.col("__b.k") - F.col("__a.k") - 1
    each = sign * (base - top) / count
    nth = F.col("k") - F.col("__a.k") - 0.5
    void = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (each >= 0)
    overlaps = F.col("__a").isNotNull() & F.col("__b").isNotNull()

    def filled(between: Column, above: Column, below: Column, name: str) -> Column:
        return F.when(F.col("__active"), F.col(name)).when(void, between).when(overlaps, F.col(name)).when(F.col("__b").isNotNull(), above).when(F.col("__a").isNotNull(), below).otherwise(F.col(name))

    flat = lambda n: F.col(f"__a.{n}") + nth * (F.col(f"__b.{n}") - F.col(f"__a.{n}")) / count
    new = {
        "depth": filled(top + nth * each * sign, base, top, "depth"), "thickness": filled(each, F.lit(0.0), F.lit(0.0), "thickness"),
        "x": filled(flat("x"), F.col("__b.x"), F.col("__a.x"), "x"), "y": filled(flat("y"), F.col("__b.y"), F.col("__a.y"), "y"),
    }
    return c.select(*[x for x in cells.columns if x not in new], *(v.alias(k) for k, v in new.items()))


def pixel_map(quads: DataFrame, origin: tuple[float, float], width: int, height: int, dx: float, dy: float | None = None) -> DataFrame:
    """row, column of the pixels whose centres lie in a column of cells, with its j and i; ``quads`` has x0, y0 ... x3, y3 in order around it.

    Every quadrilateral is spread over the rows it covers and, along each, over its own span.
    """
    dy = dx if dy is None else dy
    xs, ys = [F.col(f"x{k}") for k in range(4)], [F.col(f"y{k}") for k in range(4)]
    first = lambda v, o, d: F.ceil((v - o) / d - 0.5)
    last = lambda v, o, d: F.floor((v - o) / d - 0.5)
    low, high = F.greatest(first(F.least(*ys), origin[1], dy), F.lit(0)), F.least(last(F.greatest(*ys), origin[1], dy), F.lit(height - 1))
    rows = quads.filter(low <= high).withColumn("row", F.explode(F.sequence(low, high)))
    y = origin[1] + (F.col("row") + 0.5) * dy
    spans = []
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
        t = (y - ys[a]) / F.nullif(ys[b] - ys[a], F.lit(0.0))
        spans.append(F.when((t >= 0) & (t <= 1), xs[a] + t * (xs[b] - xs[a])))
    left, right = F.greatest(first(F.least(*spans), origin[0], dx), F.lit(0)), F.least(last(F.greatest(*spans), origin[0], dx), F.lit(width - 1))
    found = rows.filter(left <= right).withColumn("column", F.explode(F.sequence(left, right)))
    # a pixel on the side of two columns goes to the first
    return found.groupBy("row", "column").agg(F.min(F.struct("j", "i")).alias("c")).select("row", "column", "c.j", "c.i")

"""Points in many polygons against the rules by hand, prisms against simple triangles, the two sides of a cut."""

import random

import pytest
from pyspark.sql import functions as F

from lithoframe.operators import faces, polygons, prisms


def _by_hand(x, y, ring):
    crossings = winding = 0
    for (ax, ay), (bx, by) in zip(ring[-1:] + ring[:-1], ring):
        if (ay <= y) != (by <= y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            crossings += 1
            winding += 1 if ay <= y else -1
    return crossings % 2 == 1, winding != 0


@pytest.mark.parametrize("bound", [2, 4096])
def test_polygons(spark, bound):
    rng = random.Random(bound)
    rings = {
        1: [(0, 0), (8, 0), (8, 8), (4, 2), (0, 8)],
        2: [(0, 4), (2, -4), (-4, 1), (4, 1), (-2, -4)],
        3: [(8, 0), (16, 0), (16, 8), (8, 8)],
        4: [(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(60)],
        5: [(0, 0), (1e-3, 0), (1e-3, 1e-3)],
        6: [(-1000, -1000), (1000, -1000), (1000, 1000), (-1000, 1000)],
        7: [(3, 3), (5, 3)],
    }
    dots = [(n, x / 2, y / 2) for n, (x, y) in enumerate((x, y) for x in range(-10, 36) for y in range(-10, 20))]
    dots += [(10_000, 5e-4, 1e-4), (10_001, None, 1.0), (10_002, float("nan"), 0.5), (10_003, 999.0, 999.0), (10_004, 5000.0, 0.0)]
    vertices = [(p, n, float(x), float(y)) for p, ring in rings.items() for n, (x, y) in enumerate(ring)]
    at = spark.createDataFrame(dots, "id long, x double, y double")
    found = polygons.inclusion(at, spark.createDataFrame(vertices, "polygon long, seq long, x double, y double"), bound)
    want = {(p, n, *_by_hand(x, y, ring)) for p, ring in rings.items() for n, x, y in dots if x is not None and x == x and any(_by_hand(x, y, ring))}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # neighbours: a point on the side they share is in one of them
    shared = next(n for n, x, y in dots if (x, y) == (8.0, 4.0))
    assert [p for p, n, *_ in got if n == shared and p in (1, 3)] == [3]


def test_no_polygons(spark):
    at = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    none = spark.createDataFrame([], "polygon long, seq long, x double, y double")
    assert polygons.inclusion(at, none).count() == 0
    assert polygons.inclusion(at.filter("false"), spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 1.0), (1, 2, 2.0, 0.0)], none.schema)).count() == 0


def _prisms(spark, thick):
    side = 123.45
    height = side * 3**0.5 / 2
    p = [(0.0, 0.0), (side, 0.0), (side / 2, height), (side * 1.5, height)]
    rows = [(t, layer, *(c for n in ring for c in p[n]), 10.0, 20.0, 30.0, thick) for t, ring in enumerate(((0, 1, 2), (1, 2, 3))) for layer in (0, 1)]
    cells = spark.createDataFrame(rows, "t long, layer int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, p0 double, p1 double, p2 double, thick double")
    return cells, spark.createDataFrame([(0, 0, 1, 2), (1, 1, 2, 3)], "t long, n0 long, n1 long, n2 long"), side, height


def test_equilateral_prisms(spark):
    cells, triangles, side, height = _prisms(spark, 4.0)
    for n in range(3):
        length, flow = prisms.side_factors(n)
        assert [r[0] for r in cells.select(length / flow).collect()] == pytest.approx([side / (height / 3)] * 4)
    half = prisms.half_transmissibility(cells, ("p0", "p1", "p2"), "thick", 2.0)
    area = side * height / 2
    want = [2.0 * 20.0 * area / 2.0] * 2 + [2.0 * p * side / (height / 3) for p in (10.0, 20.0, 30.0)]
    assert all(r.half == pytest.approx(want) for r in half.collect())
    by_height = prisms.half_transmissibility(cells.withColumn("ntg", F.lit(0.5)), ("p0", "p1", "p2"), "thick", 2.0, perm_k="p0", ntg="ntg", by_height=True).first().half
    assert by_height == pytest.approx([want[0] / 2] * 2 + [2 * w for w in want[2:]])
    # the shared side is opposite corner 0 of one and corner 2 of the other
    assert [tuple(r) for r in prisms.shared_sides(triangles).collect()] == [(0, 0, 1, 2)]
    trans = {tuple(r)[:4]: r.trans for r in prisms.transmissibility(half, triangles).collect()}
    across = 1 / (1 / want[2] + 1 / want[4])
    assert trans == {(0, 0, 1, 0): pytest.approx(across), (0, 1, 1, 1): pytest.approx(across), (0, 0, 0, 1): pytest.approx(want[0] / 2), (1, 0, 1, 1): pytest.approx(want[0] / 2)}


def test_flat_prisms(spark):
    """Prisms without thickness have no vertical transmissibility; sides are what they are."""
    cells, triangles, *_ = _prisms(spark, 0.0)
    half = prisms.half_transmissibility(cells, ("p0", "p1", "p2"), "thick", 1.0)
    assert all(r.half[:2] == [None, None] and None not in r.half[2:] for r in half.collect())
    assert prisms.transmissibility(half, triangles).filter("trans is null").count() == 2


def test_sides_by_runs(spark):
    """A vertical cut with a gap of layers in one column; cells that are missing break a run."""
    at = [(k * 9 + j * 3 + i, k, j, i) for k in range(6) for j in range(3) for i in range(3) if not (j == 1 and i == 2 and k == 3)]
    cells = spark.createDataFrame(at, "cell_id long, k long, j long, i long")
    rows = [(k, j, 0, "i") for k in range(6) for j in range(3)]
    cut = spark.createDataFrame(rows + rows[:3], "k long, j long, i long, axis string")
    sided, curtain = faces.sides(cells, cut)
    assert curtain.first()[0] is False and {r.cell_id for r in sided.filter("not upper" if sided.filter("cell_id = 0 and upper").count() else "upper").collect()} == {c for c, k, j, i in at if i > 0}
    whole = spark.createDataFrame([(k * 9 + j * 3 + i, k, j, i) for k in range(6) for j in range(3) for i in range(3)], cells.schema)
    assert faces.sides(whole, cut)[1].first()[0] is True
    # the same mixture of steps as cells one by one give
    step = [(2 if i < 2 else 3, j, i, "k") for j in range(3) for i in range(3)] + [(3, j, 1, "i") for j in range(3)]
    sided, _ = faces.sides(whole, spark.createDataFrame(step, cut.schema))
    assert {r.cell_id for r in sided.filter("upper").collect()} == {k * 9 + j * 3 + i for k in range(6) for j in range(3) for i in range(3) if k <= (2 if i < 2 else 3)}

"""Small exact cases."""

import math

import pytest
from pyspark.sql import functions as F

from lithoframe.functions.crs import Crs
from lithoframe.functions.text import prime_factors
from lithoframe.functions.units import converted, parsed
from lithoframe.operators import catalogue, connections, grid, lines, nearest, properties, scaling, surfaces, timeseries, wells


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_unit_cube(spark):
    p = {(k, j, i): (F.lit(float(i)), F.lit(float(j)), F.lit(float(k))) for k in (0, 1) for j in (0, 1) for i in (0, 1)}
    assert one(spark, grid.hexahedron_volume(p))[0] == pytest.approx(1.0)


def test_transmissibility_of_equal_cells(spark):
    cells = spark.range(8).selectExpr("id as cell_id", "id div 4 as k", "(id div 2) % 2 as j", "id % 2 as i").withColumn("half", F.lit(2.0))
    for axis in "kji":
        t = grid.face_transmissibility(cells, axis, "half").collect()
        assert len(t) == 4 and all(r.transmissibility == 1.0 for r in t)


def test_closed_faces(spark):
    assert one(spark, grid.series(F.lit(None).cast("double"), F.lit(1.0)))[0] == 0.0
    assert one(spark, grid.series(F.lit(1e-12), F.lit(1.0)))[0] == 0.0


def test_crs_there_and_back(spark):
    crs = Crs(1.0, 2.0, 3.0, 0.4, z_up=True, axis_order="northing easting")
    back = crs.to_global(crs.to_local((F.lit(5.0), F.lit(6.0), F.lit(7.0))))
    assert list(one(spark, *back)) == pytest.approx([5.0, 6.0, 7.0])


def test_units(spark):
    df = spark.createDataFrame([(1, 32.0, "degF", "degC"), (2, 1.0, "ft", "m"), (3, 1.0, "ft", "d"), (4, 1.0, "none", "m")], "id int, x double, a string, b string")
    got = {r.id: r.y for r in converted(df, "x", "a", "b", "y").collect()}
    assert got[1] == pytest.approx(0.0) and got[2] == 0.3048 and got[3] is None and got[4] is None
    assert one(spark, parsed(F.lit("[Days]")), parsed(F.lit("D")), parsed(F.lit("d")))[0:3] == ("d", "D", "d")


def test_normalised(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (3.0,), (float("nan"),)], "v double")
    got = [r.n for r in properties.normalised(df, "v", "n").collect()]
    assert got == [0.0, 0.25, 1.0, None]
    assert [r.n for r in properties.normalised(df, "v", "n", zero_at=0.0).collect()][:3] == [0.0, 0.0, 1.0]
    assert [r.n for r in properties.normalised(df, "v", "n", zero_at=0.5).collect()][1] == 0.5
    assert [r.n for r in properties.normalised(df, "v", "n", log=True).collect()][2] == 1.0


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 0), ("a", 10), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 4, "x"), ("a", 6, "y"), ("a", 10, "z")], "k string, t int, v string")
    got = {(r.k, r.t): (r.before_v, r.after_v) for r in timeseries.as_of(left, right, "k", "t", ["v"]).collect()}
    assert got == {("a", 5): ("x", "y"), ("a", 0): (None, "x"), ("a", 10): ("z", "z"), ("b", 1): (None, None)}


def test_straight_well(spark):
    s = spark.createDataFrame([("w", 0.0, 0.0, 0.0), ("w", 10.0, 0.0, 0.0), ("w", 20.0, 90.0, 90.0)], "well string, md double, inclination double, azimuth double")
    got = sorted(wells.minimum_curvature(s).select("md", "x", "y", "z").collect())
    assert got[1].z == pytest.approx(10.0)
    assert got[2].x == pytest.approx(20 / math.pi) and got[2].y == pytest.approx(0.0, abs=1e-9)


def test_overlaps_cross_tiles(spark):
    a = spark.createDataFrame([("w", 0.0, 25.0)], "well string, md0 double, md1 double")
    b = spark.createDataFrame([("w", 5.0, 15.0), ("w", 20.0, 30.0), ("w", 25.0, 26.0)], "well string, b_md0 double, b_md1 double")
    got = sorted((r.b_md0, r.overlap) for r in wells.overlaps(a, b, "well", 7.0).collect())
    assert got == [(5.0, 10.0), (20.0, 5.0)]


def test_flow_capacity(spark):
    none = F.lit(None).cast("double")
    k = [wells.flow_capacity(F.lit(2.0), F.lit(4.0), F.lit(9.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)), wells.flow_capacity(F.lit(2.0), none, F.lit(9.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)), wells.flow_capacity(F.lit(3.0), F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(0.5), F.lit(0.1))]
    got = one(spark, *k)
    assert got[0] == 12.0 and got[1] == 0.0 and got[2] == pytest.approx(15.0)


def test_pinch_outs_and_shadow(spark):
    cells = spark.createDataFrame([(k, k, 0, 0, k in (1, 2), k == 2) for k in range(5)], "cell_id int, k int, j int, i int, thin boolean, face boolean")
    assert [tuple(r) for r in connections.pinch_outs(cells, "thin").collect()] == [(0, 3, 2)]
    assert [r.shadow for r in connections.shadow(cells, "face").orderBy("k").collect()] == [1, 1, 1, 2, 2]


def test_multipliers(spark):
    f = spark.createDataFrame([(1, 0, 0.5), (1, 0, 0.25), (2, 0, None)], "cell_id int, axis int, multiplier double")
    for how, want in (("min", 0.25), ("max", 0.5), ("product", 0.125)):
        got = {r.cell_id: r.multiplier for r in connections.merged_multipliers(f, how).collect()}
        assert got == {1: want, 2: 1.0}
    with pytest.raises(Exception, match="a multiplier is negative"):
        connections.merged_multipliers(f.withColumn("multiplier", F.lit(-1.0)), "min").collect()


def test_labelled_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20) if k != 9], "a long, b long")
    got = {r.id: r.part for r in connections.labelled(edges, spark.range(21)).collect()}
    assert got == {k: 0 if k < 10 else 10 for k in range(21)}


def test_edges_of_a_square(spark):
    t = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "n0 int, n1 int, n2 int")
    assert surfaces.edges(t).count() == 5 and surfaces.rim(t).count() == 4


def test_polygon_edges(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    got = one(spark, *(surfaces.in_polygon(F.lit(x), F.lit(y), square) for x, y in ((0.5, 0.5), (1.0, 0.5), (0.0, 0.5), (0.5, 1.0), (0.5, 0.0), (2.0, 0.5))))
    assert list(got) == [True, False, True, False, True, False]


def test_references(spark):
    rels = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    got = {r.uuid: r.steps for r in catalogue.references(rels, spark.createDataFrame([("a",)], "uuid string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_references_of_any_length(spark):
    rels = spark.range(70).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst")
    got = {r.uuid: r.steps for r in catalogue.references(rels.coalesce(1), spark.sql("select '0' as uuid")).collect()}
    assert got == {str(k): k for k in range(71)}


def test_one_of(spark):
    c = spark.createDataFrame([("u1", 1), ("u2", 2)], "uuid string, created int")
    assert catalogue.one_of(c, "newest").first().uuid == "u2"
    with pytest.raises(ValueError):
        catalogue.one_of(c)
    assert catalogue.one_of(c, "none").count() == 0


def test_close_vertices(spark):
    v = spark.createDataFrame([("l", k, x, 0.0, 0.0) for k, x in enumerate([0.0, 0.05, 0.2, 0.25, 0.26])], "line string, seq int, x double, y double, z double")
    # where a vertex goes, the last one takes the place of the last kept
    assert sorted(r.seq for r in lines.without_close_vertices(v, 0.1).collect()) == [0, 4]
    assert sorted(r.seq for r in lines.without_close_vertices(v, 0.005).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.seq for r in lines.without_close_vertices(v.filter("seq < 2"), 1.0).collect()) == [0, 1]


def test_axis_orders(spark):
    p = (F.lit(1.0), F.lit(0.0), F.lit(0.0))
    c, s = math.cos(0.5), math.sin(0.5)
    # a left-handed system turns anticlockwise, a right-handed one clockwise
    assert list(one(spark, *Crs(rotation=0.5).to_local(p)))[:2] == pytest.approx([c, s])
    assert list(one(spark, *Crs(rotation=0.5, axis_order="northing easting").to_local(p)))[:2] == pytest.approx([s, c])
    assert list(one(spark, *Crs(axis_order="southing westing").to_local(p)))[:2] == pytest.approx([0.0, -1.0])
    with pytest.raises(ValueError):
        Crs(axis_order="up down")


def test_means_of_missing_values(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, None, 3.0), (1, nan, 4.0), (1, 6.0, None), (2, 1e-15, 1.0), (3, 1e30, 2.0), (4, 5.0, 0.0), (5, None, 1.0)], "k int, v double, w double")
    got = {r.k: r.m for r in df.groupBy("k").agg(scaling.weighted_mean(F.col("v"), F.col("w")).alias("m")).collect()}
    # weights of missing values count: 2 / (1 + 3 + 4)
    assert got == {1: 0.25, 2: 1e-15, 3: 1e30, 4: None, 5: 0.0}


def test_cycle_counts_all_remainders(spark):
    df = spark.createDataFrame([(3,), (9,)], "v int")
    assert [r.n for r in properties.normalised(df, "v", "n", cycle=7).collect()] == [3 / 6, 2 / 6]


def test_pinched_out(spark):
    got = one(spark, *(grid.pinched_out(F.lit(x).cast("double"), 0.5) for x in (0.4, 0.5, 0.6, float("nan"), None)))
    assert list(got) == [True, True, False, True, True]
    cells = spark.createDataFrame([(k, k, 0, 0, k in (1, 4), k != 3) for k in range(6)], "cell_id int, k int, j int, i int, thin boolean, active boolean")
    # 2 and 3 stand between: no connection over them, none from an inactive cell
    assert [tuple(r) for r in connections.pinch_outs(cells, "thin", "active").collect()] == [(0, 2, 1)]
    assert sorted(tuple(r) for r in connections.pinch_outs(cells, "thin").collect()) == [(0, 2, 1), (3, 5, 1)]


def test_gap_connections(spark):
    nan = float("nan")
    rows = [(0, 0, 0, 0, True, True, 1.0, 2.0), (1, 1, 0, 0, True, True, 2.0, 3.0), (2, 2, 0, 0, False, True, 3.5, 4.0), (3, 3, 0, 0, True, True, 4.0, nan), (4, 4, 0, 0, True, False, 5.0, 6.0)]
    cells = spark.createDataFrame(rows, "cell_id int, k int, j int, i int, gap boolean, active boolean, top double, base double")
    assert [tuple(r) for r in connections.gap_connections(cells, "gap", "base", "top", "active").collect()] == [(0, 1)]


def test_interval_for_md(spark):
    nodes = spark.createDataFrame([("w", 1.0), ("w", 2.0), ("w", 4.0), ("lone", 5.0)], "well string, md double")
    asked = spark.createDataFrame([(k, w, x) for k, (w, x) in enumerate([("w", 0.5), ("w", 1.0), ("w", 2.0), ("w", 3.0), ("w", 4.0), ("w", 4.5), ("none", 1.0), ("lone", 5.0), ("lone", 4.0)])], "id int, well string, md double")
    got = {r.id: (r.interval, r.fraction) for r in wells.interval_for_md(asked, nodes).collect()}
    assert got == {0: (-1, 0.0), 1: (0, 0.0), 2: (0, 1.0), 3: (1, 0.5), 4: (1, 1.0), 5: (-1, 1.0), 6: (-1, 0.0), 7: (-1, 1.0), 8: (-1, 0.0)}


def test_tangents_and_spline(spark):
    v = spark.createDataFrame([("l", 0, 0.0, 0.0, 0.0), ("l", 1, 1.0, 0.0, 0.0), ("l", 2, 1.0, 2.0, 0.0)], "line string, seq int, x double, y double, z double")
    middle = {w: lines.tangents(v, w).filter("seq = 1").first() for w in ("linear", "square", "cube")}
    for w, k in (("linear", 1), ("square", 0.5), ("cube", 0.25)):
        assert (middle[w].tx, middle[w].ty) == pytest.approx((1 / math.hypot(1, k), k / math.hypot(1, k)))
    ends = lines.tangents(v, closed=True).filter("seq = 0").first()
    assert (ends.tx, ends.ty) == pytest.approx(tuple(x / math.hypot(1 - 1 / math.sqrt(5), 2 / math.sqrt(5)) for x in (1 - 1 / math.sqrt(5), -2 / math.sqrt(5))))
    got = lines.splined(v, 1, longest=0.5, degrees=None).collect()
    assert sorted((r.seq, r.part) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    assert {(r.x, r.y) for r in got if r.part == 0} == {(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)}
    assert lines.splined(v.filter("seq < 2"), 1).count() == 2  # no turn, no further knots


def test_numbered(spark):
    names = spark.createDataFrame([(f"n{k:03}",) for k in range(300)] * 2, "name string").repartition(5)
    assert sorted((r.name, r.number) for r in connections.numbered(names, "name").collect()) == [(f"n{k:03}", k) for k in range(300)]


def test_closest_far_away(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 500.0, 0.0, 0.0)], "id int, x double, y double, z double")
    s = spark.createDataFrame([(7, 3.0, 4.0, -1.0, 3.0, 4.0, 1.0), (8, 300.0, 0.0, 0.0, 301.0, 0.0, 0.0)], "segment int, ax double, ay double, az double, bx double, by double, bz double")
    assert sorted(tuple(r) for r in lines.closest(p, s, 0.5).collect()) == [(1, 7, 5.0), (2, 8, 199.0)]
    assert lines.closest(p, s.limit(0), 0.5).count() == 0


def test_line_through_triangle(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    t = lines.line_hits_triangle(lit(0.2, 0.2, -1), lit(0, 0, 2), lit(0, 0, 0), lit(1, 0, 0), lit(0, 1, 0))
    miss = lines.line_hits_triangle(lit(0.8, 0.8, -1), lit(0, 0, 2), lit(0, 0, 0), lit(1, 0, 0), lit(0, 1, 0))
    assert list(one(spark, t, miss)) == [0.5, None]


def test_nearest_far_away(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    p = spark.createDataFrame([(7, 30.0, 40.0), (8, -60.0, 0.0)], "id int, x double, y double")
    assert tuple(nearest.nearest_xy(q, p, 0.5).first()) == (1, 7, 50.0)


def test_nearest_at_any_distance(spark):
    q = spark.sql("select * from values (1, 0d, 0d), (2, 1e4, -2e4), (3, null, 0d), (4, double('nan'), 0d) t(id, x, y)")
    p = spark.sql("select * from values (1, 0d, 1d), (7, 300d, 400d), (8, -600d, 0d) t(id, x, y)")
    got = {r.id: (r.nearest, r.distance) for r in nearest.nearest_xy(q, p, 0.05, other=True).collect()}
    assert set(got) == {1, 2} and got[1] == (7, 500.0) and got[2][0] == 1
    assert nearest.nearest_xy(q, p, 0.05).filter("id = 1").first().nearest == 1
    assert nearest.nearest_xy(q, p.limit(0), 0.05).count() == nearest.nearest_xy(q.limit(0), p.limit(0), 0.05).count() == 0


def test_dominant_and_stack(spark):
    df = spark.createDataFrame([(0, "b", 0), (0, "a", 1), (1, "c", 1)], "k int, zone string, r int")
    assert {r.k: r.zone for r in scaling.dominant(df, "k", "zone").collect()} == {0: "a", 1: "c"}
    assert {r.k: r["values"] for r in scaling.stacked(df, "k", "r", "zone", 2).collect()} == {0: ["b", "a"], 1: [None, "c"]}


def test_prime_factors(spark):
    got = one(spark, *(prime_factors(F.lit(n)) for n in (1, 2, 12, 49, 97)))
    assert [list(x) for x in got] == [[], [2], [2, 2, 3], [7, 7], [97]]


def test_connected_parts_of_a_permutation(spark):
    n = 400
    part = list(range(n))
    for _ in range(n):
        for a in range(n):
            part[a] = part[a * 7 % n] = min(part[a], part[a * 7 % n])
    nodes = spark.range(n)
    assert {r.id: r.part for r in connections.labelled(nodes.selectExpr("id as a", f"id * 7 % {n} as b"), nodes).collect()} == dict(enumerate(part))


def test_whole_queries_take_all_rows(spark):
    from conftest import DATA

    from lithoframe import registry

    q = registry.queries()
    cells = spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert q["downscale_refine"](spark, str(DATA)).select("cell_id").distinct().count() == cells
    assert q["grid_half_cell_irregular"](spark, str(DATA)).count() == cells
    layers = q["surface_lattice_hits"](spark, str(DATA)).selectExpr("x div 220 as k").distinct().count()
    assert layers == cells // 750


def _corner_rows(z, nk=2, nj=2, ni=2, active=lambda k, j, i: True):
    """Corner rows of a grid of unit cells; ``z`` gives a corner's depth."""
    from itertools import product

    return [(k, j, i, kp, jp, ip, float(i + ip), float(j + jp), z(k, j, i, kp, jp, ip), active(k, j, i)) for k, j, i in product(range(nk), range(nj), range(ni)) for kp, jp, ip in product(range(2), repeat=3)]


_CORNER = "k long, j long, i long, kp int, jp int, ip int, x double, y double, z double, active boolean"


def test_pillars_of_a_plain_grid(spark):
    from lithoframe.operators import pillars

    g = pillars.grid_pillars(spark.createDataFrame(_corner_rows(lambda k, j, i, kp, jp, ip: float(k + kp)), _CORNER), 2, 2)
    assert {(r.pillar, r.boundary, r.x, r.y, r.z) for r in g.points.collect()} == {(3 * j + i, b, float(i), float(j), float(b)) for j in range(3) for i in range(3) for b in range(3)}
    assert g.splits.count() == 0 and {(r.k, r.raw, r.gap_after) for r in g.layers.collect()} == {(0, 0, False), (1, 1, False)}
    assert {(r.j, r.i, r.jp, r.ip): r.pillar for r in g.columns.collect()} == {(j, i, jp, ip): 3 * (j + jp) + i + ip for j in range(2) for i in range(2) for jp in range(2) for ip in range(2)}


def test_pillars_split_by_tolerance(spark):
    """Depths on both sides of a rounding edge are one pillar; beyond the tolerance they are not, whatever lies between."""
    from lithoframe.operators import pillars

    shift = {(0, 0): 0.0049999, (0, 1): 0.0050001, (1, 0): 0.0141, (1, 1): 0.0240}
    df = spark.createDataFrame(_corner_rows(lambda k, j, i, kp, jp, ip: k + kp + shift[j, i]), _CORNER)
    g = pillars.grid_pillars(df, 2, 2)
    middle = {(r.j, r.i): r.pillar for r in g.columns.collect() if (r.j + r.jp, r.i + r.ip) == (1, 1)}
    # the leader is (1, 1), the first around the pillar; (1, 0) is within 0.01 of it, (0, 1) is 0.019 off and takes (0, 0) along
    assert middle[1, 1] == middle[1, 0] == 4 and middle[0, 1] == middle[0, 0] >= 9
    assert {r["of"] for r in g.splits.filter(f"pillar = {middle[0, 0]}").collect()} == {4}
    assert sorted(r.pillar for r in g.splits.collect()) == list(range(9, 9 + g.splits.count()))
    assert pillars.grid_pillars(df, 2, 2, split=False).splits.count() == 0


def test_pillars_with_gap_void_and_inactive(spark):
    from lithoframe.operators import pillars

    gap = pillars.grid_pillars(spark.createDataFrame(_corner_rows(lambda k, j, i, kp, jp, ip: 2.0 * k + kp), _CORNER), 2, 2)
    assert {(r.k, r.raw, r.gap_after) for r in gap.layers.collect()} == {(0, 0, True), (1, 2, False)}
    assert {r.z for r in gap.points.filter("pillar = 4").collect()} == {0.0, 1.0, 2.0, 3.0}
    void = pillars.grid_pillars(spark.createDataFrame(_corner_rows(lambda k, j, i, kp, jp, ip: 1.0 * k + kp + 0.05 * k), _CORNER), 2, 2)
    assert sorted(r.z for r in void.points.filter("pillar = 0").collect()) == pytest.approx([0.0, 1.025, 2.05])
    # a column without geometry: its neighbours lead, its own corner has no point
    hole = _corner_rows(lambda k, j, i, kp, jp, ip: None if (j, i) == (0, 0) else float(k + kp), active=lambda k, j, i: (k, j, i) != (1, 1, 1))
    g = pillars.grid_pillars(spark.createDataFrame(hole, _CORNER), 2, 2)
    assert {(r.pillar, r.boundary) for r in g.points.filter("z is null").collect()} >= {(0, b) for b in range(3)}
    assert g.points.filter("pillar < 9 and pillar > 0 and z is null").count() == 0
    for how, gone in (("inactive", True), ("dots", False), ("ij_dots", False), ("morse", False)):
        known = pillars.defined(spark.createDataFrame(hole, _CORNER), how)
        assert known.filter("k = 1 and j = 1 and i = 1 and z is null").count() == (8 if gone else 0)
    dot = _corner_rows(lambda k, j, i, kp, jp, ip: 0.0, active=lambda k, j, i: False)
    assert pillars.defined(spark.createDataFrame([(*r[:6], 0.0, 0.0, *r[8:]) for r in dot], _CORNER), "dots").filter("z is not null").count() == 0


def test_a_cut_that_leaks(spark):
    """Faces with a hole in them part nothing."""
    from lithoframe.operators import faces

    at = [(k * 4 + j * 2 + i, k, j, i) for k in range(2) for j in range(2) for i in range(2)]
    cells = spark.createDataFrame(at, "cell_id long, k long, j long, i long")
    cut = spark.createDataFrame([(0, j, i, "k") for j in range(2) for i in range(2)], "k long, j long, i long, axis string")
    sided, curtain = faces.sides(cells, cut)
    assert {r.cell_id for r in sided.filter("upper").collect()} == {0, 1, 2, 3} and not curtain.first()[0]
    with pytest.raises(ValueError):
        faces.sides(cells, cut.filter("i = 0"))

"""What round 4 found, on small inputs."""

from lithoframe.operators import wells


def test_parts_that_begin_at_one_md_are_one_interval(spark):
    """At this depth md can't tell where the planes of x and y are crossed; the part between them has no length."""
    rows = [(1, 1e9, 0.5, 0.5, 0.5), (1, 1e9 + 1, 1.5, 1.5 - 2e-9, 0.5)]
    stations = spark.createDataFrame(rows, "well int, md double, x double, y double, z double")
    got = wells.blocked(stations, {"i": 1.0, "j": 1.0, "k": 1.0}, {"i": 2, "j": 2, "k": 1}).orderBy("interval").collect()
    assert [(r.interval, r.md0, r.md1, r.k, r.j, r.i) for r in got] == [(0, 1e9, 1e9 + 0.5, 0, 0, 0), (1, 1e9 + 0.5, 1e9 + 1, 0, 0, 1)]


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_points_of_pillars_are_not_shuffled_again(spark):
    """Once cells have met, a grid's points take no shuffle of their own, those of derived grids one at most: disk is a small multiple of the cells."""
    from lithoframe.operators import derived, pillars

    rows = [(k, j, i, kp, jp, ip, (i + ip) * 10.0, (j + jp) * 10.0, k + kp + 2.0 * (i >= 1)) for k in range(2) for j in range(2) for i in range(2) for kp in (0, 1) for jp in (0, 1) for ip in (0, 1)]
    g = pillars.grid_pillars(spark.createDataFrame(rows, "k long, j long, i long, kp int, jp int, ip int, x double, y double, z double"), 2, 2)
    flat = spark.createDataFrame([(0, -50.0, -50.0, 5.0, 90.0, -50.0, 5.0, -50.0, 90.0, 5.0)], "t int, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    assert [_shuffles(p) for p in (g.points, g.columns, g.splits)] == [0, 0, 0]
    assert _shuffles(derived.unsplit(g).points) == 1
    assert _shuffles(derived.scaled_throws(g, 1.5, reach=1).points) == _shuffles(derived.draped(g, flat, 1).points) == 0
    assert _shuffles(derived.interpolated(g, derived.unsplit(g), 2, 2).points) == 0
    assert _shuffles(pillars.throws(g)) == 2
    assert {(r.j, r.i, r.axis, r.most) for r in pillars.throws(g).collect()} == {(0, 0, "i", 2.0), (1, 0, "i", 2.0)}


def test_interpolated_cells_without_geometry(spark):
    """A cell that has an undefined corner in either grid has none between them."""
    from lithoframe.operators import derived, pillars

    def grid(hole):
        rows = [(k, j, i, kp, jp, ip, (i + ip) * 10.0, (j + jp) * 10.0, None if (k, j, i) == hole else float(k + kp)) for k in range(2) for j in range(1) for i in range(2) for kp in (0, 1) for jp in (0, 1) for ip in (0, 1)]
        return pillars.grid_pillars(spark.createDataFrame(rows, "k long, j long, i long, kp int, jp int, ip int, x double, y double, z double"), 1, 2)

    got = {(r.pillar, r.boundary): r.z for r in derived.interpolated(grid(None), grid((1, 0, 1)), 1, 2).points.collect()}
    # the hole's column leads pillar 1, whose undefined point is a corner of the cell beside it too
    assert got[2, 1] == got[0, 1] == 1.0 and got[2, 2] is None and got[0, 2] is None


def test_hits_by_tile_are_grouped_without_a_shuffle(spark):
    """Triangles over several tiles hit what they hit without tiles; rows of hits stay where they are made."""
    from pyspark.sql import functions as F

    from lithoframe.operators import surfaces

    rows = [(t, -5.0 + t, 3.0, 1.0, 70.5, 10.25 + t, 2.0, 20.0, 80.0, 3.0) for t in range(3)]
    c = spark.createDataFrame(rows, "t int, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz"))
    plain, tiled = surfaces.hits_on_lattice(c, 66, 70), surfaces.hits_on_lattice(c, 66, 70, tiled=True)
    key = lambda df: sorted((r.t, r.x, r.y, r.z) for r in df.collect())
    assert key(tiled) == key(plain) and len(key(plain)) > 2000
    assert _shuffles(tiled.groupBy("tx", "ty", "x", "y").agg(F.max("z"))) == _shuffles(surfaces.grid_faces(tiled, 10, 0.5)) == 1


def test_fanned_triangles_need_all_their_nodes(spark):
    from lithoframe.operators import surfaces

    nodes = spark.createDataFrame([(n, float(n % 10), float(n // 10), 1.0 * n) for n in (0, 1, 2, 10, 11)], "node long, x double, y double, z double")
    got = {(r.n0, r.n1, r.n2, r.z0, r.z1, r.z2) for r in surfaces.fanned(nodes, [(0, 1, 11), (0, 11, 10)]).collect()}
    assert got == {(0, 1, 11, 0.0, 1.0, 11.0), (0, 11, 10, 0.0, 11.0, 10.0)}


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_volumes_send_no_table_through_the_driver(spark):
    from conftest import DATA

    from lithoframe.plans import structure

    assert _broadcasts(structure.unstructured_volume(spark, str(DATA))) == 0


def test_binary_arrays_are_not_sent_through_the_driver(spark):
    from conftest import DATA

    from lithoframe.plans import files

    assert _broadcasts(files.file_binary_arrays(spark, str(DATA))) == 0


def test_segments_lie_in_the_tiles_that_they_run_through(spark):
    """A diagonal runs through 28 of the 1000 tiles of its box at most; those that it touches stay."""
    from pyspark.sql import functions as F

    from lithoframe.operators import lines

    ends = {f"{c}0": 0.0 for c in "xyz"}
    s = spark.createDataFrame([(0.1, 0.3, 0.5, 9.7, 9.2, 9.9)], "ax double, ay double, az double, bx double, by double, bz double")
    for c in "xyz":
        s = s.withColumn(f"t{c}", F.explode(F.sequence(F.lit(0), F.lit(9))))
    got = {tuple(r) for r in s.filter(lines._runs_through(ends, 1.0)).select("tx", "ty", "tz").collect()}
    on = {tuple(int(a + n / 1000 * (b - a)) for a, b in ((0.1, 9.7), (0.3, 9.2), (0.5, 9.9))) for n in range(1001)}
    assert on <= got and len(got) <= 40


def test_nearest_of_many_points_in_one_tile(spark):
    """All points lie in a few hundredths of a tile; one far away widens the last rounds."""
    import random

    from lithoframe.operators.nearest import nearest_xy

    rnd = random.Random(4)
    rows = [(n, rnd.random(), rnd.random()) for n in range(400)] + [(400, 30.0, 30.0)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: r.nearest for r in nearest_xy(p, p, tile=50.0, other=True).collect()}
    assert got == {i: min((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, u, v in rows if j != i)[1] for i, x, y in rows}

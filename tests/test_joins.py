"""Joins in space and along a line against brute force, and how their pairs grow."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lithoframe.operators import intervals, space


def _boxes(spark, rows, name):
    df = spark.createDataFrame(rows, f"{name}_id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    return df.select(f"{name}_id", F.struct("x0", "x1", "y0", "y1", "z0", "z1").alias(name))


def _some(rng, n, spread, size):
    rows = []
    for k in range(n):
        low = [rng.gauss(0, spread) for _ in range(3)]
        rows.append((k, *(v for x in low for v in (x, x + rng.random() * size))))
    return rows


@pytest.mark.parametrize(("axes", "bound"), [("x", 4), ("xy", 4), ("xyz", 3), ("xy", 1000)])
def test_boxes(spark, axes, bound):
    rng = random.Random(bound)
    a = [*_some(rng, 60, 3.0, 2.0), *_some(rng, 40, 0.05, 0.05)]
    a = [(k, *r[1:]) for k, r in enumerate(a)] + [(900, -50.0, 50.0, -50.0, 50.0, -50.0, 50.0), (901, 99.0, 99.0, 99.0, 99.0, 99.0, 99.0), (902, *[None] * 6)]
    b = [*_some(rng, 150, 0.05, 0.02), *_some(rng, 50, 4.0, 1.0), *[(0, *[0.5] * 6)] * 3]
    b = [(k, *r[1:]) for k, r in enumerate(b)] + [(903, *[None] * 6)]
    got = space.overlapping(_boxes(spark, a, "a"), "a", _boxes(spark, b, "b"), "b", axes, bound).select("a_id", "b_id").collect()
    at = {"x": 1, "y": 3, "z": 5}
    meet = lambda p, q: None not in (p[1], q[1]) and all(p[at[c]] <= q[at[c] + 1] and q[at[c]] <= p[at[c] + 1] for c in axes)
    assert Counter(map(tuple, got)) == Counter((p[0], q[0]) for p in a for q in b if meet(p, q))


def test_no_boxes(spark):
    some, none = _boxes(spark, _some(random.Random(1), 5, 1.0, 1.0), "a"), _boxes(spark, [], "b")
    assert space.overlapping(some, "a", none, "b", "xy").count() == 0
    assert space.overlapping(none, "b", some, "a", "xy").count() == 0


def test_leaves_stay_small_where_it_is_dense(spark):
    """Ten times as dense a cluster makes about ten times as many rows in leaves, and none of them holds more."""
    most, rows = [], []
    for n in (400, 4000):
        dots = _boxes(spark, [(k, *(v for x in (random.Random(k).gauss(0, 0.01), random.Random(-k - 1).gauss(0, 0.01), 0.0) for v in (x, x))) for k in range(n)] + [(n, *[5.0] * 6)], "b")
        tree = space.tree_of(dots, "b", "xy", 16)
        per = space.dealt(dots, "b", tree).groupBy("level", "t_x", "t_y").count().agg(F.max("count"), F.sum("count")).first()
        most.append(per[0])
        rows.append(per[1])
    assert max(most) <= 16 and rows == [401, 4001]


def test_intervals(spark):
    rng = random.Random(7)
    ends = lambda scale: (lambda low, n: (low, low + n))(rng.uniform(-9, 9), rng.choice([0.0, 0.01, 1.0, 1.0, 30.0]) * rng.random() * scale)
    a = [(k, rng.randrange(3), *ends(1.0)) for k in range(150)] + [(200, 0, 0.0, 1.0), (201, 0, 1.0, 2.0), (202, 0, 1.0, 1.0), (203, 0, 2.0, 1.0), (204, 0, None, 1.0), (205, 1, -1e6, 1e6)]
    b = [(k, rng.randrange(3), *ends(0.3)) for k in range(150)] + [(300, 0, 1.0, 2.0), (301, 0, 0.0, 4.0), (302, 1, -1e-9, 1e-9), (303, 0, 1.0, float("nan"))]
    left, right = spark.createDataFrame(a, "a long, g int, a0 double, a1 double"), spark.createDataFrame(b, "b long, g int, b0 double, b1 double")
    got = intervals.overlapping(left, right, ["g"], ("a0", "a1"), ("b0", "b1")).collect()
    sound = lambda r: r[2] is not None and r[2] <= r[3]
    want = Counter((p[0], q[0]) for p in a for q in b if sound(p) and sound(q) and p[1] == q[1] and p[2] < q[3] and q[2] < p[3])
    assert Counter((r.a, r.b) for r in got) == want
    assert intervals.overlapping(left.limit(0), right, ["g"], ("a0", "a1"), ("b0", "b1")).count() == 0

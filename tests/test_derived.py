"""Grids with moved pillars against sums by hand."""

import pytest
from test_operators import _CORNER, _corner_rows

from lithoframe.operators import derived, pillars
from lithoframe.storage import settled


@pytest.fixture(scope="module")
def grid(spark):
    """4 x 4 columns, those from i = 2 on thrown down by 2; pillars lean in x by a tenth."""
    rows = _corner_rows(lambda k, j, i, kp, jp, ip: float(k + kp) + (2.0 if i >= 2 else 0.0), nk=2, nj=4, ni=4)
    rows = [(*r[:6], r[6] + 0.1 * (r[0] + r[3]), *r[7:]) for r in rows]
    g = pillars.grid_pillars(spark.createDataFrame(rows, _CORNER), 4, 4)
    return pillars.Pillars(*(settled(p) for p in g))


def _at(g):
    return {(r.pillar, r.boundary): (r.x, r.y, r.z) for r in g.points.collect()}


def test_unsplit(grid):
    assert grid.splits.count() == 5
    healed = derived.unsplit(grid)
    assert healed.splits.count() == 0 and healed.columns.filter("pillar > 24").count() == 0
    got = _at(healed)
    assert len(got) == 25 * 3 and {got[p * 5 + 2, 1][2] for p in range(5)} == {2.0} and got[1, 2][2] == 2.0 and got[4, 0][2] == 2.0


def test_scaled_throws(grid):
    plain, got = _at(grid), _at(derived.scaled_throws(grid, 2.0, reach=2))
    # the lower side leads the pillars of the fault
    by_column = {0: -1 / 7, 1: -3 / 7, 2: 1.0, 3: 3 / 7, 4: 1 / 7}
    for (p, b), (x, y, z) in got.items():
        shift = by_column[p % 5] if p < 25 else -1.0
        sx = 0.1 if p < 25 and p % 5 != 2 else 0.0
        assert (x, y, z) == pytest.approx((plain[p, b][0] + sx * shift, plain[p, b][1], plain[p, b][2] + shift))
    alone = _at(derived.scaled_throws(grid, 2.0))
    assert all(alone[p, b] == plain[p, b] for p, b in plain if p < 25 and p % 5 != 2)


def test_draped(spark, grid):
    """A sloping surface beyond the grid: points of the boundary lie on it, faults stay."""
    z = lambda x, y: 30.0 + 0.5 * x - 0.25 * y
    ring = [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0)]
    rows = [(t, *(v for x, y in three for v in (x, y, z(x, y)))) for t, three in enumerate((ring[:3], [ring[0], *ring[2:]]))]
    surface = spark.createDataFrame(rows, "t long, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    healed, moved = _at(derived.unsplit(derived.draped(grid, surface, 1))), _at(derived.draped(grid, surface, 1))
    assert all(healed[p, 1][2] == pytest.approx(z(*healed[p, 1][:2])) for p in range(25))
    # along the pillar
    before = _at(derived.unsplit(grid))
    assert all(healed[p, 1][0] - before[p, 1][0] == pytest.approx(0.1 * (healed[p, 1][2] - before[p, 1][2])) for p in range(25))
    assert all(moved[p, b + 1][2] - moved[p, b][2] == pytest.approx(1.0) for p in range(30) for b in (0, 1))
    assert all(moved[25 + n, 0][2] - moved[5 * n + 2, 0][2] == pytest.approx(-2.0) for n in range(5))
    with pytest.raises(Exception, match="no point of the surface"):
        derived.draped(grid, surface.filter("t = 0"), 1).points.collect()


def test_interpolated(grid):
    healed = derived.unsplit(grid)
    half = derived.interpolated(grid, healed, 4, 4)
    assert half.splits.count() == 5
    a, b = ({(r.j, r.i, r.jp, r.ip, r.k): r.z for r in pillars.corner_points(g).collect()} for g in (grid, healed))
    got = {(r.j, r.i, r.jp, r.ip, r.k): r.z for r in pillars.corner_points(half).collect()}
    assert got.keys() == a.keys() and all(got[c] == pytest.approx((a[c] + b[c]) / 2) for c in a)
    assert derived.interpolated(grid, healed, 4, 4, 1.0).splits.count() == 0
    with pytest.raises(ValueError):
        derived.interpolated(grid, healed, 4, 4, 1.5)

"""Queries on boxes, unstructured cells, faults, surfaces cut through grids, and wells in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators import boxes, faces, faults, grid, unstructured, wells
from lithoframe.operators.timeseries import looked_up
from lithoframe.plans import CELLS, NI, NJ, cells, q6, query, sq6, table
from lithoframe.plans.wells import SAMPLES, _samples

_BOX = {"k0": "l_linenumber % 4", "k1": "l_linenumber % 4 + l_suppkey % 3", "j0": "l_partkey % 9", "j1": "l_partkey % 9 + l_linenumber", "i0": "l_orderkey % 11", "i1": "l_orderkey % 11 + 3"}
_OTHER = {"k0": "l_suppkey % 5", "k1": "l_suppkey % 5 + 1", "j0": "l_partkey % 7", "j1": "l_partkey % 7 + 2", "i0": "l_orderkey % 8", "i1": "l_orderkey % 8 + l_linenumber"}


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    box = lambda b: F.struct(*(F.expr(v).cast("long").alias(k) for k, v in b.items()))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box(_BOX).alias("a"), box(_OTHER).alias("b"))


_BOXES = "b as (select l_orderkey, l_linenumber, " + ", ".join(f"({v})::bigint as {s}{k}" for s, x in (("a", _BOX), ("b", _OTHER)) for k, v in x.items()) + " from lineitem)"


@query(f"with {_BOXES} select l_orderkey, l_linenumber, " + ", ".join(f"{'least' if k[1] == '0' else 'greatest'}(a{k}, b{k}) as {k}" for k in _BOX) + " from b")
def box_union(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).withColumn("u", boxes.union("a", "b")).select("l_orderkey", "l_linenumber", "u.*")


@query(
    f"with {_BOXES}, n as (select *, " + " * ".join(f"greatest(0, least(a{x}1, b{x}1) - greatest(a{x}0, b{x}0) + 1)" for x in "kji") + " as shared, " + " * ".join(f"(a{x}1 - a{x}0 + 1)" for x in "kji") + " as own from b) "
    "select l_orderkey, sum(own)::bigint as own, sum(shared)::bigint as shared, count(*) filter (shared > 0)::bigint as meeting from n group by l_orderkey"
)
def box_intersection(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumn("s", boxes.intersection("a", "b"))
    return b.groupBy("l_orderkey").agg(F.sum(boxes.cells_in("a")).alias("own"), F.sum(boxes.cells_in("s")).alias("shared"), F.count("s").alias("meeting"))


@query(f"with {_BOXES} select l_orderkey, count(*) filter (l_orderkey % 5 between ak0 and ak1 and (l_orderkey + l_linenumber) % 12 between aj0 and aj1 and l_orderkey % 13 between ai0 and ai1)::bigint as held from b group by l_orderkey")
def box_holds(spark: SparkSession, d: str) -> DataFrame:
    """How many boxes of an order hold a cell."""
    o = F.col("l_orderkey")
    b = _boxes(spark, d).withColumn("held", boxes.holds("a", o % 5, (o + F.col("l_linenumber")) % 12, o % 13))
    return b.groupBy("l_orderkey").agg(F.count_if("held").alias("held"))


_FACE = "['K-', 'K+', 'J-', 'J+', 'I-', 'I+'][l_linenumber % 6 + 1]"


@query(
    f"with {_BOXES}, f as (select b.*, {_FACE} as face from b) select face, count(*)::bigint as faces from f where not ((face = 'K-' and ak0 <= 0) or (face = 'J-' and aj0 <= 0) or (face = 'I-' and ai0 <= 0) or (face = 'K+' and ak1 >= 4) or (face = 'J+' and aj1 >= 11) or (face = 'I+' and ai1 >= 12)) group by face"
)
def faces_inside(spark: SparkSession, d: str) -> DataFrame:
    """Face boxes without those on the outside of the grid."""
    f = _boxes(spark, d).select("a.*", F.expr("array('K-', 'K+', 'J-', 'J+', 'I-', 'I+')[l_linenumber % 6]").alias("face"))
    return boxes.without_external_faces(f, {"k": 5, "j": 12, "i": 13}).groupBy("face").agg(F.count("*").alias("faces"))


def _mesh(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cells as an unstructured grid: nodes on a sheared lattice, layers that thicken downwards."""
    c = cells(spark, d).select(F.col("cell_id").alias("cell"), "k", "j", "i")
    node = lambda k, j, i: (k * 1000 + j) * 1000 + i
    at = lambda dk, dj, di: node(F.col("k") + dk, F.col("j") + dj, F.col("i") + di)
    sides = []
    for n, axis in enumerate("kji"):
        for far in (0, 1):
            ring = [{axis: far} | dict(zip((x for x in "kji" if x != axis), p)) for p in ((0, 0), (0, 1), (1, 1), (1, 0))]
            sides.append(F.struct((at(*(far if x == axis else 0 for x in "kji")) * 3 + n).alias("face"), F.array(*(at(p["k"], p["j"], p["i"]) for p in ring)).alias("nodes")))
    used = c.select("cell", F.explode(F.array(*sides)).alias("f"))
    face_nodes = used.select("f.face", F.posexplode("f.nodes").alias("seq", "node")).distinct()
    n = face_nodes.select("node").distinct().withColumns({"k": F.expr("node div 1000000"), "j": F.expr("node div 1000 % 1000"), "i": F.expr("node % 1000")})
    nodes = n.select("node", (50.0 * F.col("i") + 3.0 * F.col("j")).alias("x"), (40.0 * F.col("j")).alias("y"), (5.0 * F.col("k") + 0.01 * F.col("k") * F.col("k") + 0.25 * F.col("i")).alias("z"))
    return used.select("cell", "f.face"), face_nodes, nodes


@query(f"with {CELLS} select cell_id as cell, {sq6('2000.0 * (5.0 + 0.01 * (2 * k + 1))')} as volume from cells")
def unstructured_volume(spark: SparkSession, d: str) -> DataFrame:
    """Volumes of polyhedra from their faces and nodes, against those of the layers they were made from."""
    return unstructured.volumes(*_mesh(spark, d)).select("cell", q6(F.col("volume")).alias("volume"))


@query(
    f"""with {CELLS}, f as (select unnest([[k, j, i, 0], [k + 1, j, i, 0], [k, j, i, 1], [k, j + 1, i, 1], [k, j, i, 2], [k, j, i + 1, 2]]) as f from cells), g as (select f, count(*) as n from f group by f)
    select ((f[1] * 1000 + f[2]) * 1000 + f[3]) * 3 + f[4] as face from g where n = 1"""
)
def unstructured_external_faces(spark: SparkSession, d: str) -> DataFrame:
    return unstructured.external_faces(_mesh(spark, d)[0])


@query(f"with {CELLS} select cell_id, {sq6('(i + 0.5) * 50.0')} as x, {sq6('(1500.0 + k * 5.0 + 1500.0 + (k + 1) * 5.0 + 2 * ntg) / 2')} as z, {sq6('(50.0 * 40.0 * (3.0 + ntg)) / 3')} as pyramid from cells")
def grid_cell_centre(spark: SparkSession, d: str) -> DataFrame:
    """Centres of cells from their eight corners, and the volume of a pyramid on a cell's base."""
    c = cells(spark, d)

    def corner(kp: int, jp: int, ip: int):
        return (F.col("i") + ip) * 50.0, (F.col("j") + jp) * 40.0, 1500.0 + (F.col("k") + kp) * 5.0 + F.col("ntg") * (0.5 + jp)

    x, _, z = unstructured.cell_centre([corner(k, j, i) for k in (0, 1) for j in (0, 1) for i in (0, 1)])
    flat = lambda jp, ip: ((F.col("i") + ip) * 50.0, (F.col("j") + jp) * 40.0, F.lit(0.0))
    apex = (F.col("i") * 50.0, F.col("j") * 40.0, 3.0 + F.col("ntg"))
    v = unstructured.pyramid_volume(apex, flat(0, 0), flat(0, 1), flat(1, 1), flat(1, 0))
    return c.select("cell_id", q6(x).alias("x"), q6(z).alias("z"), q6(v).alias("pyramid"))


#: Depth of a layer boundary at a pillar of a column: steps at i 10 and 20, another at j 12, which dies out, and a slope.
_Z = "k * 5.0 + (i // 10) * 3.0 * (1 + 0.01 * k) + case when j >= 12 and i < 10 then 0.25 * ip + 0.125 * i else 0.0 end + (j + jp) * 0.5"


def _corners(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).select("k", "j", "i").withColumn("jp", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("ip", F.explode(F.array(F.lit(0), F.lit(1))))
    return c.withColumn("z", F.expr(_Z.replace("//", "div"))).select("j", "i", "jp", "ip", "k", "z")


_CORNERS = f"c as (select j, i, jp, ip, k, {_Z} as z from cells, range(2) p(jp), range(2) q(ip))"
_OFFSETS = f"""{CELLS}, {_CORNERS}, o as (
    select a.j, a.i, 'i' as axis, b.z - a.z as d from c a join c b on b.j = a.j and b.i = a.i + 1 and b.k = a.k and a.ip = 1 and b.ip = 0 and a.jp = b.jp
    union all select a.j, a.i, 'j', b.z - a.z from c a join c b on b.j = a.j + 1 and b.i = a.i and b.k = a.k and a.jp = 1 and b.jp = 0 and a.ip = b.ip),
t as (select j, i, axis, max(abs(d)) as most, avg(abs(d)) as mean, min(abs(d)) as least from o group by j, i, axis having max(abs(d)) > 0.001)"""


@query(f"with {_OFFSETS} select j::bigint as j, i::bigint as i, axis, {sq6('most')} as most, {sq6('mean')} as mean, {sq6('least')} as least from t")
def fault_throws(spark: SparkSession, d: str) -> DataFrame:
    """Throws on the edges between columns whose pillars are split."""
    return faults.throws(_corners(spark, d)).select("j", "i", "axis", *(q6(F.col(c)).alias(c) for c in ("most", "mean", "least")))


@query(
    f"""with recursive {_OFFSETS}, e as (select j, i, axis, case when axis = 'j' then (j + 1) * {NI + 1} + i else j * {NI + 1} + i + 1 end as a, (j + 1) * {NI + 1} + i + 1 as b from t),
    b as (select a, b from e union select b, a from e), r as (select a as id, a as part from b union select r.id, b.b from r join b on r.part = b.a), m as (select id, min(part) as part from r group by id)
    select j::bigint as j, i::bigint as i, axis, m.part::bigint as fault from e join m on m.id = e.a"""
)
def fault_finding(spark: SparkSession, d: str) -> DataFrame:
    """Split edges put together to faults."""
    return faults.found_faults(_corners(spark, d), NI)


_SPLIT = "(j % 4) * 1.7 - 2.0"


@query(
    f"""with {CELLS}, a as (select j * 1000 + i as edge, k as k0, k * 5.0 as t0, k * 5.0 + 5.0 as b0, k * 5.0 + 0.3 * (i % 3) as t1, (k + 1) * 5.0 + 0.3 * (i % 3) as b1 from cells),
    b as (select j * 1000 + i as edge, k as k1, k * 5.0 + {_SPLIT} as u0, (k + 1) * 5.0 + {_SPLIT} as v0, k * 5.0 - 1.1 * (i % 5) + 0.7 as u1, (k + 1) * 5.0 - 1.1 * (i % 5) + 0.7 as v1 from cells),
    p as (select * from a join b using (edge) where least(t0, t1) < greatest(v0, v1) and least(u0, u1) < greatest(b0, b1)),
    c as (select *, list_sort(list_filter([0.0::double, {", ".join(f"case when ({x}0 - {y}0) * ({x}1 - {y}1) < 0 then ({x}0 - {y}0) / (({x}0 - {y}0) - ({x}1 - {y}1)) end" for x, y in (("t", "u"), ("b", "v"), ("t", "v"), ("u", "b")))}, 1.0::double], lambda s: s is not null)) as s from p),
    g as (select edge, k0, k1, t0, b0, t1, b1, u0, v0, u1, v1, list_transform(s, lambda x: greatest(0.0, least(b0 + x * (b1 - b0), v0 + x * (v1 - v0)) - greatest(t0 + x * (t1 - t0), u0 + x * (u1 - u0)))) as h, s from c),
    f as (select *, list_sum(list_transform(range(1, len(s)), lambda n: (s[n + 1] - s[n]) * (h[n] + h[n + 1]) / 2)) as shared from g),
    r as (select edge, k0, k1, shared / ((b0 - t0 + b1 - t1) / 2) as area0, shared / ((v0 - u0 + v1 - u1) / 2) as area1 from f)
    select edge::bigint as edge, k0::bigint as k0, k1::bigint as k1, {sq6('area0')} as area0, {sq6('area1')} as area1 from r where area0 > 1e-6 or area1 > 1e-6"""
)
def fault_juxtaposition(spark: SparkSession, d: str) -> DataFrame:
    """What lies against what across an edge, and over which fraction of either face."""
    c = cells(spark, d).withColumn("edge", F.col("j") * 1000 + F.col("i"))
    k, i, split = F.col("k") * 5.0, F.col("i"), F.expr(_SPLIT)
    own = {"t0": k, "b0": k + 5.0, "t1": k + 0.3 * (i % 3), "b1": k + 5.0 + 0.3 * (i % 3)}
    other = {"t0": k + split, "b0": k + 5.0 + split, "t1": k - 1.1 * (i % 5) + 0.7, "b1": k + 5.0 - 1.1 * (i % 5) + 0.7}
    layers = reduce(DataFrame.unionByName, (c.select("edge", F.lit(n).alias("column"), "k", *(v.alias(x) for x, v in side.items())) for n, side in enumerate((own, other))))
    edges = c.select("edge", F.lit(0).alias("column0"), F.lit(1).alias("column1")).distinct()
    return faults.juxtaposed(layers, edges).select("edge", "k0", "k1", q6(F.col("area0")).alias("area0"), q6(F.col("area1")).alias("area1"))


_EXTENT, _SIZE = {"k": 20, "j": 30, "i": 40}, {"k": 1.0, "j": 1.0, "i": 1.0}
_VERTICES = [("-1.3137", "-0.7211", "-0.4373"), ("1.1719", "-0.5237", "0.8117"), ("0.2341", "1.4139", "-0.6131")]
_CENTRE = {"x": "(c_custkey * 7919 % 4000) / 100.0", "y": "(c_custkey * 104729 % 3000) / 100.0", "z": "(c_custkey * 1299709 % 2000) / 100.0"}


def _triangles(spark: SparkSession, d: str) -> DataFrame:
    """A triangle for each customer, somewhere in a grid of 40 by 30 by 20 cells."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("t"), *((F.expr(_CENTRE[n]) + float(v[m])).alias(f"{n}{k}") for k, v in enumerate(_VERTICES) for m, n in enumerate("xyz")))


_TRI = "tri as (select c_custkey as t, " + ", ".join(f"{_CENTRE[n]} + {v[m]}::double as {n}{k}" for k, v in enumerate(_VERTICES) for m, n in enumerate("xyz")) + " from customer)"


def _axis_sql(axis: str) -> str:
    a, b = (x for x in "ijk" if x != axis)
    u, v, w = ({"i": "x", "j": "y", "k": "z"}[x] for x in (a, b, axis))
    return f"""select '{axis}' as axis, p as {a}, q as {b}, floor(s * {w}0 + r * {w}1 + (1 - s - r) * {w}2 - 0.5) as {axis} from (
        select *, (({v}1 - {v}2) * (p + 0.5 - {u}2) + ({u}2 - {u}1) * (q + 0.5 - {v}2)) / (({v}1 - {v}2) * ({u}0 - {u}2) + ({u}2 - {u}1) * ({v}0 - {v}2)) as s,
               (({v}2 - {v}0) * (p + 0.5 - {u}2) + ({u}0 - {u}2) * (q + 0.5 - {v}2)) / (({v}1 - {v}2) * ({u}0 - {u}2) + ({u}2 - {u}1) * ({v}0 - {v}2)) as r
        from (select *, unnest(range(greatest(0, floor(least({v}0, {v}1, {v}2)))::bigint, least({_EXTENT[b]}, ceil(greatest({v}0, {v}1, {v}2)) + 1)::bigint)) as q from (
              select *, unnest(range(greatest(0, floor(least({u}0, {u}1, {u}2)))::bigint, least({_EXTENT[a]}, ceil(greatest({u}0, {u}1, {u}2)) + 1)::bigint)) as p from tri))) where s >= 0 and r >= 0 and s + r <= 1"""


@query(f"with {_TRI}, " + ", ".join(f"f{a} as ({_axis_sql(a)})" for a in "kji") + " select distinct axis, k::bigint as k, j::bigint as j, i::bigint as i from (" + " union all ".join(f"select axis, k, j, i from f{a} where {a} >= 0 and {a} < {n} - 1" for a, n in _EXTENT.items()) + ")")
def surface_faces_by_axis(spark: SparkSession, d: str) -> DataFrame:
    """Faces of a grid, along all three axes, that stand for a surface."""
    t = _triangles(spark, d)
    return reduce(DataFrame.unionByName, (faces.surface_faces(t, _EXTENT, _SIZE, a).withColumn("axis", F.lit(a)) for a in "kji"))


_LEVEL = "greatest(0, least(nk - 2, nk // 2 - 1 + case when i >= 15 and j < 20 then 1 else 0 end))"


@query(f"with {CELLS} select cell_id, k <= {_LEVEL} as upper from cells, (select max(k) + 1 as nk from cells)")
def surface_sides(spark: SparkSession, d: str) -> DataFrame:
    """The two sides of a cut with a step in it."""
    c = cells(spark, d).select("cell_id", "k", "j", "i")
    c = c.crossJoin(F.broadcast(c.agg((F.max("k") + 1).alias("nk"))))
    level = lambda dj=0, di=0: F.expr(_LEVEL.replace("//", "div").replace("i >= 15", f"i + {di} >= 15").replace("j < 20", f"j + {dj} < 20"))
    cut = c.filter(F.col("k") == level()).select("k", "j", "i", F.lit("k").alias("axis"))
    for axis, there in (("j", level(dj=1)), ("i", level(di=1))):
        between = (F.col("k") > F.least(level(), there)) & (F.col("k") <= F.greatest(level(), there))
        cut = cut.unionByName(c.filter(between).select("k", "j", "i", F.lit(axis).alias("axis")))
    return faces.sides(c.drop("nk"), cut)[0]


@query(
    f"""with {SAMPLES}, c as (select well, md as md0, lead(md) over q as md1 from samples where event_type in ('error', 'purchase') window q as (partition by well order by md)),
    p as (select well, md as p0, lead(md) over q as p1, value from samples where event_type in ('click', 'view', 'signup') window q as (partition by well order by md)),
    s as (select c.well, md0, md1, sum(least(md1, p1) - greatest(md0, p0)) as length from c join p on c.well = p.well and p0 < md1 and md0 < p1 where md1 is not null and p1 is not null and value > 40 group by 1, 2, 3)
    select well, {sq6('md0')} as md0, {sq6('length')} as length, {sq6('least(1.0, length / (md1 - md0))')} as fraction from s where length >= 0.01"""
)
def well_perforations(spark: SparkSession, d: str) -> DataFrame:
    """Length and fraction of the intervals that perforations open."""
    s = _samples(spark, d)
    own = wells.intervals(s.filter("event_type in ('error', 'purchase')"), "well", "md").select("well", "md0", "md1")
    open_ = wells.intervals(s.filter("event_type in ('click', 'view', 'signup')"), "well", "md").filter("value > 40").select("well", F.col("md0").alias("b_md0"), F.col("md1").alias("b_md1"))
    return wells.perforated(own, open_).select("well", *(q6(F.col(c)).alias(c) for c in ("md0", "length", "fraction")))


_BLOCKED = {"i": 2.0, "j": 3.0, "k": 25.0}
_CELLS = {"i": 30, "j": 25, "k": 200}
_PATH = {"x": "value * 0.6 + 0.137", "y": "(event_id % 17) * 4.1 + 0.219", "z": "md * 1.0 + 0.013"}


def _cut_sql(a: str, c: str) -> str:
    low, high = f"least({c}, n{c})", f"greatest({c}, n{c})"
    n = _BLOCKED[a]
    return f"case when n{c} <> {c} then list_transform(range(greatest(0, ceil({low} / {n}))::bigint, least({_CELLS[a]}, floor({high} / {n}))::bigint + 1), lambda p: (p * {n} - {c}) / (n{c} - {c})) else [] end"


_BLOCKS = f"""with {SAMPLES}, s as (select well, md, {", ".join(f"{v} as {c}" for c, v in _PATH.items())} from samples),
    n as (select *, {", ".join(f"lead({c}) over w as n{c}" for c in ("md", "x", "y", "z"))} from s window w as (partition by well order by md)),
    c as (select *, list_sort(list_distinct([0.0::double, 1.0::double] || {" || ".join(_cut_sql(a, c) for a, c in (("i", "x"), ("j", "y"), ("k", "z")))})) as t from n where nmd > md),
    u as (select *, unnest(range(1, len(t))) as m from c), p as (select *, t[m] as t0, t[m + 1] as t1 from u),
    q as (select well, md + t0 * (nmd - md) as md0, md + t1 * (nmd - md) as md1, {", ".join(f"floor(({c} + (t0 + t1) / 2 * (n{c} - {c})) / {_BLOCKED[a]})::bigint as {a}" for a, c in (("i", "x"), ("j", "y"), ("k", "z")))} from p),
    g as (select *, sum(fresh) over (partition by well order by md0) as run from (select *, case when lag(k) over w is not distinct from k and lag(j) over w is not distinct from j and lag(i) over w is not distinct from i then 0 else 1 end as fresh from q window w as (partition by well order by md0))),
    r as (select well, run, min(md0) as md0, max(md1) as md1, any_value(k) as k, any_value(j) as j, any_value(i) as i from g where {" and ".join(f"{a} between 0 and {n - 1}" for a, n in _CELLS.items())} group by well, run)"""


def _blocked(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d).select("well", "md", *(F.expr(v).alias(c) for c, v in _PATH.items()))
    return wells.blocked(s, _BLOCKED, _CELLS)


@query(_BLOCKS + f" select well, row_number() over (partition by well order by run) - 1 as interval, {sq6('md0')} as md0, {sq6('md1')} as md1, k, j, i from r")
def well_blocked(spark: SparkSession, d: str) -> DataFrame:
    """The cells that trajectories run through."""
    return _blocked(spark, d).select("well", F.col("interval").cast("long").alias("interval"), q6(F.col("md0")).alias("md0"), q6(F.col("md1")).alias("md1"), *"kji")


_SHEAR = {"x": "x + 0.05 * z + 0.1 * y", "y": "y", "z": "z + 0.2 * x - 0.1 * y"}
_IN_CELLS = _BLOCKS.replace(" and ".join(f"{a} between 0 and {n - 1}" for a, n in _CELLS.items()), "(k, j, i) in (select (k, j, i) from cells)").replace("with ", f"with {CELLS}, ", 1)


@query(_IN_CELLS + f" select well, row_number() over (partition by well order by run) - 1 as interval, {sq6('md0')} as md0, {sq6('md1')} as md1, k, j, i from r")
def well_blocked_in_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells of a sheared grid, known by their corners, that equally sheared trajectories run through: those of the plain ones."""
    sheared = lambda df: df.select("*", *(F.expr(e).alias(f"s{c}") for c, e in _SHEAR.items())).drop("x", "y", "z").withColumnsRenamed({f"s{c}": c for c in "xyz"})
    c = cells(spark, d).select("k", "j", "i")
    for side in ("kp", "jp", "ip"):
        c = c.withColumn(side, F.explode(F.array(F.lit(0), F.lit(1))))
    corners = c.select("*", *(((F.col(a) + F.col(f"{a}p")) * _BLOCKED[a]).alias(x) for a, x in (("i", "x"), ("j", "y"), ("k", "z"))))
    s = _samples(spark, d).select("well", "md", *(F.expr(v).alias(x) for x, v in _PATH.items()))
    b = wells.blocked_in_cells(sheared(s), sheared(corners))
    return b.select("well", "interval", q6(F.col("md0")).alias("md0"), q6(F.col("md1")).alias("md1"), *"kji")


@query(_BLOCKS + f", {CELLS} select r.well, count(*)::bigint as intervals, count(c.perm)::bigint as known, {sq6('coalesce(sum(c.perm * (md1 - md0)), 0.0)')} as kh from r left join cells c on c.k = r.k and c.j = r.j and c.i = r.i group by r.well")
def well_property_at_cells(spark: SparkSession, d: str) -> DataFrame:
    """A property of the cells along a well."""
    w = wells.at_cells(_blocked(spark, d), cells(spark, d).select("k", "j", "i", "perm"))
    return w.groupBy("well").agg(F.count("*").alias("intervals"), F.count("perm").alias("known"), q6(F.coalesce(F.sum(F.col("perm") * (F.col("md1") - F.col("md0"))), F.lit(0.0))).alias("kh"))


_STATIONS = [(0.0, 0.0, 0.0, 0.0), (8.0, 1.37, 0.51, 7.5), (30.0, 4.21, -1.13, 21.3)]
_HEAD = {"x": "(p_partkey * 31 % 400) / 10.0 + 0.0313", "y": "(p_partkey * 17 % 300) / 10.0 + 0.0171", "z": "-0.4"}


@query(
    f"""with {_TRI}, s as (select p_partkey as well, md, hx + dx as x, hy + dy as y, hz + dz as z from (select p_partkey, {", ".join(f"{v} as h{c}" for c, v in _HEAD.items())} from part), (values {", ".join(str(v) for v in _STATIONS)}) v(md, dx, dy, dz)),
    n as (select *, {", ".join(f"lead({c}) over w as n{c}" for c in ("md", "x", "y", "z"))} from s window w as (partition by well order by md)),
    j as (select n.*, tri.*, nx - x as vx, ny - y as vy, nz - z as vz, {", ".join(f"{c}1 - {c}0 as e{c}, {c}2 - {c}0 as f{c}, {c} - {c}0 as s{c}" for c in "xyz")} from n join tri on least(x, nx) <= greatest(x0, x1, x2) and greatest(x, nx) >= least(x0, x1, x2) and least(y, ny) <= greatest(y0, y1, y2) and greatest(y, ny) >= least(y0, y1, y2) where nmd > md),
    h as (select *, vy * fz - vz * fy as hx, vz * fx - vx * fz as hy, vx * fy - vy * fx as hz, sy * ez - sz * ey as qx, sz * ex - sx * ez as qy, sx * ey - sy * ex as qz from j),
    g as (select well, t, md, nmd, (sx * hx + sy * hy + sz * hz) / dd as u, (vx * qx + vy * qy + vz * qz) / dd as w, (fx * qx + fy * qy + fz * qz) / dd as l from (select *, ex * hx + ey * hy + ez * hz as dd from h)),
    r as (select well, t, md + l * (nmd - md) as md from g where u >= 0 and w >= 0 and u + w <= 1 and l between 0 and 1)
    select well, arg_min(t, md) as t, {sq6('min(md)')} as md from r group by well"""
)
def well_first_hit(spark: SparkSession, d: str) -> DataFrame:
    """Where wells first meet a surface."""
    v = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(("md", "dx", "dy", "dz"), s))) for s in _STATIONS))
    s = table(spark, d, "part").select(F.col("p_partkey").alias("well"), *(F.expr(e).cast("double").alias(f"h{c}") for c, e in _HEAD.items()), F.explode(v).alias("v"))
    s = s.select("well", "v.md", *((F.col(f"h{c}") + F.col(f"v.d{c}")).alias(c) for c in "xyz"))
    return wells.first_hits(s, _triangles(spark, d)).select("well", "t", q6(F.col("md")).alias("md"))


_SHAPE = {"depth": "case when active then 1000.0 + k * 10.0 + poro else 0.0 end", "thickness": "case when active then 8.0 + ntg else 0.0 end", "x": "case when active then i * 50.0 + k else 0.0 end", "y": "case when active then j * 40.0 - k else 0.0 end"}


@query(
    f"""with {CELLS}, s as (select cell_id, k, j, i, active, {", ".join(f"{v} as {c}" for c, v in _SHAPE.items())} from cells),
    n as (select *, {", ".join(f"last_value(case when active then {c} end ignore nulls) over up as above_{c}, first_value(case when active then {c} end ignore nulls) over down as below_{c}" for c in ("k", "depth", "thickness", "x"))} from s
          window up as (partition by j, i order by k rows between unbounded preceding and current row), down as (partition by j, i order by k rows between current row and unbounded following)),
    v as (select *, above_depth + above_thickness / 2 as top, below_depth - below_thickness / 2 as base, below_k - above_k - 1 as n, k - above_k - 0.5 as m, above_k is not null and below_k is not null as between_two from n)
    select cell_id, {sq6('case when active then depth when between_two then top + m * (base - top) / n when below_k is not null then base when above_k is not null then top else depth end')} as depth,
           {sq6('case when active then thickness when between_two then (base - top) / n else 0.0 end')} as thickness,
           {sq6('case when active then x when between_two then above_x + m * (below_x - above_x) / n when below_k is not null then below_x when above_k is not null then above_x else x end')} as x from v"""
)
def grid_infill(spark: SparkSession, d: str) -> DataFrame:
    """Geometry of inactive cells from the active ones of their column."""
    c = cells(spark, d).select("cell_id", "k", "j", "i", *(F.expr(v).cast("double").alias(n) for n, v in _SHAPE.items()))
    return grid.infilled(c).select("cell_id", *(q6(F.col(x)).alias(x) for x in ("depth", "thickness", "x")))


@query(
    f"""with {CELLS}, e as (select max(j) + 1 as nj, max(i) + 1 as ni from cells), p as (select r.range as row, c.range as col, 100.0 + (c.range + 0.5) * 17.3 as x, 20.0 + (r.range + 0.5) * 13.7 as y from range(0, 90) r, range(0, 100) c),
    m as (select row, col, floor(y / 40.0)::bigint as j, floor((x - 3.0 * (y / 40.0)) / 50.0)::bigint as i from p) select row, col as "column", j, i from m, e where j between 0 and nj - 1 and i between 0 and ni - 1"""
)
def grid_pixel_map(spark: SparkSession, d: str) -> DataFrame:
    """The column of cells under each pixel."""
    c = cells(spark, d).select("j", "i").distinct()
    ends = {f"{n}{k}": v for k, (dj, di) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0))) for n, v in (("x", (F.col("i") + di) * 50.0 + (F.col("j") + dj) * 3.0), ("y", (F.col("j") + dj) * 40.0))}
    return grid.pixel_map(c.withColumns(ends), (100.0, 20.0), 100, 90, 17.3, 13.7)


@query(
    f"""with c as (select p_brand as region, p_size::double as sw, avg(p_retailprice) as kr from part group by 1, 2), v as (select l_orderkey, l_linenumber, 'Brand#' || (l_suppkey % 25 + 1) as region, l_quantity * 1.3 - 4.0 as sw from lineitem),
    b as (select v.*, c.sw as s0, c.kr as k0 from v asof left join c on v.region = c.region and v.sw >= c.sw), a as (select b.*, c.sw as s1, c.kr as k1 from b asof left join c on b.region = c.region and b.sw <= c.sw)
    select l_orderkey, l_linenumber, {sq6('case when s0 is null then k1 when s1 is null then k0 when s0 = s1 then k0 else k0 + (sw - s0) * (k1 - k0) / (s1 - s0) end')} as kr from a"""
)
def relperm_interpolated(spark: SparkSession, d: str) -> DataFrame:
    """Relative permeability at a saturation, from the table of its region; beyond the table its end."""
    curve = table(spark, d, "part").groupBy(F.col("p_brand").alias("region"), F.col("p_size").cast("double").alias("sw")).agg(F.avg("p_retailprice").alias("kr"))
    region = F.concat(F.lit("Brand#"), F.col("l_suppkey") % 25 + 1)
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", region.alias("region"), (F.col("l_quantity") * 1.3 - 4.0).alias("sw"))
    return looked_up(v, curve, "region", "sw", "kr").select("l_orderkey", "l_linenumber", q6(F.col("kr")).alias("kr"))

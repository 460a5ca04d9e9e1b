"""Grid queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions.index import natural
from lithoframe.operators import grid as g
from lithoframe.plans import CELLS, NI, NJ, cells, davg, dsum, q6, query, sdsum, sq6, table

SIZE = {"i": 50.0, "j": 40.0, "k": 5.0}


def _half_sql(axis: str) -> str:
    a, b = g.AXES[axis]
    f = g.DARCY["m"] * SIZE[a] * SIZE[b] / (0.5 * SIZE[axis])
    return f"perm * {f!r}::double" + ("" if axis == "k" else " * ntg")


def _faces_sql(axis: str) -> str:
    a, b = g.AXES[axis]
    return f"""
    select '{axis}' as axis, k, t from (
        select k, case when h is null or n is null or h < 1e-9 or n < 1e-9 then 0.0::double else 1.0::double / (1.0::double / h + 1.0::double / n) end as t
        from (select k, {axis} as pos, {_half_sql(axis)} as h, lead({_half_sql(axis)}) over w as n, lead({axis}) over w as nx from cells window w as (partition by {a}, {b} order by {axis}))
        where nx = pos + 1)"""


@query(f"with {CELLS} select cell_id, k::bigint as k, j::bigint as j, i::bigint as i, (k * {NJ} + j) * {NI} + i as again from cells")
def grid_denaturalise(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return c.select("cell_id", "k", "j", "i", natural(F.col("k"), F.col("j"), F.col("i"), NJ, NI).alias("again"))


@query(
    f"with {CELLS}, f as ({' union all '.join(_faces_sql(a) for a in 'kji')}) select axis, k::bigint as k, count(*)::bigint as faces, {sdsum('t')} as transmissibility from f group by axis, k"
)
def grid_transmissibility(spark: SparkSession, d: str) -> DataFrame:
    """Face transmissibility along the three axes, by layer."""
    c, found = cells(spark, d), None
    for axis in "kji":
        half = c.withColumn("half", g.half_transmissibility(axis, F.col("perm"), F.col("ntg"), SIZE))
        part = g.face_transmissibility(half, axis, "half").select(F.lit(axis).alias("axis"), "k", "transmissibility")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("axis", "k").agg(F.count("*").alias("faces"), dsum(F.col("transmissibility")).alias("transmissibility"))


@query(
    f"with {CELLS}, h as (select cell_id, {_half_sql('k')} as half_k, {_half_sql('j')} as half_j, {_half_sql('i')} as half_i from cells) select cell_id, {sq6('half_k')} as half_k, {sq6('half_j')} as half_j, {sq6('half_i')} as half_i from h"
)
def grid_half_cell(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return c.select("cell_id", *(q6(g.half_transmissibility(a, F.col("perm"), F.col("ntg"), SIZE)).alias(f"half_{a}") for a in "kji"))


@query(
    f"with {CELLS} select cell_id, {sq6('1000.0 + (i + 0.5) * 50.0')} as x, {sq6('2000.0 + (j + 0.5) * 40.0')} as y, {sq6('1500.0 + (k + 0.5) * 5.0')} as z from cells"
)
def grid_regular_centres(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return c.select("cell_id", *(q6(o + (F.col(a) + 0.5) * SIZE[a]).alias(n) for n, a, o in (("x", "i", 1000.0), ("y", "j", 2000.0), ("z", "k", 1500.0))))


_WARP = "(1500.0 + (k + {kp}) * (5.0 + ntg) + sin((j + {jp}) * 0.1) * 3.0 + (i + {ip}) * 0.25)"


@query(
    f"""with {CELLS}, t as (select cell_id, k, poro,
        ({" + ".join(_WARP.format(kp=1, jp=jp, ip=ip) for jp in (0, 1) for ip in (0, 1))}) / 4.0 - ({" + ".join(_WARP.format(kp=0, jp=jp, ip=ip) for jp in (0, 1) for ip in (0, 1))}) / 4.0 as dz from cells)
    select k::bigint as k, count(*)::bigint as cells, {sdsum('dz')} as thickness, {sdsum('floor(dz * 2000.0 * 1e4 + 0.5) / 1e4')} as volume,
           {sdsum('floor(dz * 2000.0 * poro * 1e4 + 0.5) / 1e4')} as pore_volume from t group by k"""
)
def cell_volume_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Thickness, bulk and pore volume by layer of a grid with sloping layers, from the eight corners of each cell."""
    c = cells(spark, d)

    def corner(kp: int, jp: int, ip: int):
        z = 1500.0 + (F.col("k") + kp) * (5.0 + F.col("ntg")) + F.sin((F.col("j") + jp) * 0.1) * 3.0 + (F.col("i") + ip) * 0.25
        return (F.col("i") + ip) * SIZE["i"], (F.col("j") + jp) * SIZE["j"], z

    p = {(kp, jp, ip): corner(kp, jp, ip) for kp in (0, 1) for jp in (0, 1) for ip in (0, 1)}
    dz = g.thickness([p[0, a, b][2] for a in (0, 1) for b in (0, 1)], [p[1, a, b][2] for a in (0, 1) for b in (0, 1)])
    q4 = lambda x: F.floor(x * 1e4 + 0.5) / 1e4
    rows = g.with_volume(c.withColumn("dz", dz), p, "v").select("k", "poro", "dz", "v")
    return rows.groupBy("k").agg(F.count("*").alias("cells"), dsum(F.col("dz")).alias("thickness"), dsum(q4(F.col("v"))).alias("volume"), dsum(q4(F.col("v") * F.col("poro"))).alias("pore_volume"))


@query(f"with {CELLS} select j::bigint as j, i::bigint as i, not bool_or(active) as inactive from cells group by j, i")
def grid_column_inactive(spark: SparkSession, d: str) -> DataFrame:
    return g.column_inactive(cells(spark, d))


@query(
    f"with {CELLS} select count(*)::bigint as all_cells, count(*) filter (active)::bigint as active_cells, count(*) filter (poro <= 0.12)::bigint as pinched, count(*) filter (active and poro > 0.12)::bigint as flowing from cells"
)
def grid_cell_count(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("pinched", g.pinched_out(F.col("poro"), 0.12))
    return c.agg(F.count("*").alias("all_cells"), F.count_if("active").alias("active_cells"), F.count_if("pinched").alias("pinched"), F.count_if(F.col("active") & ~F.col("pinched")).alias("flowing"))


@query(f"with {CELLS} select zone, count(*)::bigint as cells, {sdsum('perm')} / count(perm) as mean_perm, min(perm) as min_perm, max(perm) as max_perm from cells where active group by zone")
def property_masked_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).filter("active")
    return c.groupBy("zone").agg(F.count("*").alias("cells"), davg(F.col("perm")).alias("mean_perm"), F.min("perm").alias("min_perm"), F.max("perm").alias("max_perm"))


@query(f"with {CELLS} select min(k)::bigint as k0, max(k)::bigint as k1, min(j)::bigint as j0, max(j)::bigint as j1, min(i)::bigint as i0, max(i)::bigint as i1 from cells where perm > 480")
def grid_trim_box(spark: SparkSession, d: str) -> DataFrame:
    """The smallest box that holds all selected cells."""
    c = cells(spark, d).filter("perm > 480")
    return c.agg(*(f(a).alias(f"{a}{n}") for a in "kji" for n, f in ((0, F.min), (1, F.max))))


@query(f"with {CELLS} select cell_id, k::bigint - 2 as k, j::bigint - 5 as j, i::bigint - 10 as i, perm, ntg from cells where k between 2 and 6 and j between 5 and 14 and i between 10 and 19")
def grid_extract_box(spark: SparkSession, d: str) -> DataFrame:
    """A box cut out of the grid, with indices of its own."""
    box = {"k": (2, 6), "j": (5, 14), "i": (10, 19)}
    c = cells(spark, d)
    for a, (lo, hi) in box.items():
        c = c.filter(F.col(a).between(lo, hi))
    return c.select("cell_id", *((F.col(a) - lo).alias(a) for a, (lo, _) in box.items()), "perm", "ntg")


@query(
    f"with {CELLS}, p as (select cell_id, sqrt(perm * perm * 0.5) * 0.1 * ntg * ntg as kv from cells) select cell_id, {sq6('kv')} as perm_k from p"
)
def property_perm_k(spark: SparkSession, d: str) -> DataFrame:
    """Vertical permeability from the horizontal ones, a ratio and net to gross squared."""
    from lithoframe.operators.properties import vertical_permeability

    c = cells(spark, d)
    return c.select("cell_id", q6(vertical_permeability(F.col("perm"), F.col("perm") * 0.5, 0.1, F.col("ntg"), squared=True)).alias("perm_k"))


@query(
    f"with {CELLS}, h as (select cell_id, perm, 0.5 * 50.0 as hx, 0.125 * (k % 3) as hz, 40.0 * 5.0 as ax, 2.0 * (j % 4) as az from cells) "
    f"select cell_id, {sq6(f'abs({g.DARCY['m']!r}::double * perm * (hx * ax + hz * az) / (hx * hx + hz * hz))')} as half_t from h"
)
def grid_half_cell_irregular(spark: SparkSession, d: str) -> DataFrame:
    h = (F.lit(0.5 * 50.0), F.lit(0.0), 0.125 * (F.col("k") % 3))
    area = (F.lit(40.0 * 5.0), F.lit(0.0), 2.0 * (F.col("j") % 4))
    return cells(spark, d).select("cell_id", q6(g.irregular_half(h, area, F.col("perm"))).alias("half_t"))


@query(
    f"""with {CELLS}, n as (select *, min(perm) over () as lo, max(perm) over () as hi, min(log10(perm)) over () as llo, max(log10(perm)) over () as lhi from cells)
    select cell_id, {sq6('(perm - lo) / (hi - lo)')} as linear, {sq6('(log10(perm) - llo) / (lhi - llo)')} as logarithmic, {sq6('perm / hi')} as from_zero, {sq6('(cell_id % 3) / 6.0')} as cyclic, 0.5::double as constant from n"""
)
def property_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Mapped to 0..1 in several ways; the cycle's range counts, not that of the remainders that occur."""
    from lithoframe.operators.properties import normalised

    c = cells(spark, d).withColumn("cycle", (F.col("cell_id") % 3 + 7 * (F.col("cell_id") % 2)).cast("double")).withColumn("same", F.lit(3.0))
    c = normalised(c, "perm", "linear")
    c = normalised(c, "perm", "logarithmic", log=True)
    c = normalised(c, "perm", "from_zero", zero_at=0.0)
    c = normalised(c, "cycle", "cyclic", cycle=7)
    c = normalised(c, "same", "constant")
    return c.select("cell_id", *(q6(F.col(x)).alias(x) for x in ("linear", "logarithmic", "from_zero", "cyclic")), "constant")


@query(
    f"with {CELLS} select zone, min(k)::bigint as first_layer, max(k)::bigint as last_layer, count(distinct k)::bigint as layers, count(*)::bigint as cells from cells group by zone"
)
def zone_layer_ranges(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("zone").agg(F.min("k").alias("first_layer"), F.max("k").alias("last_layer"), F.count_distinct("k").alias("layers"), F.count("*").alias("cells"))


@query(
    f"with {CELLS}, n as (select k, zone, count(*) as n from cells group by all), r as (select *, row_number() over (partition by k order by n desc, zone) as nth from n) select k::bigint as k, zone, n::bigint as cells from r where nth = 1"
)
def zone_dominant(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent zone of each layer; of equals, the first."""
    from lithoframe.operators.scaling import dominant

    return dominant(cells(spark, d), "k", "zone").withColumnRenamed("n", "cells")


@query(
    f"with {CELLS} select cell_id, {sq6('(1 - 0.25) * (1 - 0.5) * ((1 - 0.75) * a + 0.75 * (a + 2.0)) + (1 - 0.25) * 0.5 * ((1 - 0.75) * (a + 1.0) + 0.75 * (a + 3.5)) + 0.25 * (a + 5.0 + ntg)')} as z from (select cell_id, ntg, perm * 0.01 as a from cells)"
)
def grid_interpolated_point(spark: SparkSession, d: str) -> DataFrame:
    """Depth at fractions (k 0.25, j 0.5, i 0.75) of each cell, by trilinear interpolation of its corners."""
    from lithoframe.operators.properties import trilinear

    c = cells(spark, d).withColumn("a", F.col("perm") * 0.01)
    a, base = F.col("a"), F.col("a") + 5.0 + F.col("ntg")
    top = {(0, 0, 0): a, (0, 0, 1): a + 2.0, (0, 1, 0): a + 1.0, (0, 1, 1): a + 3.5}
    corners = top | {(1, j, i): base for j in (0, 1) for i in (0, 1)}
    return c.select("cell_id", q6(trilinear(corners, 0.25, 0.5, 0.75)).alias("z"))


@query("select o_orderkey as cell_id, (o_custkey % 13) * 1000 + (o_custkey % 7) * 100 + (o_custkey % 5) * 10 + o_custkey % 11 as logical from orders")
def property_face_order(spark: SparkSession, d: str) -> DataFrame:
    """Values on the edges of columns, stored as I-, J+, I+, J-, put in the logical order J-, J+, I-, I+ and packed."""
    from lithoframe.operators.properties import reordered

    o = table(spark, d, "orders")
    stored = F.array(*(F.col("o_custkey") % m for m in (5, 7, 11, 13)))
    v = reordered(stored, [3, 1, 0, 2])
    return o.select(F.col("o_orderkey").alias("cell_id"), (v[0] * 1000 + v[1] * 100 + v[2] * 10 + v[3]).alias("logical"))



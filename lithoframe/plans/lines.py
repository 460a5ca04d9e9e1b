"""Line queries: each label's points of the embeddings, in the order of their ids, are a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoframe.operators import lines as n
from lithoframe.plans import POINTS, points, q6, query, sq6


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select(F.col("label").alias("line"), F.col("id").alias("seq"), "x", "y", "z")


_L = f"with {POINTS}, p as (select label as line, id as seq, x, y, z, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2) + pow(z - lag(z) over w, 2)) as piece from points window w as (partition by label order by id))"


@query(_L + f" select line, seq, {sq6('sum(coalesce(piece, 0)) over (partition by line order by seq)')} as md from p")
def line_measured_depths(spark: SparkSession, d: str) -> DataFrame:
    return n.along(_lines(spark, d)).select("line", "seq", q6(F.col("md")).alias("md"))


@query(_L + f", e as (select line, count(*)::bigint as vertices, sum(coalesce(piece, 0)) as o, sqrt(pow(arg_min(x, seq) - arg_max(x, seq), 2) + pow(arg_min(y, seq) - arg_max(y, seq), 2) + pow(arg_min(z, seq) - arg_max(z, seq), 2)) as b from p group by line) select line, vertices, {sq6('o + b')} as length from e")
def line_length(spark: SparkSession, d: str) -> DataFrame:
    return n.lengths(_lines(spark, d), closed=True).select("line", "vertices", q6(F.col("length")).alias("length"))


@query(f"with {POINTS}, t as (select label as line, x * coalesce(lead(y) over w, first_value(y) over w) - coalesce(lead(x) over w, first_value(x) over w) * y as term from points window w as (partition by label order by id rows between unbounded preceding and unbounded following)) select line, {sq6('abs(sum(term)) / 2')} as area from t group by line")
def line_area(spark: SparkSession, d: str) -> DataFrame:
    return n.areas(_lines(spark, d)).select("line", q6(F.col("area")).alias("area"))


def _tangent_sql(power: int, closed: bool) -> str:
    """CTEs up to t (line, seq, x, y, z, tx, ty, tz) on points."""
    before = lambda c: f"coalesce(lag({c}) over w, last_value({c}) over v)" if closed else f"lag({c}) over w"
    after = lambda c: f"coalesce(lead({c}) over w, first_value({c}) over v)" if closed else f"lead({c}) over w"
    steps = ", ".join(f"{c} - {before(c)} as p{c}, {after(c)} - {c} as f{c}" for c in "xyz")
    part = lambda k, c: f"coalesce({k}{c} / pow(nullif(sqrt({k}x * {k}x + {k}y * {k}y + {k}z * {k}z), 0), {power}), 0)"
    return f"""with {POINTS}, d as (select label as line, id as seq, x, y, z, {steps} from points window w as (partition by label order by id), v as (partition by label order by id rows between unbounded preceding and unbounded following)),
    s as (select line, seq, x, y, z, {", ".join(f"{part('p', c)} + {part('f', c)} as s{c}" for c in "xyz")} from d),
    t as (select line, seq, x, y, z, {", ".join(f"s{c} / sqrt(sx * sx + sy * sy + sz * sz) as t{c}" for c in "xyz")} from s)"""


def _tangents(spark: SparkSession, d: str, weight: str, closed: bool) -> DataFrame:
    return n.tangents(_lines(spark, d), weight, closed).select("line", "seq", *(q6(F.col(c)).alias(c) for c in ("tx", "ty", "tz")))


_SHOWN = f" select line, seq, {sq6('tx')} as tx, {sq6('ty')} as ty, {sq6('tz')} as tz from t"


@query(_tangent_sql(1, False) + _SHOWN)
def line_tangents(spark: SparkSession, d: str) -> DataFrame:
    return _tangents(spark, d, "linear", False)


@query(_tangent_sql(2, True) + _SHOWN)
def line_tangents_square(spark: SparkSession, d: str) -> DataFrame:
    """Of closed lines, the shorter piece favoured."""
    return _tangents(spark, d, "square", True)


@query(_tangent_sql(3, False) + _SHOWN)
def line_tangents_cube(spark: SparkSession, d: str) -> DataFrame:
    return _tangents(spark, d, "cube", False)


def _hermite(c: str) -> str:
    t = "(part / cuts::double)"
    return sq6(f"case when len is null then {c} else (2 * pow({t}, 3) - 3 * pow({t}, 2) + 1) * {c} + (pow({t}, 3) - 2 * pow({t}, 2) + {t}) * len * t{c} + (-2 * pow({t}, 3) + 3 * pow({t}, 2)) * n{c} + (pow({t}, 3) - pow({t}, 2)) * len * nt{c} end") + f" as {c}"


def _turn(a: str) -> str:
    """Degrees between a unit tangent and the piece."""
    return f"degrees(acos(greatest(-1.0, least(1.0, ({a}x * (nx - x) + {a}y * (ny - y) + {a}z * (nz - z)) / len))))"


@query(
    _tangent_sql(2, False)
    + f""", n as (select *, {', '.join(f'lead({c}) over w as n{c}' for c in ('x', 'y', 'z', 'tx', 'ty', 'tz'))} from t window w as (partition by line order by seq)),
    l as (select *, sqrt(pow(nx - x, 2) + pow(ny - y, 2) + pow(nz - z, 2)) as len from n),
    k as (select *, case when len is not null then greatest(2, ceil(len / 0.15), ceil(({_turn('t')} + {_turn('nt')}) / 40.0))::integer end as cuts from l), c as (select *, unnest(range(0, coalesce(cuts, 1))) as part from k)
    select line, seq, part::integer as part, {', '.join(_hermite(c) for c in 'xyz')} from c"""
)
def line_spline(spark: SparkSession, d: str) -> DataFrame:
    """Two parts a piece at least, none longer than 0.15 or turning by more than 40 degrees."""
    return n.splined(_lines(spark, d), 2, 0.15, 40.0).select("line", "seq", "part", *(q6(F.col(c)).alias(c) for c in "xyz"))


@query(_L + f", m as (select line, seq, x, y, z, sum(coalesce(piece, 0)) over (partition by line order by seq) as md from p), v as (select *, max(md) over (partition by line) / 20 as step, lead(md) over w as md1, lead(x) over w as nx, lead(y) over w as ny, lead(z) over w as nz from m window w as (partition by line order by seq)), g as (select v.*, k.range as point from v join range(0, 21) k on (k.range * step >= md - 1e-9 * step and k.range * step < md1 - 1e-9 * step) or (k.range = 20 and abs(md1 / step - 20) < 1e-9) where md1 > md) select line, point, {', '.join(sq6(f'{c} + (point * step - md) / (md1 - md) * (n{c} - {c})') + f' as {c}' for c in 'xyz')} from g")
def line_equidistant(spark: SparkSession, d: str) -> DataFrame:
    return n.equidistant(_lines(spark, d), 21).select("line", "point", *(q6(F.col(c)).alias(c) for c in "xyz"))


@query(
    f"""with recursive {POINTS}, p as (select label as line, id as seq, x, y, z, row_number() over (partition by label order by id) as nth, count(*) over (partition by label) as n from points),
    r as (select line, nth, n, seq, x, y, z, true as kept from p where nth = 1
          union all select p.line, p.nth, p.n, f.seq, f.x, f.y, f.z, f.far from r join p on p.line = r.line and p.nth = r.nth + 1,
              lateral (select abs(p.x - r.x) + abs(p.y - r.y) + abs(p.z - r.z) > 0.2 as far) g, lateral (select g.far as far, if(g.far, p.seq, r.seq) as seq, if(g.far, p.x, r.x) as x, if(g.far, p.y, r.y) as y, if(g.far, p.z, r.z) as z) f),
    k as (select *, row_number() over (partition by line order by nth desc) as back, count(*) over (partition by line) as left from r where kept)
    select k.line, if(back = 1 and k.left < k.n, e.seq, k.seq) as seq, if(back = 1 and k.left < k.n, e.x, k.x) as x, if(back = 1 and k.left < k.n, e.y, k.y) as y, if(back = 1 and k.left < k.n, e.z, k.z) as z
    from k join p e on e.line = k.line and e.nth = e.n where k.n >= 3
    union all select line, seq, x, y, z from p where n < 3"""
)
def line_without_close_vertices(spark: SparkSession, d: str) -> DataFrame:
    return n.without_close_vertices(_lines(spark, d), 0.2)


@query(f"with {POINTS}, m as (select id, label as line, x - avg(x) over w as dx, y - avg(y) over w as dy from points window w as (partition by label)), a as (select *, case when atan2(dx, dy) < 0 then atan2(dx, dy) + 2 * pi() else atan2(dx, dy) end as a from m) select id, line, row_number() over (partition by line order by a, id)::integer as rank from a")
def line_clockwise(spark: SparkSession, d: str) -> DataFrame:
    return n.clockwise(points(spark, d).withColumnRenamed("label", "line"), "line").select("id", "line", "rank")


@query(
    f"""with {POINTS}, q as (select id, x + 0.05 as x, y - 0.03 as y, z + 0.02 as z from points),
    s as (select id as segment, x as ax, y as ay, z as az, lead(x) over w - x as dx, lead(y) over w - y as dy, lead(z) over w - z as dz from points window w as (partition by label order by id)),
    t as (select q.id, segment, q.x, q.y, q.z, ax, ay, az, dx, dy, dz, coalesce(greatest(0.0, least(1.0, ((q.x - ax) * dx + (q.y - ay) * dy + (q.z - az) * dz) / nullif(dx * dx + dy * dy + dz * dz, 0))), 0) as t from q, s where dx is not null),
    g as (select id, segment, sqrt(pow(x - ax - t * dx, 2) + pow(y - ay - t * dy, 2) + pow(z - az - t * dz, 2)) as distance from t)
    select id, arg_min(segment, floor(distance * 1e9) * 1e8 + segment) as segment, {sq6('min(distance)')} as distance from g group by id"""
)
def line_closest_segment(spark: SparkSession, d: str) -> DataFrame:
    """The nearest segment of any line to every point, moved aside."""
    w = Window.partitionBy("line").orderBy("seq")
    s = _lines(spark, d).select(F.col("seq").alias("segment"), *(F.col(c).alias(f"a{c}") for c in "xyz"), *(F.lead(c).over(w).alias(f"b{c}") for c in "xyz")).filter("bx is not null")
    p = points(spark, d).select("id", (F.col("x") + 0.05).alias("x"), (F.col("y") - 0.03).alias("y"), (F.col("z") + 0.02).alias("z"))
    return n.closest(p, s, 0.05).select("id", "segment", q6(F.col("distance")).alias("distance"))


@query(
    f"""with {POINTS}, l as (select id, x, y, z, 0.3::double as vx, 0.1::double as vy, 1.0::double as vz from points),
    h as (select *, 0.6::double as e1x, 0.1::double as e1y, 0.05::double as e1z, 0.1::double as e2x, 0.7::double as e2y, -0.02::double as e2z, x + 0.3 as sx, y + 0.3 as sy, z - 0.1 as sz from l),
    c as (select *, vy * e2z - vz * e2y as hx, vz * e2x - vx * e2z as hy, vx * e2y - vy * e2x as hz, sy * e1z - sz * e1y as qx, sz * e1x - sx * e1z as qy, sx * e1y - sy * e1x as qz from h),
    e as (select id, (sx * hx + sy * hy + sz * hz) / (e1x * hx + e1y * hy + e1z * hz) as u, (vx * qx + vy * qy + vz * qz) / (e1x * hx + e1y * hy + e1z * hz) as w, (e2x * qx + e2y * qy + e2z * qz) / (e1x * hx + e1y * hy + e1z * hz) as t from c)
    select id, {sq6('t')} as t from e where u >= 0 and w >= 0 and u + w <= 1"""
)
def line_triangle_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Where lines through points meet a triangle."""
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    p = points(spark, d)
    a = (-0.3, -0.3, 0.1)
    b, c = (a[0] + 0.6, a[1] + 0.1, a[2] + 0.05), (a[0] + 0.1, a[1] + 0.7, a[2] - 0.02)
    t = n.line_hits_triangle((F.col("x"), F.col("y"), F.col("z")), lit(0.3, 0.1, 1.0), lit(*a), lit(*b), lit(*c))
    return p.select("id", q6(t).alias("t")).filter("t is not null")

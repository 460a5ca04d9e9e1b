"""Well queries: users are wells; an event's place in time gives its measured depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoframe.functions.vectors import azimuth, inclination
from lithoframe.operators import wells as w
from lithoframe.operators import wellspec
from lithoframe.plans import CELLS, cells, dsum, q6, query, sdsum, sq6, table

_MD = "epoch_us(ts) / 1e9 - 1704067200 / 1000.0"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("well"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e9 - F.lit(1704067200 / 1000.0)).alias("md"), "value", "event_type")


SAMPLES = f"samples as (select user_id as well, event_id, {_MD} as md, value, event_type from events)"


@query(
    f"""with {SAMPLES}, a as (select *, radians(event_id % 40) as i2, radians((event_id * 7) % 360) as a2 from samples),
    b as (select *, lag(i2) over q as i1, lag(a2) over q as a1, md - lag(md) over q as dmd from a window q as (partition by well order by md)),
    c as (select *, acos(greatest(-1.0, least(1.0, cos(i2 - i1) - sin(i1) * sin(i2) * (1 - cos(a2 - a1))))) as th from b),
    e as (select *, dmd * case when th < 1e-8 then 0.5 else tan(th / 2) / th end as st from c),
    f as (select well, event_id, md, coalesce(st * (sin(i1) * sin(a1) + sin(i2) * sin(a2)), 0) as dx, coalesce(st * (sin(i1) * cos(a1) + sin(i2) * cos(a2)), 0) as dy, coalesce(st * (cos(i1) + cos(i2)), 0) as dz from e)
    select event_id, {sq6('sum(dx) over q')} as x, {sq6('sum(dy) over q')} as y, {sq6('sum(dz) over q')} as z from f window q as (partition by well order by md)"""
)
def well_minimum_curvature(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d).withColumns({"inclination": (F.col("event_id") % 40).cast("double"), "azimuth": ((F.col("event_id") * 7) % 360).cast("double")})
    return w.minimum_curvature(s).select("event_id", *(q6(F.col(c)).alias(c) for c in "xyz"))


@query(
    f"""with {SAMPLES}, v as (select *, lead(md) over q as md1, row_number() over q - 1 as interval from samples window q as (partition by well order by md))
    select well, interval, {sq6('md')} as md0, {sq6('md1')} as md1 from v where md1 is not null"""
)
def well_intervals(spark: SparkSession, d: str) -> DataFrame:
    v = w.intervals(_samples(spark, d), "well", "md")
    return v.select("well", "interval", q6(F.col("md0")).alias("md0"), q6(F.col("md1")).alias("md1"))


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _samples(spark, d)
    log = w.intervals(s.filter("event_type in ('click', 'view', 'signup')"), "well", "md").select("well", "interval", "md0", "md1", "value")
    cell = w.intervals(s.filter("event_type in ('error', 'purchase')"), "well", "md").select("well", F.col("interval").alias("cell"), F.col("md0").alias("b_md0"), F.col("md1").alias("b_md1"))
    return log, cell


_OVERLAP = f"""with {SAMPLES},
    l as (select well, md as md0, lead(md) over q as md1, row_number() over q - 1 as interval, value from samples where event_type in ('click', 'view', 'signup') window q as (partition by well order by md)),
    c as (select well, md as b0, lead(md) over q as b1, row_number() over q - 1 as cell from samples where event_type in ('error', 'purchase') window q as (partition by well order by md)),
    o as (select l.well, interval, cell, value, least(md1, b1) - greatest(md0, b0) as overlap, (least(md1, b1) - greatest(md0, b0)) / (md1 - md0) as part_a, (least(md1, b1) - greatest(md0, b0)) / (b1 - b0) as part_b
          from l join c on l.well = c.well and md0 < b1 and b0 < md1 where md1 is not null and b1 is not null)"""


@query(_OVERLAP + f" select well, interval, cell, {sq6('overlap')} as overlap, {sq6('part_a')} as part_a, {sq6('part_b')} as part_b from o")
def well_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Frame intervals against cell intervals, with the part of each that overlaps."""
    o = w.overlaps(*_frames(spark, d), "well", 50.0)
    return o.select("well", "interval", "cell", *(q6(F.col(c)).alias(c) for c in ("overlap", "part_a", "part_b")))


@query(
    _OVERLAP
    + f""", r as (select *, row_number() over (partition by well, cell order by floor(part_b * 1e6 + 0.5) desc, interval) as nth from o)
    select well, cell, count(*)::bigint as pieces, bool_or(value > 40) as any_high, least({sdsum('part_b')}, 1.0) as covered, max(value) as most, {sdsum('value * part_b')} as weighted, max(value) filter (nth = 1) as dominant from r group by well, cell"""
)
def well_frame_upscaling(spark: SparkSession, d: str) -> DataFrame:
    """Log values on cells: any, covered part, greatest, weighted by part, and that of the largest part."""
    o = w.overlaps(*_frames(spark, d), "well", 50.0)
    largest = F.min_by("value", F.struct(-F.floor(F.col("part_b") * 1e6 + 0.5), F.col("interval")))
    return o.groupBy("well", "cell").agg(
        F.count("*").alias("pieces"), F.bool_or(F.col("value") > 40).alias("any_high"), F.least(dsum(F.col("part_b")), F.lit(1.0)).alias("covered"), F.max("value").alias("most"),
        dsum(F.col("value") * F.col("part_b")).alias("weighted"), largest.alias("dominant"),
    )


@query(
    f"""with {SAMPLES}, l as (select well, event_id, md from samples where event_type in ('purchase', 'click')), n as (select well, md, lead(md) over q as md1, row_number() over q - 1 as interval from samples where event_type = 'click' window q as (partition by well order by md)),
    m as (select l.well, l.event_id, l.md, n.interval, n.md as md0, n.md1 from l left join n on l.well = n.well)
    select event_id, coalesce(min(interval) filter (md >= md0 and md <= md1), -1)::bigint as interval,
           {sq6('case when min(md0) is null or min(md) < min(md0) then 0.0 when bool_or(md >= md0 and md <= md1) then arg_min((md - md0) / (md1 - md0), interval) filter (md >= md0 and md <= md1) else 1.0 end')} as fraction from m group by event_id"""
)
def well_interval_for_md(spark: SparkSession, d: str) -> DataFrame:
    """The interval that holds a depth and how far along it lies; depths of nodes are among those asked for."""
    s = _samples(spark, d)
    return w.interval_for_md(s.filter("event_type in ('purchase', 'click')").select("well", "event_id", "md"), s.filter("event_type = 'click'")).select("event_id", "interval", q6(F.col("fraction")).alias("fraction"))


_KH = "case when cell_id % 4 = 0 then 5.0 * sqrt(perm * perm * 0.5) else pow(perm * (perm * 0.5) * (perm * 0.1), 1.0::double / 3.0) * sqrt(pow(5.0 * sqrt(pow(perm * (perm * 0.5) * (perm * 0.1), 1.0::double / 3.0) / perm) * sin((cell_id % 4) * 0.3) * cos(0.7), 2) + pow(5.0 * sqrt(pow(perm * (perm * 0.5) * (perm * 0.1), 1.0::double / 3.0) / (perm * 0.5)) * sin((cell_id % 4) * 0.3) * sin(0.7), 2) + pow(5.0 * sqrt(pow(perm * (perm * 0.5) * (perm * 0.1), 1.0::double / 3.0) / (perm * 0.1)) * cos((cell_id % 4) * 0.3), 2)) end"


def _kh(c: DataFrame):
    p = F.col("perm")
    return w.flow_capacity(F.lit(5.0), p, p * 0.5, p * 0.1, (F.col("cell_id") % 4) * 0.3, F.lit(0.7))


@query(f"with {CELLS} select cell_id, {sq6(_KH)} as kh from cells where active")
def well_flow_capacity(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).filter("active")
    return c.select("cell_id", q6(_kh(c)).alias("kh"))


@query(f"with {CELLS} select j::bigint as j, i::bigint as i, {sdsum(sq6(_KH))} as kh, count(*)::bigint as intervals from cells where active and perm > 50 and k between 1 and 15 group by j, i")
def well_static_kh(spark: SparkSession, d: str) -> DataFrame:
    """Flow capacity summed down a column, after the filters on layers, activity and permeability."""
    c = cells(spark, d).filter("active and perm > 50 and k between 1 and 15")
    return c.groupBy("j", "i").agg(dsum(q6(_kh(c))).alias("kh"), F.count("*").alias("intervals"))


_ANGLES = "(cell_id % 4) * 0.3 as v, 0.7::double as a"


@query(
    f"""with {CELLS}, k as (select cell_id, perm as ki, perm * 0.5 as kj, perm * 0.1 as kk, {_ANGLES} from cells where perm > 0),
    m as (select *, sqrt(kj * kk) as ei, sqrt(ki * kk) as ej, sqrt(ki * kj) as ek from k),
    r as (select *, 0.14 * sqrt(ei * (1600.0 / kj + 25.0 / kk)) * sin(v) * cos(a) as bi, 0.14 * sqrt(ej * (2500.0 / ki + 25.0 / kk)) * sin(v) * sin(a) as bj, 0.14 * sqrt(ek * (2500.0 / ki + 1600.0 / kj)) * cos(v) as bk,
          0.05 * (sqrt(ei / kj) + sqrt(ei / kk)) * sin(v) * cos(a) as wi, 0.05 * (sqrt(ej / ki) + sqrt(ej / kk)) * sin(v) * sin(a) as wj, 0.05 * (sqrt(ek / ki) + sqrt(ek / kj)) * cos(v) as wk from m),
    e as (select c.*, 0.1 * sqrt(bi * bi + bj * bj + bk * bk) / sqrt(wi * wi + wj * wj + wk * wk) as rb from r join (select cell_id, perm from cells) c using (cell_id)),
    f as (select cell_id, rb, 2 * pi() / (ln(rb / 0.1) + 1.5) as wi, {_KH} as kh from e)
    select cell_id, {sq6('rb')} as radb, {sq6('case when rb <= 0 then 0 else wi end')} as wi, {sq6('8.5270171e-5::double * kh * wi')} as wbc from f"""
)
def well_inflow(spark: SparkSession, d: str) -> DataFrame:
    """Equivalent radius, well index and well block conductivity of intervals at several angles in anisotropic cells."""
    p = F.col("perm")
    c = cells(spark, d).filter("perm > 0")
    sizes = tuple(F.lit(x) for x in (50.0, 40.0, 5.0))
    c = c.withColumn("rb", w.block_radius(F.lit(0.1), (p, p * 0.5, p * 0.1), sizes, (F.col("cell_id") % 4) * 0.3, F.lit(0.7)))
    wi = w.well_index(F.col("rb"), F.lit(0.1), F.lit(1.5))
    return c.select("cell_id", q6(F.col("rb")).alias("radb"), q6(wi).alias("wi"), q6(F.lit(w.WELL_CONSTANT["m"]) * _kh(c) * wi).alias("wbc"))


@query(f"with {CELLS} select cell_id, {sq6('case when p <= ntg then 1.0 else ntg / p end')} as ntg from (select cell_id, ntg, 0.2 + (cell_id % 8) / 10.0 as p from cells)")
def well_effective_ntg(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return c.select("cell_id", q6(w.effective_ntg(F.col("ntg"), 0.2 + (F.col("cell_id") % 8) / 10.0)).alias("ntg"))


@query(
    f"""with {SAMPLES}, v as (select *, value - lag(value) over q as dx, (event_id % 13) - lag(event_id % 13) over q as dy, md - lag(md) over q as dz from samples window q as (partition by well order by md))
    select event_id, {sq6('case when degrees(atan2(dx, dy)) < 0 then degrees(atan2(dx, dy)) + 360 else degrees(atan2(dx, dy)) end')} as azimuth, {sq6('degrees(acos(greatest(-1.0, least(1.0, dz / sqrt(dx * dx + dy * dy + dz * dz)))))')} as inclination from v where dz is not null"""
)
def well_directions(spark: SparkSession, d: str) -> DataFrame:
    """Azimuth and inclination of each piece of a trajectory."""
    s = _samples(spark, d)
    step = lambda c: F.expr(f"{c} - lag({c}) over (partition by well order by md)")
    v = s.select("event_id", "well", "md", step("value").alias("dx"), step("(event_id % 13)").cast("double").alias("dy"), step("md").alias("dz")).filter("dz is not null")
    a = (F.col("dx"), F.col("dy"), F.col("dz"))
    return v.select("event_id", q6(azimuth(a)).alias("azimuth"), q6(inclination(a)).alias("inclination"))


_LIMITS = wellspec.Limits(active_only=True, min_k=1, max_k=150, regions=(0, 1, 3), max_satw=0.75, min_length=0.5, min_kh=20.0)


@query(
    f"""with {SAMPLES}, {CELLS}, m as (select count(*)::bigint as m from cells),
    s as (select well, event_id, md as md0, lead(md) over (partition by well order by md) as md1 from samples),
    b as (select well, md as p0, (md + lead(md) over (partition by well order by md)) * 0.5::double as p1 from samples where event_type in ('purchase', 'click')),
    c as (select s.*, k, j, i, perm, ntg, active, (event_id % 4) * 0.3::double as v, 0.7::double as a from s, m join cells on cells.cell_id = event_id % m where md1 is not null and active and k between 1 and 150 and event_id % 5 in (0, 1, 3) and (event_id % 10) / 10.0::double <= 0.75),
    o as (select well, md0, md1, sum(least(md1, p1) - greatest(md0, p0)) as open from (select distinct well, md0, md1 from c) join b using (well) where p0 < md1 and md0 < p1 group by all having sum(least(md1, p1) - greatest(md0, p0)) >= 0.01),
    q as (select *, least(1.0::double, open / (md1 - md0)) as part from c join o using (well, md0, md1)),
    n as (select *, (md1 - md0) * part as length, case when abs(ntg - 1.0) <= 0.001 or part <= ntg then case when abs(ntg - 1.0) <= 0.001 then ntg else 1.0 end else ntg / part end as net from q where (md1 - md0) * part >= 0.5),
    p as (select *, perm * net as ki, perm * 0.5::double * net as kj, perm * 0.1::double as kk from n),
    e as (select *, pow(ki * kj * kk, 1.0::double / 3.0) as ke from p),
    h as (select *, case when v = 0 then length * sqrt(ki * kj) else ke * sqrt(pow(length * sqrt(ke / ki) * sin(v) * cos(a), 2) + pow(length * sqrt(ke / kj) * sin(v) * sin(a), 2) + pow(length * sqrt(ke / kk) * cos(v), 2)) end as kh from e)
    select well::bigint as well, row_number() over (partition by well order by md0) - 1 as row, i + 1 as iw, j + 1 as jw, k + 1 as l, {sq6('(md0 + md1) * 0.5')} as md, {sq6('length')} as length, {sq6('part')} as pperf, {sq6('kh')} as kh, {sq6('degrees(v)')} as anglv from h where kh >= 20"""
)
def well_spec_frame(spark: SparkSession, d: str) -> DataFrame:
    """Well specifications of perforated intervals within limits on layers, regions, saturation, activity, length and flow capacity."""
    s = _samples(spark, d)
    following = Window.partitionBy("well").orderBy("md")
    pieces = s.select("well", "event_id", F.col("md").alias("md0"), F.lead("md").over(following).alias("md1")).filter("md1 is not null")
    opened = s.filter("event_type in ('purchase', 'click')").select("well", F.col("md").alias("md0"), ((F.col("md") + F.lead("md").over(following)) * 0.5).alias("md1"))
    c, e = cells(spark, d), F.col("event_id")
    m = c.agg(F.count("*").alias("m"))
    at = pieces.crossJoin(F.broadcast(m)).withColumn("cell_id", e % F.col("m")).join(c, "cell_id")
    at = at.withColumns({"satw": (e % 10) / 10.0, "region": e % 5, "ki": F.col("perm"), "kj": F.col("perm") * 0.5, "kk": F.col("perm") * 0.1, "anglv": (e % 4) * 0.3, "angla": F.lit(0.7)})
    found = wellspec.frame(at, _LIMITS, opened, columns=("MD", "LENGTH", "PPERF", "KH", "ANGLV"))
    return found.select(F.col("well").cast("long").alias("well"), "row", *(F.col(n).cast("long").alias(n.lower()) for n in ("IW", "JW", "L")), *(q6(F.col(n)).alias(n.lower()) for n in ("MD", "LENGTH", "PPERF", "KH", "ANGLV")))

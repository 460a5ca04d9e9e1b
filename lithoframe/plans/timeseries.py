"""Time-series queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators import timeseries as ts
from lithoframe.plans import q6, query, sq6, table


@query("select event_id, row_number() over w - 1 as idx, (epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6 as step_seconds, cast(floor((epoch_us(ts) - lag(epoch_us(ts)) over w) / 86400000000) as bigint) as step_days, cast(floor((epoch_us(ts) - first(epoch_us(ts)) over w) / 86400000000) as bigint) as days_since_start from events window w as (partition by user_id order by ts)")
def timeseries_steps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("ts", "t")
    return ts.steps(e, by="user_id").select("event_id", F.col("idx").cast("long").alias("idx"), "step_seconds", "step_days", "days_since_start")


@query("select distinct date_trunc('hour', ts) as t from events where event_type in ('click', 'view')")
def timeseries_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.date_trunc("hour", "ts"))
    return ts.merged(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"))


_ASOF = """with l as (select event_id, user_id, ts from events where event_type = 'purchase'), r as (select event_id, user_id, ts from events where event_type = 'click'),
b as (select l.event_id, r.event_id as bid, r.ts as bts from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts),
a as (select l.event_id, r.event_id as aid, r.ts as ats from l asof left join r on l.user_id = r.user_id and l.ts <= r.ts)
select l.event_id, {} from l join b using (event_id) join a using (event_id)"""


def _asof(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    left, right = (e.filter(F.col("event_type") == x).drop("event_type") for x in ("purchase", "click"))
    return ts.as_of(left, right, "user_id", "ts", ["event_id"])


@query(_ASOF.format("bid as found"))
def timeseries_not_later(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d).select("event_id", F.col("before_event_id").alias("found"))


@query(_ASOF.format("aid as found"))
def timeseries_not_earlier(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d).select("event_id", F.col("after_event_id").alias("found"))


@query(_ASOF.format("case when ats is null then bid when bts is null then aid when epoch_us(l.ts) - epoch_us(bts) <= epoch_us(ats) - epoch_us(l.ts) then bid else aid end as found"))
def timeseries_nearest(spark: SparkSession, d: str) -> DataFrame:
    t = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("ts", "before_ts", "after_ts")]
    return _asof(spark, d).select("event_id", F.when(ts.nearest(*t), F.col("before_event_id")).otherwise(F.col("after_event_id")).alias("found"))


@query(
    f"""with l as (select event_id, user_id, ts from events where event_type = 'purchase'), r as (select user_id, ts, value from events where event_type = 'click'),
    b as (select l.*, r.ts as t0, r.value as v0 from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts),
    a as (select l.event_id, r.ts as t1, r.value as v1 from l asof left join r on l.user_id = r.user_id and l.ts <= r.ts)
    select event_id, {sq6('case when t0 = t1 then v0 else v0 + (epoch_us(ts) - epoch_us(t0)) * (v1 - v0) / (epoch_us(t1) - epoch_us(t0)) end')} as value from b join a using (event_id)"""
)
def timeseries_interpolated(spark: SparkSession, d: str) -> DataFrame:
    """Values between the samples on either side; null beyond the first and last."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    j = ts.as_of(left, e.filter("event_type = 'click'"), "user_id", "ts", ["value"])
    t, t0, t1 = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("ts", "before_ts", "after_ts"))
    return j.select("event_id", q6(ts.lerped(t, t0, F.col("before_value"), t1, F.col("after_value"))).alias("value"))


@query(
    """with h as (select user_id, date_trunc('day', ts) as day, max(value) as value from events group by all),
    g as (select user_id, unnest(generate_series(min(day), max(day), interval 1 day)) as day from h group by user_id),
    j as (select g.user_id, g.day, h.value from g left join h using (user_id, day))
    select user_id, strftime(day, '%Y-%m-%d') as day, last_value(value ignore nulls) over (partition by user_id order by day) as value, value is null as filled from j"""
)
def timeseries_fill(spark: SparkSession, d: str) -> DataFrame:
    """Daily values with missing days filled from the day before."""
    e = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.max("value").alias("value"))
    ends = e.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select("user_id", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    j = days.join(e, ["user_id", "day"], "left")
    value = F.expr("last_value(value) ignore nulls over (partition by user_id order by day)")
    return j.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), value.alias("value"), F.col("value").isNull().alias("filled"))

"""Time series: steps, merges and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(series: DataFrame, time: str = "t", by: str = "series") -> DataFrame:
    """idx from 0, seconds and whole days since the previous time and since the first; null for the first step."""
    w = Window.partitionBy(by).orderBy(time)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    return series.withColumns(
        {
            "idx": F.row_number().over(w) - 1,
            "step_seconds": (t - F.lag(t).over(w)) / 1e6,
            "step_days": F.floor((t - F.lag(t).over(w)) / 86_400_000_000),
            "days_since_start": F.floor((t - F.first(t).over(w)) / 86_400_000_000),
        }
    )


def merged(*series: DataFrame, time: str = "t") -> DataFrame:
    """Distinct times of several series."""
    out = series[0].select(time)
    for s in series[1:]:
        out = out.unionByName(s.select(time))
    return out.distinct()


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, carry: list[str]) -> DataFrame:
    """``left`` with the ``carry`` columns (and time) of the last row of ``right`` not later (before_*) and the first not earlier (after_*).

    Both sides go once through one sort by key and time; no pairs are made.
    """
    cols = [time, *carry]
    have = F.struct(*(F.col(c) for c in cols))
    r = right.select(by, time, F.lit(1).alias("__side"), have.alias("__have"))
    own = F.struct(*(F.col(c) for c in left.columns))
    both = left.select(by, time, F.lit(0).alias("__side"), F.lit(None).cast(r.schema["__have"].dataType).alias("__have"), own.alias("__own")).unionByName(r, allowMissingColumns=True)
    # rows at the same time count for both directions; either frame grows with its sort, so that a key costs one pass each way
    grows = (Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(by).orderBy(time).rangeBetween(*grows)
    ahead = Window.partitionBy(by).orderBy(F.desc(time)).rangeBetween(*grows)
    joined = both.withColumns({"__b": F.last("__have", ignorenulls=True).over(back), "__a": F.last("__have", ignorenulls=True).over(ahead)}).filter("__side = 0")
    return joined.select("__own.*", *(F.col(f"__b.{c}").alias(f"before_{c}") for c in cols), *(F.col(f"__a.{c}").alias(f"after_{c}") for c in cols))


def nearest(value: Column, before: Column, after: Column) -> Column:
    """Whether the earlier of the two is taken: it is nearer, as near, or the only one."""
    return F.when(after.isNull(), before.isNotNull()).when(before.isNull(), F.lit(False)).otherwise(value - before <= after - value)


def lerped(at: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear interpolation between two samples; null outside them."""
    return F.when(x0 == x1, y0).otherwise(y0 + (at - x0) * (y1 - y0) / F.nullif(x1 - x0, F.lit(0)))


def looked_up(values: DataFrame, curve: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """``values`` with ``y`` of a curve (by, x, y), straight between its points; beyond its ends the nearest end counts."""
    j = as_of(values, curve, by, x, [y])
    before, after = (F.col(f"before_{x}"), F.col(f"before_{y}")), (F.col(f"after_{x}"), F.col(f"after_{y}"))
    between = lerped(F.col(x), before[0], before[1], after[0], after[1])
    found = F.when(before[0].isNull(), after[1]).when(after[0].isNull(), before[1]).otherwise(between)
    return j.select(*values.columns, found.alias(y))


def from_summary(steps: DataFrame, start: str | None = None, by: str = "path") -> DataFrame:
    """by, step (0 is the start, none left out), days since the start and timestamp, of ``steps(by, step, days, date)`` as summaries report them.

    The series starts at the date of the first step, less the whole days up to it; without
    dates at ``start``, or else 2020-01-01. Of several rows of a step the first in time
    counts. Steps that are missing, or whose time lies before an earlier one's, add no days.
    """
    order = Window.partitionBy(by).orderBy("step")
    one = steps.groupBy(by, "step").agg(F.min(F.struct("days", "date")).alias("s")).select(by, "step", "s.days", "s.date")
    first = one.groupBy(by).agg(F.min(F.struct("step", "days", "date")).alias("f"))
    given = F.to_date(F.lit(start or "2020-01-01"))
    back = F.when(F.col("f.step") > 0, F.floor("f.days")).otherwise(0).cast("int")
    first = first.select(by, F.coalesce(F.date_sub("f.date", back), given).alias("start"))
    grown = F.greatest(F.max("days").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0))
    positive = one.filter("step > 0").withColumns({"grown": grown, "before": F.coalesce(F.lag("step").over(order), F.lit(0))})
    positive = positive.withColumn("was", F.coalesce(F.lag("grown").over(order), F.lit(0.0)))
    filled = positive.withColumn("n", F.explode(F.sequence(F.col("before") + 1, F.col("step"))))
    later = filled.select(by, F.col("n").alias("step"), F.when(F.col("n") == F.col("step"), F.col("grown")).otherwise(F.col("was")).alias("days"))
    rows = first.select(by, F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("days")).unionByName(later).join(first, by)
    seconds = F.make_dt_interval(secs=F.round(F.col("days") * 86400.0, 6).cast("decimal(18,6)"))
    return rows.select(by, "step", "days", (F.col("start").cast("timestamp_ntz") + seconds).alias("timestamp"))

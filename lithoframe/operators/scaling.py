"""Up- and downscaling between fine and coarse grids, stacks of arrays, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column, total: Column | None = None) -> Column:
    """sum(value * weight) over sum(weight), or over a coarse weight; null where that is 0, null or NaN.

    Nulls and NaNs are left out of either sum on their own: a missing value adds nothing
    above, but its weight still counts below.
    """
    known = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    terms = F.coalesce(F.sum(known(value.cast("double") * weight)), F.lit(0.0))
    below = known(total) if total is not None else F.sum(known(weight))
    return terms / F.nullif(below, F.lit(0.0))


def first_sample(value: str, *order: str) -> Column:
    """The value of the first fine cell of a coarse one."""
    return F.min_by(F.col(value), F.struct(*order, value))


def coarse_index(fine: Column, ratio: int) -> Column:
    return F.floor(fine / ratio)


def dominant(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, ties going to the smallest, and how often it occurs (n)."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def refined(coarse: DataFrame, ratios: dict[str, int], axes: tuple[str, ...] = ("k", "j", "i")) -> DataFrame:
    """A row for each fine cell with its own indices (fk, fj, fi), carrying its coarse cell's columns."""
    for a in axes:
        coarse = coarse.withColumn(f"f{a}", F.explode(F.sequence(F.col(a) * ratios[a], F.col(a) * ratios[a] + ratios[a] - 1)))
    return coarse


def stacked(df: DataFrame, key: str, index: str, value: str, count: int, missing=None) -> DataFrame:
    """key and an array of ``count`` values by ``index``; what is missing is filled."""
    picks = [F.coalesce(F.max(F.when(F.col(index) == k, F.col(value))), F.lit(missing)) if missing is not None else F.max(F.when(F.col(index) == k, F.col(value))) for k in range(count)]
    return df.groupBy(key).agg(F.array(*picks).alias("values"))

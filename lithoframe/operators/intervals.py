"""Joins of intervals that overlap, by levels of bins.

An interval belongs to the level whose bins are the shortest that are no shorter than
itself, so that it reaches into two of them at most. Two intervals meet at the level of
the longer one: each side goes into the bins of its own level, and once more into those of
every longer level that the other side has. Every pair is then found by an equi-join, and
bins hold little besides what overlaps, whatever lengths are mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths below 2 to the power of this count as if they had it.
_SHORTEST = -60


def _level(low: Column, high: Column) -> Column:
    return F.greatest(F.coalesce(F.ceil(F.log2(F.nullif(high - low, F.lit(0.0)))), F.lit(_SHORTEST)), F.lit(_SHORTEST)).cast("int")


def overlapping(a: DataFrame, b: DataFrame, by: list[str], a_ends: tuple[str, str], b_ends: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal ``by`` whose intervals share more than an end, each pair once; other columns must have different names.

    Intervals that are null, not finite or reversed meet nothing.
    """

    def sound(df: DataFrame, ends: tuple[str, str], level: str) -> DataFrame:
        fine = " and ".join(f"abs({e}) < double('infinity')" for e in ends)
        return df.filter(f"{fine} and {ends[0]} <= {ends[1]}").withColumn(level, _level(*(F.col(e).cast("double") for e in ends)))

    a, b = sound(a, a_ends, "a_level"), sound(b, b_ends, "b_level")
    # powers of two: as many as lengths have orders of magnitude
    levels = {side: sorted(r[0] for r in df.select(side).distinct().collect()) for side, df in (("a_level", a), ("b_level", b))}
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def binned(df: DataFrame, ends: tuple[str, str], level: Column) -> DataFrame:
        df = df.withColumn("bin_level", level)
        at = lambda e: F.floor(F.col(e) / F.pow(F.lit(2.0), "bin_level"))
        df = df.withColumn("bin", F.explode(F.sequence(at(ends[0]), at(ends[1]))))
        # a given number of tasks, as small inputs would be put into one, in which the pairs then arise
        return df.repartition(tasks, *by, "bin_level", "bin")

    def longer(own: str, other: str, also_equal: bool) -> Column:
        there = F.array(*(F.lit(x) for x in levels[other])).cast("array<int>")
        return F.explode(F.filter(there, lambda x: (x >= F.col(own)) if also_equal else (x > F.col(own))))

    keys = [*by, "bin_level", "bin"]
    at_b = binned(a, a_ends, longer("a_level", "b_level", True)).join(binned(b, b_ends, F.col("b_level")).hint("shuffle_hash"), keys)
    at_a = binned(a, a_ends, F.col("a_level")).join(binned(b, b_ends, longer("b_level", "a_level", False)).hint("shuffle_hash"), keys)
    low = F.greatest(a_ends[0], b_ends[0])
    meet = (F.col(a_ends[0]) < F.col(b_ends[1])) & (F.col(b_ends[0]) < F.col(a_ends[1]))
    # of the bins that both reach into, that with the greater low end counts
    first = F.floor(low / F.pow(F.lit(2.0), "bin_level")) == F.col("bin")
    return at_b.unionByName(at_a).filter(meet & first).drop("bin_level", "bin", "a_level", "b_level")

"""Property values: normalisation, derived permeability, interpolation, face order, selection."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(df: DataFrame, value: str, out: str, *, log: bool = False, cycle: int | None = None, zero_at: float | None = None, mask: str | None = None) -> DataFrame:
    """``df`` with ``value`` mapped to 0..1 by its least and greatest (NaN apart), which are found by one aggregation.

    Equal extremes map to 0.5. With ``cycle``, whole numbers count modulo it, and the
    range is that of its remainders, 0 to cycle - 1, whichever occur. With ``log``, values below 0.0001 are raised to it if any
    is not positive. ``zero_at`` pins zero at 0 or 1 (values beyond are clipped) or in
    between (the range is stretched on one side). ``mask`` names a column of rows to
    take the extremes from.
    """
    if log and zero_at is not None:
        raise ValueError("a logarithm has no zero to pin")
    v = F.col(value).cast("double")
    if cycle:
        v = F.pmod(v, F.lit(float(cycle)))
    v = F.nanvl(v, F.lit(None).cast("double"))
    rows = df.filter(mask) if mask else df
    ends = rows.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if ends.lo is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    lo, hi = ends.lo, ends.hi
    if log:
        least = 0.0001 if lo <= 0 else lo
        v = F.log10(F.greatest(v, F.lit(0.0001)) if lo <= 0 else v)
        lo, hi = math.log10(max(lo, least)), math.log10(max(hi, least))
    elif cycle:
        lo, hi = 0.0, cycle - 1.0
    if zero_at is not None:
        if zero_at <= 0.0:
            v, lo = F.greatest(v, F.lit(0.0)), 0.0
        elif zero_at >= 1.0:
            v, hi = F.least(v, F.lit(0.0)), 0.0
        else:
            # the wider side decides the scale
            up, down = max(hi, 0.0) / (1.0 - zero_at), max(-lo, 0.0) / zero_at
            span = max(up, down)
            lo, hi = -span * zero_at, span * (1.0 - zero_at)
    if lo == hi:
        return df.withColumn(out, F.when(v.isNotNull(), F.lit(0.5)))
    return df.withColumn(out, (v - lo) / (hi - lo))


def vertical_permeability(ki: Column, kj: Column, ratio: float, ntg: Column | None = None, squared: bool = False) -> Column:
    k = F.sqrt(ki * kj) * ratio
    if ntg is None:
        return k
    return k * ntg * ntg if squared else k * ntg


def trilinear(corners: dict[tuple[int, int, int], Column], fk: float, fj: float, fi: float) -> Column:
    """A value inside a cell from those at its corners (kp, jp, ip)."""
    parts = [v * ((fk if kp else 1 - fk) * (fj if jp else 1 - fj) * (fi if ip else 1 - fi)) for (kp, jp, ip), v in corners.items()]
    return reduce(lambda a, b: a + b, parts)


def reordered(values: Column, order: list[int]) -> Column:
    return F.array(*(values[k] for k in order))


def same_kind(a: Column, b: Column) -> Column:
    """Property kinds are equal if their words are, in any order ('rock permeability', 'permeability rock')."""
    words = lambda c: F.array_join(F.array_sort(F.split(F.lower(F.trim(c)), r"\s+")), " ")
    return words(a) == words(b)


def selected(properties: DataFrame, **wanted) -> DataFrame:
    """Rows of a property table that fulfil all conditions: a value, '*' for any, 'none' for null; None for no condition."""
    conditions = []
    for name, value in wanted.items():
        c = F.col(name)
        if value is None:
            continue
        if value == "*":
            conditions.append(c.isNotNull())
        elif value == "none":
            conditions.append(c.isNull())
        elif name == "property_kind":
            conditions.append(same_kind(c, F.lit(value)))
        else:
            conditions.append(c == value)
    return properties.filter(reduce(lambda a, b: a & b, conditions)) if conditions else properties

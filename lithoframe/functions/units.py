"""Units of measure: y = (A + B x) / (C + D x) to the base unit of the dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public definitions of units, as A, B, C, D of the conversion to the base unit.
UNITS = [
    ("m", "L", "m", 0.0, 1.0, 1.0, 0.0),
    ("cm", "L", "m", 0.0, 0.01, 1.0, 0.0),
    ("km", "L", "m", 0.0, 1000.0, 1.0, 0.0),
    ("ft", "L", "m", 0.0, 0.3048, 1.0, 0.0),
    ("in", "L", "m", 0.0, 0.0254, 1.0, 0.0),
    ("mm", "L", "m", 0.0, 0.001, 1.0, 0.0),
    ("yd", "L", "m", 0.0, 0.9144, 1.0, 0.0),
    ("mi", "L", "m", 0.0, 1609.344, 1.0, 0.0),
    ("m2", "L2", "m2", 0.0, 1.0, 1.0, 0.0),
    ("ft2", "L2", "m2", 0.0, 0.09290304, 1.0, 0.0),
    ("ha", "L2", "m2", 0.0, 10000.0, 1.0, 0.0),
    ("acre", "L2", "m2", 0.0, 4046.8564224, 1.0, 0.0),
    ("kg", "M", "kg", 0.0, 1.0, 1.0, 0.0),
    ("g", "M", "kg", 0.0, 0.001, 1.0, 0.0),
    ("t", "M", "kg", 0.0, 1000.0, 1.0, 0.0),
    ("lbm", "M", "kg", 0.0, 0.45359237, 1.0, 0.0),
    ("N", "ML/T2", "N", 0.0, 1.0, 1.0, 0.0),
    ("lbf", "ML/T2", "N", 0.0, 4.4482216152605, 1.0, 0.0),
    ("J", "ML2/T2", "J", 0.0, 1.0, 1.0, 0.0),
    ("kJ", "ML2/T2", "J", 0.0, 1000.0, 1.0, 0.0),
    ("W", "ML2/T3", "W", 0.0, 1.0, 1.0, 0.0),
    ("kW", "ML2/T3", "W", 0.0, 1000.0, 1.0, 0.0),
    ("Pa.s", "M/LT", "Pa.s", 0.0, 1.0, 1.0, 0.0),
    ("cP", "M/LT", "Pa.s", 0.0, 0.001, 1.0, 0.0),
    ("rad", "angle", "rad", 0.0, 1.0, 1.0, 0.0),
    ("dega", "angle", "rad", 0.0, 0.017453292519943295, 1.0, 0.0),
    ("s", "T", "s", 0.0, 1.0, 1.0, 0.0),
    ("ms", "T", "s", 0.0, 0.001, 1.0, 0.0),
    ("min", "T", "s", 0.0, 60.0, 1.0, 0.0),
    ("h", "T", "s", 0.0, 3600.0, 1.0, 0.0),
    ("d", "T", "s", 0.0, 86400.0, 1.0, 0.0),
    ("wk", "T", "s", 0.0, 604800.0, 1.0, 0.0),
    ("Pa", "M/LT2", "Pa", 0.0, 1.0, 1.0, 0.0),
    ("kPa", "M/LT2", "Pa", 0.0, 1000.0, 1.0, 0.0),
    ("bar", "M/LT2", "Pa", 0.0, 100000.0, 1.0, 0.0),
    ("MPa", "M/LT2", "Pa", 0.0, 1000000.0, 1.0, 0.0),
    ("atm", "M/LT2", "Pa", 0.0, 101325.0, 1.0, 0.0),
    ("psi", "M/LT2", "Pa", 0.0, 6894.757293168361, 1.0, 0.0),
    ("m3", "L3", "m3", 0.0, 1.0, 1.0, 0.0),
    ("L", "L3", "m3", 0.0, 0.001, 1.0, 0.0),
    ("bbl", "L3", "m3", 0.0, 0.158987294928, 1.0, 0.0),
    ("ft3", "L3", "m3", 0.0, 0.028316846592, 1.0, 0.0),
    ("m3/d", "L3/T", "m3/s", 0.0, 1.0, 86400.0, 0.0),
    ("bbl/d", "L3/T", "m3/s", 0.0, 0.158987294928, 86400.0, 0.0),
    ("degR", "K", "K", 0.0, 5.0, 9.0, 0.0),
    ("K", "K", "K", 0.0, 1.0, 1.0, 0.0),
    ("degC", "K", "K", 273.15, 1.0, 1.0, 0.0),
    ("degF", "K", "K", 2298.35, 5.0, 9.0, 0.0),
    ("mD", "L2", "m2", 0.0, 9.869233e-16, 1.0, 0.0),
    ("D", "L2", "m2", 0.0, 9.869233e-13, 1.0, 0.0),
    ("cP.m3/(kPa.d)", "transmissibility", "Pa.s.m3/(Pa.s)", 0.0, 0.001, 86400000.0, 0.0),
    ("cP.bbl/(psi.d)", "transmissibility", "Pa.s.m3/(Pa.s)", 0.0, 0.000158987294928, 6894.757293168361 * 86400.0, 0.0),
    ("%", "1", "Euc", 0.0, 0.01, 1.0, 0.0),
    ("Euc", "1", "Euc", 0.0, 1.0, 1.0, 0.0),
]
#: Names under which units are also known.
ALIASES = {"metre": "m", "meter": "m", "metres": "m", "feet": "ft", "foot": "ft", "day": "d", "days": "d", "hours": "h", "hour": "h", "barrel": "bbl", "stb": "bbl", "stb/d": "bbl/d", "v/v": "Euc", "percent": "%", "millidarcy": "mD", "degrees": "dega", "deg": "dega", "radians": "rad", "centipoise": "cP", "celsius": "degC", "fahrenheit": "degF"}
SCHEMA = "unit string, dimension string, base string, a double, b double, c double, d double"


def unit_table(spark: SparkSession) -> DataFrame:
    """A row for each known unit, and for each ratio of two of them that is none itself ("psi/ft"): a few thousand."""
    units = spark.createDataFrame(UNITS, SCHEMA)
    linear = units.filter("a = 0 and d = 0 and instr(unit, '/') = 0")
    n, m = linear.alias("n"), linear.alias("m")
    joined = lambda c: F.concat(f"n.{c}", F.lit("/"), f"m.{c}")
    factor = (F.col("n.b") / F.col("n.c")) / (F.col("m.b") / F.col("m.c"))
    zero = F.lit(0.0)
    # both sides are the fixed table above
    ratios = n.crossJoin(m).select(joined("unit").alias("unit"), joined("dimension").alias("dimension"), joined("base").alias("base"), zero.alias("a"), factor.alias("b"), F.lit(1.0).alias("c"), zero.alias("d"))
    return units.unionByName(ratios.join(units.select("unit"), "unit", "left_anti"))


def to_base(x: Column, a, b, c, d) -> Column:
    return (a + b * x) / (c + d * x)


def from_base(y: Column, a, b, c, d) -> Column:
    return (a - c * y) / (d * y - b)


def converted(df: DataFrame, value: str, source: str, target: str, out: str) -> DataFrame:
    """``df`` with ``value`` converted between the units in columns ``source`` and ``target``; null where their dimensions differ."""
    units = unit_table(df.sparkSession)
    a = F.broadcast(units.select(F.col("unit").alias(source), F.struct("dimension", "a", "b", "c", "d").alias("__s")))
    b = F.broadcast(units.select(F.col("unit").alias(target), F.struct("dimension", "a", "b", "c", "d").alias("__t")))
    joined = df.join(a, source, "left").join(b, target, "left")
    base = to_base(F.col(value), *(F.col(f"__s.{k}") for k in "abcd"))
    there = from_base(base, *(F.col(f"__t.{k}") for k in "abcd"))
    result = F.when(F.col(source) == F.col(target), F.col(value)).when(F.col("__s.dimension") == F.col("__t.dimension"), there)
    return joined.withColumn(out, result).drop("__s", "__t")


def parsed(text: Column) -> Column:
    """The unit a text names: as it stands, without regard to case where that is unambiguous, or by an alias."""
    names = [u[0] for u in UNITS]
    lower: dict[str, list[str]] = {}
    for n in names:
        lower.setdefault(n.lower(), []).append(n)
    plain = F.trim(F.regexp_replace(text, r"[\[\]()]", ""))
    exact = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(n))])
    folded = F.create_map(*[x for k, v in lower.items() if len(v) == 1 for x in (F.lit(k), F.lit(v[0]))])
    alias = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(exact, plain), F.try_element_at(alias, F.lower(plain)), F.try_element_at(folded, F.lower(plain)))

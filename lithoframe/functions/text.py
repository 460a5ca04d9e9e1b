"""Text and small number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_at(text: Column, keyword: str) -> Column:
    """Position of a keyword from 1; 0 if it doesn't occur."""
    return F.instr(text, keyword).cast("long")


def first_line(text: Column) -> Column:
    return F.trim(F.split(text, "\n")[0])


def split_comment(line: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after a comment mark; no comment is null."""
    parts = F.split(line, f"\\Q{mark}\\E", 2)
    return F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))


def tag_text(xml: Column, tag: str) -> Column:
    return F.regexp_extract(xml, f"<{tag}>([^<]*)</{tag}>", 1)


def tag_attribute(xml: Column, tag: str, attribute: str) -> Column:
    return F.regexp_extract(xml, f'<{tag}[^>]*{attribute}="([a-z]*)"', 1)


def box_text(box) -> Column:
    """First and last i, j and k, counted from 1, of a box of (first, last) for k, j and i from 0."""
    return F.concat_ws(" ", *((v + 1).cast("string") for axis in reversed(box) for v in axis))


def simple_time(t: Column) -> Column:
    """A date, and the time of day unless it is midnight."""
    midnight = F.date_format(t, "HH:mm:ss") == "00:00:00"
    return F.when(midnight, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))


def factors(n: Column) -> Column:
    """All factors in ascending order; tried up to the square root."""
    low = F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(n.cast("double"))).cast("int")), lambda x: n % x == 0)
    return F.array_sort(F.array_distinct(F.concat(low, F.transform(low, lambda x: (n / x).cast("int")))))


def prime_factors(n: Column) -> Column:
    """Prime factors in ascending order, with repetition: each number up to the square root is divided out as often as it goes."""
    state = F.struct(n.cast("long").alias("rest"), F.array().cast("array<long>").alias("found"))

    def divide(s: Column, p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(40)), s, lambda t, _: F.when(t["rest"] % p == 0, F.struct((t["rest"] / p).cast("long").alias("rest"), F.array_append(t["found"], p).alias("found"))).otherwise(t))

    upto = F.when(n >= 4, F.sequence(F.lit(2), F.floor(F.sqrt(n.cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(upto, lambda x: x.cast("long")), state, divide, lambda s: F.when(s["rest"] > 1, F.array_append(s["found"], s["rest"])).otherwise(s["found"]))

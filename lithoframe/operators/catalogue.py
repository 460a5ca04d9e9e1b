"""Queries over a catalogue: parts (uuid, obj_type, title, created, extra) and relationships (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.storage import settled

_MODES = {
    "is": lambda t, s: t == s,
    "starts": lambda t, s: F.startswith(t, F.lit(s)),
    "ends": lambda t, s: F.endswith(t, F.lit(s)),
    "contains": lambda t, s: F.contains(t, F.lit(s)),
}


def title_matches(title: Column, wanted: str, mode: str = "is", case_sensitive: bool = False) -> Column:
    """Modes is, starts, ends and contains, each also as 'is not', 'does not start', 'does not end', 'does not contain'. Titles are stripped."""
    negated = "not" in mode
    base = next(m for m in _MODES if m in mode or (m == "starts" and "start" in mode) or (m == "ends" and "end" in mode) or (m == "contains" and "contain" in mode))
    t, s = F.trim(title), wanted.strip()
    if not case_sensitive:
        t, s = F.upper(t), s.upper()
    found = _MODES[base](t, s)
    return ~found if negated else found


def parts(
    catalogue: DataFrame, *, among: list[str] | None = None, uuid: str | None = None, obj_type: str | None = None, title: str | None = None, title_mode: str = "is",
    case_sensitive: bool = False, extra: dict[str, str] | None = None, related: tuple[DataFrame, str] | None = None, sort_by: str | None = None,
) -> DataFrame:
    """Parts that fulfil all conditions given. An empty ``among`` stands for all parts; ``related`` is (relationships, uuid)."""
    found = catalogue
    if among:
        found = found.filter(F.col("uuid").isin(among))
    if uuid:
        found = found.filter(same_uuid(F.col("uuid"), F.lit(uuid)))
    if obj_type:
        plain = obj_type.removeprefix("obj_")
        found = found.filter(F.regexp_replace("obj_type", "^obj_", "") == plain)
    if title is not None:
        found = found.filter(title_matches(F.col("title"), title, title_mode, case_sensitive))
    for k, v in (extra or {}).items():
        found = found.filter(F.col("extra")[k] == v)
    if related:
        found = found.join(neighbours(*related), "uuid", "left_semi")
    return ordered(found, sort_by) if sort_by else found


def neighbours(relationships: DataFrame, uuid: str) -> DataFrame:
    """uuids that a part refers to or is referred to by."""
    a = relationships.filter(F.col("src") == uuid).select(F.col("dst").alias("uuid"))
    b = relationships.filter(F.col("dst") == uuid).select(F.col("src").alias("uuid"))
    return a.unionByName(b).distinct()


def ordered(catalogue: DataFrame, by: str) -> DataFrame:
    key = {"newest": F.desc("created"), "oldest": F.asc("created"), "title": F.asc("title"), "uuid": F.asc("uuid"), "type": F.asc("obj_type")}[by]
    return catalogue.orderBy(key, "uuid")


def one_of(catalogue: DataFrame, multiple: str = "exception") -> DataFrame:
    """One row, or none: of several the first, newest or oldest, or an exception."""
    if multiple in ("first", "newest", "oldest"):
        order = {"first": [F.asc("uuid")], "newest": [F.desc("created"), F.asc("uuid")], "oldest": [F.asc("created"), F.asc("uuid")]}[multiple]
        return catalogue.orderBy(*order).limit(1)
    n = catalogue.limit(2).count()
    if n > 1 and multiple == "exception":
        raise ValueError("more than one part fulfils the conditions")
    return catalogue if n < 2 else catalogue.limit(0)


def same_uuid(a: Column, b: Column) -> Column:
    """Hyphens and letter case aside."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[^0-9A-Fa-f]", ""))
    return plain(a) == plain(b)


def references(relationships: DataFrame, start: DataFrame) -> DataFrame:
    """uuids that can be reached from ``start(uuid)`` along references, with the fewest steps.

    The frontier is joined with the relationships until it is empty, however many steps
    that takes; only new uuids go on, and each round's lineage is cut.
    """
    seen = start.select("uuid").distinct().withColumn("steps", F.lit(0))
    frontier, step = seen, 0
    while True:
        step += 1
        found = frontier.join(relationships, F.col("uuid") == F.col("src")).select(F.col("dst").alias("uuid")).distinct()
        frontier = settled(found.join(seen, "uuid", "left_anti").withColumn("steps", F.lit(step)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if step % 16 == 0:
            seen = settled(seen.repartition("uuid"))


def supported_by(catalogue: DataFrame, supports: DataFrame, uuid: str) -> DataFrame:
    """Parts that lean on one part: a semi join with ``supports(uuid, support)``."""
    wanted = supports.filter(same_uuid(F.col("support"), F.lit(uuid))).select("uuid")
    return catalogue.join(wanted, "uuid", "left_semi")


def in_type_order(catalogue: DataFrame, order: list[str]) -> DataFrame:
    """``catalogue`` with place: types in ``order`` first, then others, then representations, and properties last; sorted by it and uuid."""
    plain = F.regexp_replace("obj_type", "^obj_", "")
    listed = F.array_position(F.array(*(F.lit(x) for x in order)), plain)
    n = len(order)
    other = F.when(plain.endswith("Representation"), n + 3).when(plain.endswith("Property"), n + 4).otherwise(n + 1)
    return catalogue.withColumn("place", F.when(listed > 0, listed).otherwise(other).cast("long")).orderBy("place", "uuid")


def gathered(members: list[DataFrame], equal: list[str]) -> DataFrame:
    """Catalogues of an ensemble as one, with realization; parts that agree in the columns ``equal`` keep one uuid, that of the first realization, as gathered."""
    rows = None
    for n, m in enumerate(members):
        part = m.withColumn("realization", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    own = [F.col(c).alias(f"__{n}") for n, c in enumerate(equal)]
    first = rows.groupBy(*own).agg(F.min_by("uuid", F.struct("realization", "uuid")).alias("gathered"))
    on = F.lit(True)
    for n, c in enumerate(equal):
        on &= F.col(c).eqNullSafe(F.col(f"__{n}"))
    return rows.join(first, on).drop(*(f"__{n}" for n in range(len(equal))))

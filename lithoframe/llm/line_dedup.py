"""Line dedup: windows of three consecutive lines that repeat anywhere lose their later occurrences.

Every document gives one hash for each window of three lines (trimmed; a window of blank
lines only counts for nothing). A grouped minimum finds the first occurrence of each
hash in the order of doc_id and position; every other occurrence covers its three lines,
and the union of covered lines is removed from each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.storage import settled

WINDOW = 3
#: Documents with repeated lines that are told to all tasks, and a tenth of the places in them; beyond that texts are shuffled.
SENT_DOCS = 100_000


def repeated_windows(keyed: DataFrame) -> DataFrame:
    """doc, pos of each later occurrence; ``keyed`` has doc (a sortable key) and lines."""
    cut = F.expr(
        f"""filter(transform(sequence(0, size(lines) - {WINDOW}), i -> struct(i as pos,
            xxhash64({", ".join(f"trim(lines[i + {k}])" for k in range(WINDOW))}) as h1,
            xxhash64(1, {", ".join(f"trim(lines[i + {k}])" for k in range(WINDOW))}) as h2,
            {" or ".join(f"trim(lines[i + {k}]) <> ''" for k in range(WINDOW))} as solid)), w -> w.solid)"""
    )
    windows = settled(keyed.filter(F.size("lines") >= WINDOW).select("doc", F.explode(cut).alias("w")).select("doc", "w.pos", "w.h1", "w.h2"))
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return windows.join(first.drop("n"), ["h1", "h2"]).filter(F.struct("doc", "pos") > F.col("first")).select("doc", "pos")


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated lines removed from its text, and n_lines, n_removed and removed (merged spans, first to last line).

    A null text stays null with no lines; an empty one has one. Texts of fewer than three
    lines stay. Rows equal in doc_id and text are one document and come out alike; a null
    doc_id sorts first. Other columns are kept; columns named like the results are replaced.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("t"))
    lines = F.split(F.col(text), "\n", -1)
    later = repeated_windows(docs.select(key.alias("doc"), lines.alias("lines")))
    covered = settled(later.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("__at")))
    size = covered.agg(F.count("*").alias("docs"), F.sum(F.size("__at")).alias("places")).first()
    # texts without repeats pass by where what repeats is small enough to go to them
    if size.docs <= SENT_DOCS and (size.places or 0) <= 10 * SENT_DOCS:
        covered = F.broadcast(covered)
    rest = [F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed", "removed", text)]
    joined = docs.withColumn("__doc", key).join(covered.withColumnRenamed("doc", "__key"), F.col("__doc").eqNullSafe(F.col("__key")), "left")
    joined = joined.withColumns({"__lines": lines})
    gone = F.expr(f"array_distinct(flatten(transform(__at, p -> sequence(p, p + {WINDOW - 1}))))")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    merged = F.expr(
        f"""aggregate(__at, cast(array() as array<struct<first: int, last: int>>), (spans, p) ->
            if(size(spans) > 0 and element_at(spans, -1).last + 1 >= p,
               concat(slice(spans, 1, size(spans) - 1), array(struct(element_at(spans, -1).first as first, p + {WINDOW - 1} as last))),
               concat(spans, array(struct(p as first, p + {WINDOW - 1} as last)))))"""
    )
    return joined.withColumn("__gone", gone).select(
        *rest,
        F.when(F.col("__at").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")).alias(text),
        F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.when(F.col("__at").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_removed"),
        F.when(F.col("__at").isNotNull(), merged).alias("removed"),
    )

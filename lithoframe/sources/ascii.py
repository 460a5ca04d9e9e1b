"""Text files: arrays, logs, triangulated surfaces and points, read line by line with their places.

Files are read by Spark's text source, so any store that it knows will do, in splits. What
depends on the order of lines or words uses their numbers, which come from the counts of
the splits before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[EeDd][-+]?[0-9]+)?"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block (start of the split), nth (ascending within a split, without holes) and text of each line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.regexp_replace("value", r"\r$", "").alias("text"))


def _before(splits: DataFrame, counted: str, over_files: bool = False) -> DataFrame:
    """``splits`` (a row for each split) with before: the sum of ``counted`` over the splits before it, in its file or in all files in the order of their names."""
    # part-100000 comes after part-99999
    name = F.regexp_extract("path", "[^/]*$", 0)
    order = [F.length(F.regexp_extract(name, r"^\D*(\d*)", 1)), "path", "block"] if over_files else ["block"]
    w = (Window.orderBy(*order) if over_files else Window.partitionBy("path").orderBy(*order)).rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("before", F.coalesce(F.sum(counted).over(w), F.lit(0)))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 0) and text of each line.

    Files are read in splits, each of which keeps the order of its lines. The splits'
    counts say with which number each begins, so that no file is one task's.
    """
    rows = _lines(spark, path)
    splits = _before(rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("nth").alias("first")), "n")
    return rows.join(splits, ["path", "block"]).select("path", (F.col("before") + F.col("nth") - F.col("first")).alias("line"), "text")


def number(text: Column) -> Column:
    """A number, also with D for the exponent; null for anything else."""
    return F.regexp_replace(text, "[Dd]", "E").try_cast("double")


def _section(rows: DataFrame, keyword: str) -> DataFrame:
    """Of each file the lines from the first ``keyword`` to the next line that begins with a word."""
    place = F.struct("block", "nth")
    head = rf"(?i)(?:^|\s){keyword}\b"
    starts = rows.filter(F.col("text").rlike(head)).groupBy("path").agg(F.min(place).alias("start"))
    after = rows.join(starts, "path").filter(place >= F.col("start"))
    ends = after.filter((place > F.col("start")) & F.col("text").rlike(r"^\s*[A-Za-z][A-Za-z_]*\b")).groupBy("path").agg(F.min(place).alias("end"))
    inside = after.join(ends, "path", "left").filter(F.col("end").isNull() | (place < F.col("end")))
    rest = F.regexp_replace("text", rf"(?i)^(?:.*?\s)??{keyword}\b", "")
    return inside.select("path", "block", "nth", F.when(place == F.col("start"), rest).otherwise(F.col("text")).alias("text"))


def array_values(spark: SparkSession, path: str, keyword: str | None = None, comment: str = "!", over_files: bool = False) -> DataFrame:
    """path, cell_id and value of an array of numbers, optionally behind a keyword; ``n*v`` stands for n times v, comments are passed over.

    A word that is no number is a null in its place, so that later values keep theirs.
    Values are numbered from 0 in each file, or, with ``over_files``, through all of them
    in the order of their names, as one array of the given path. Splits count their values, and sums over the splits say
    where each goes on, so that one file takes as many tasks as it has splits.
    """
    rows = _lines(spark, path).withColumn("text", F.regexp_replace("text", rf"\Q{comment}\E.*$", ""))
    if keyword:
        rows = _section(rows, keyword)
    tokens = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda t: (t != "") & (t != "/") & ((F.lit(not keyword)) | ~t.rlike(r"^[A-Za-z_]+$") | t.rlike(r"(?i)^nan$")))
    times = lambda t: F.when(t.rlike(r"^[0-9]+\*"), F.split(t, r"\*")[0].cast("int")).otherwise(1)
    value = lambda t: number(F.element_at(F.split(t, r"\*"), -1))
    some = rows.withColumn("tokens", tokens).filter(F.size("tokens") > 0).select("path", "block", "nth", "tokens")
    counted = some.withColumn("n", F.aggregate("tokens", F.lit(0).cast("long"), lambda total, t: total + times(t)))
    splits = _before(counted.groupBy("path", "block").agg(F.sum("n").alias("in_split")), "in_split", over_files)
    # a split's lines are one sorted group: as many as it has bytes for
    above = Window.partitionBy("path", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).join(splits, ["path", "block"])
    values = F.flatten(F.transform("tokens", lambda t: F.array_repeat(value(t), times(t))))
    spread = placed.select("path", (F.col("before") + F.col("above")).alias("first"), F.posexplode(values).alias("place", "value"))
    return spread.select((F.lit(path) if over_files else F.col("path")).alias("path"), (F.col("first") + F.col("place")).alias("cell_id"), "value")


def log_values(spark: SparkSession, path: str) -> DataFrame:
    """path, md, curve, unit and value of LAS logs; the null value that a file declares is null."""
    files = whole_files(spark, path)
    section = lambda s: F.regexp_extract("text", rf"(?si)(?:^|\n)~{s}[^\n]*\n(.*?)(?:\n~|$)", 1)
    lines = lambda t: F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    curves = F.transform(lines(section("C")), lambda x: F.named_struct(F.lit("name"), F.trim(F.regexp_extract(x, r"^([^.]+)\.", 1)), F.lit("unit"), F.regexp_extract(x, r"^[^.]+\.(\S*)", 1)))
    null = number(F.regexp_extract("text", rf"(?i)\n\s*NULL\s*\.\s*({NUMBER})", 1))
    rows = files.select("path", curves.alias("curves"), null.alias("null"), F.explode(lines(section("A"))).alias("row"))
    cells = rows.withColumn("v", F.split("row", r"\s+")).withColumn("md", number(F.col("v")[0]))
    out = cells.select("path", "md", "null", F.posexplode(F.arrays_zip("curves", "v")).alias("k", "z")).filter("k > 0")
    value = number(F.col("z.v"))
    return out.select("path", "md", F.col("z.curves.name").alias("curve"), F.col("z.curves.unit").alias("unit"), F.when(~value.eqNullSafe(F.col("null")), value).alias("value"))


def triangulated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, node, x, y, z) and triangles (path, n0, n1, n2) of files with VRTX and TRGL lines."""
    words = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+").alias("w"))
    nodes = words.filter(F.col("w")[0].isin("VRTX", "PVRTX")).select("path", F.col("w")[1].cast("long").alias("node"), *(number(F.col("w")[k + 2]).alias(c) for k, c in enumerate("xyz")))
    triangles = words.filter(F.col("w")[0] == "TRGL").select("path", *(F.col("w")[k + 1].cast("long").alias(f"n{k}") for k in range(3)))
    return nodes, triangles


def lines_of_points(spark: SparkSession, path: str, end: float = 999.0) -> DataFrame:
    """path, line, seq, x, y, z of point files in which a row of ``end`` values closes each line; what a short row lacks is null."""
    rows = numbered(spark, path).withColumn("w", F.split(F.trim("text"), r"\s+")).filter(F.trim("text") != "")
    p = rows.select("path", "line", *(number(F.get("w", F.lit(k))).alias(c) for k, c in enumerate("xyz")))
    stop = (F.col("x") == end) & (F.col("y") == end) & (F.col("z") == end)
    part = F.expr(f"coalesce(sum(if(x = {end} and y = {end} and z = {end}, 1, 0)) over (partition by path order by line rows between unbounded preceding and 1 preceding), 0)")
    kept = p.withColumn("part", part).filter(~F.coalesce(stop, F.lit(False)))
    seq = F.expr("row_number() over (partition by path, part order by line) - 1")
    return kept.select("path", F.col("part").alias("line"), seq.alias("seq"), "x", "y", "z")


def write_array(values: DataFrame, path: str, cell: str = "cell_id", value: str = "value", per_line: int = 10) -> None:
    """Writes an array as text, ``per_line`` values a line, in the order of cells over the files."""
    rows = values.withColumn("__line", F.floor(F.col(cell) / per_line))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(cell).alias("c"), F.col(value).cast("string").alias("v")))), lambda s: s["v"]), " ")
    rows.groupBy("__line").agg(text.alias("text")).repartitionByRange("__line").sortWithinPartitions("__line").select("text").write.text(path)

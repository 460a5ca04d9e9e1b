"""Text files with headers and sections: meshes, well specifications, fault multipliers, surveys, picks, corner points, and their writers.

A file's lines are one sorted group: what a line stands under is found by windows over
them. Words that should be numbers and aren't are null, and stay in their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoframe.sources.ascii import number, numbered


def _order() -> Window:
    return Window.partitionBy("path").orderBy("line")


def _so_far() -> Window:
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def _lines(spark: SparkSession, path: str, comment: str | None) -> DataFrame:
    """path, line, text and w (words) of the lines that aren't blank, without comments."""
    rows = numbered(spark, path)
    if comment:
        rows = rows.withColumn("text", F.regexp_replace("text", rf"\Q{comment}\E.*$", ""))
    return rows.filter(F.trim("text") != "").withColumn("w", _words(F.col("text")))


def _carried(when: Column, value: Column) -> Column:
    """``value`` of the last line that fulfils ``when``."""
    return F.last(F.when(when, value), ignorenulls=True).over(_so_far())


def zmap_meshes(spark: SparkSession, path: str) -> DataFrame:
    """path, j, i, x, y and z of ZMap+ meshes; values run down the columns, from north to south."""
    rows = numbered(spark, path).filter(~F.col("text").startswith("!")).withColumn("at", F.sum(F.col("text").startswith("@").cast("int")).over(_so_far()))
    head = rows.filter("at = 1").withColumn("nth", F.row_number().over(_order()))
    fields = F.transform(F.split("text", ","), lambda x: F.trim(x))
    null = F.coalesce(F.nullif(F.get(fields, F.lit(1)), F.lit("")), F.get(fields, F.lit(2)))
    of = lambda n, c: F.max(F.when(F.col("nth") == n, c))
    size = [of(3, F.get(fields, F.lit(k))) for k in range(6)]
    heads = head.groupBy("path").agg(number(of(2, null)).alias("null"), *(number(c).alias(k) for c, k in zip(size, ("nj", "ni", "x0", "x1", "y0", "y1"))))
    body = rows.filter("at >= 2 and not startswith(text, '@') and not startswith(text, '+')").select("path", "line", F.posexplode(F.filter(_words(F.col("text")), lambda x: x != "")).alias("p", "v"))
    cell = F.row_number().over(Window.partitionBy("path").orderBy("line", "p")) - 1
    m = body.withColumn("cell", cell).join(heads, "path")
    i, down = F.floor(F.col("cell") / F.col("nj")), F.col("cell") % F.col("nj")
    j = F.col("nj") - 1 - down
    z = number(F.col("v"))
    place = lambda n, count, a, b: F.col(a) + n * (F.col(b) - F.col(a)) / F.greatest(F.col(count) - 1, F.lit(1))
    return m.select("path", j.cast("long").alias("j"), i.cast("long").alias("i"), place(i, "ni", "x0", "x1").alias("x"), place(j, "nj", "y0", "y1").alias("y"), F.when(z != F.col("null"), z).alias("z"))


def rms_meshes(spark: SparkSession, path: str, null: float = 9999900.0) -> DataFrame:
    """path, j, i, x, y and z of RMS text meshes; values run along the rows, which may be turned about the origin (degrees)."""
    rows = numbered(spark, path).filter(F.trim("text") != "").withColumn("nth", F.row_number().over(_order())).withColumn("w", F.transform(_words(F.col("text")), number))
    of = lambda n, k: F.max(F.when(F.col("nth") == n, F.get("w", F.lit(k))))
    heads = rows.filter("nth <= 3").groupBy("path").agg(*(of(n, k).alias(name) for name, n, k in (("dx", 1, 2), ("dy", 1, 3), ("ni", 3, 0), ("turn", 3, 1), ("x0", 3, 2), ("y0", 3, 3))))
    body = rows.filter("nth > 4").select("path", "line", F.posexplode("w").alias("p", "z"))
    cell = F.row_number().over(Window.partitionBy("path").orderBy("line", "p")) - 1
    m = body.withColumn("cell", cell).join(heads, "path")
    i, j = F.col("cell") % F.col("ni"), F.floor(F.col("cell") / F.col("ni"))
    u, v, a = i * F.col("dx"), j * F.col("dy"), F.radians("turn")
    x, y = F.col("x0") + u * F.cos(a) - v * F.sin(a), F.col("y0") + u * F.sin(a) + v * F.cos(a)
    return m.select("path", j.cast("long").alias("j"), i.cast("long").alias("i"), x.alias("x"), y.alias("y"), F.when(F.col("z") != null, F.col("z")).alias("z"))


def wellspecs(spark: SparkSession, path: str, usa_dates: bool = False) -> DataFrame:
    """path, well, date (null before the first TIME), row (from 0 in its table) and values (a map by column; NA is null) of WELLSPEC tables."""
    rows = _lines(spark, path, "!").withColumn("key", F.upper(F.col("w")[0]))
    known = F.col("key").isin("WELLSPEC", "TIME", "WELLMOD")
    rows = rows.withColumns({"well": _carried(F.col("key") == "WELLSPEC", F.get("w", F.lit(1))), "date": _carried(F.col("key") == "TIME", F.get("w", F.lit(1))), "table": F.sum(F.when(known, 1).otherwise(0)).over(_so_far()), "kind": _carried(known, F.col("key"))})
    rows = rows.filter(~known & (F.col("kind") == "WELLSPEC")).withColumn("nth", F.row_number().over(Window.partitionBy("path", "table").orderBy("line")))
    heads = rows.filter("nth = 1").select("path", "table", F.transform("w", F.upper).alias("head"))
    values = F.map_from_entries(F.transform(F.arrays_zip("head", F.slice("w", F.lit(1), F.size("head")).alias("v")), lambda z: F.struct(z["head"], F.when(~F.upper(z["v"]).isin("NA", "#"), z["v"]))))
    date = F.to_date("date", "MM/dd/yyyy" if usa_dates else "dd/MM/yyyy")
    return rows.filter("nth > 1").join(heads, ["path", "table"]).select("path", "well", date.alias("date"), (F.col("nth") - 2).cast("long").alias("row"), values.alias("values"))


def fault_multipliers(spark: SparkSession, path: str) -> DataFrame:
    """path, name, grid, axis, side, i1 ... k2 (from 0) and mult of the rows of MULT tables; rows that name a plane both ways count once for each."""
    rows = _lines(spark, path, "!").withColumn("key", F.upper(F.col("w")[0]))
    start = F.col("key") == "MULT"
    rows = rows.withColumns({"face": _carried(start, F.upper(F.get("w", F.lit(1)))), "side": _carried(start, F.when(F.array_contains(F.transform("w", F.upper), "MINUS"), "MINUS").otherwise("PLUS")), "grid": F.coalesce(_carried(F.col("key") == "GRID", F.get("w", F.lit(1))), F.lit("ROOT")), "name": _carried(F.col("key") == "FNAME", F.get("w", F.lit(1)))})
    values = F.transform("w", number)
    axis = F.translate(F.regexp_extract("face", "^T([XYZIJK])F?$", 1), "XYZ", "IJK")
    ends = [(F.get("v", F.lit(n)) - 1).cast("long").alias(k) for n, k in enumerate(("i1", "i2", "j1", "j2", "k1", "k2"))]
    found = rows.filter(F.col("w")[0].rlike(r"^[-+]?[0-9]")).withColumn("v", values)
    return found.select("path", "name", "grid", axis.alias("axis"), "side", *ends, F.get("v", F.lit(6)).alias("mult"))


def surveys(spark: SparkSession, path: str, comment: str = "#", spaced: bool = False, columns: tuple[str, ...] = ("MD", "INCL", "AZIM_GN")) -> DataFrame:
    """path, station (from 0) and the named columns, in lower case, of deviation surveys or trajectories with a line of column names."""
    rows = _lines(spark, path, comment).withColumn("w", F.col("w") if spaced else F.transform(F.split("text", ","), lambda x: F.trim(x)))
    rows = rows.withColumn("nth", F.row_number().over(_order()))
    heads = rows.filter("nth = 1").select("path", F.col("w").alias("head"))
    value = lambda c: number(F.get("w", F.array_position("head", F.lit(c)).cast("int") - 1))
    return rows.filter("nth > 1").join(heads, "path").select("path", (F.col("nth") - 2).cast("long").alias("station"), *(value(c).alias(c.lower()) for c in columns))


def charisma_points(spark: SparkSession, path: str) -> DataFrame:
    """path, inline, xline, x, y, z of Charisma picks; sticks have name and stick too, other lines nulls."""
    rows = numbered(spark, path).select("path", F.regexp_replace(F.regexp_replace("text", r"(?i)(INLINE|XLINE)\s*[:-]", " "), r"\s+", " ").alias("t")).filter(F.trim("t") != "")
    w = F.split(F.trim("t"), " ")
    return rows.select("path", *(F.get(w, F.lit(k)).try_cast("long").alias(n) for k, n in enumerate(("inline", "xline"))), *(number(F.get(w, F.lit(k + 2))).alias(n) for k, n in enumerate("xyz")), F.get(w, F.lit(5)).alias("name"), F.get(w, F.lit(6)).try_cast("int").alias("stick"))


def corner_points(values: DataFrame, nj: int, ni: int) -> DataFrame:
    """cell_id, k, j, i, kp, jp, ip, x, y, z from the numbers of a corner point array (``array_values``): 24 a cell, x, y, z of its corners.

    The corners of a face go round it: in a cell's 8 the order of ip turns where jp is 1.
    """
    v = F.col("cell_id")
    cell, place = F.floor(v / 24), v % 24
    corner, axis = F.floor(place / 3), place % 3
    rows = values.select("path", cell.cast("long").alias("cell_id"), corner.cast("int").alias("corner"), axis.cast("int").alias("axis"), "value")
    points = rows.groupBy("path", "cell_id", "corner").agg(*(F.max(F.when(F.col("axis") == n, F.col("value"))).alias(c) for n, c in enumerate("xyz")))
    kp, jp = F.expr("corner div 4"), F.expr("corner % 4 div 2")
    ip = F.when(jp == 1, 1 - F.col("corner") % 2).otherwise(F.col("corner") % 2)
    c = F.col("cell_id")
    return points.select("path", "cell_id", F.floor(c / (nj * ni)).alias("k"), (F.floor(c / ni) % nj).alias("j"), (c % ni).alias("i"), kp.cast("int").alias("kp"), jp.cast("int").alias("jp"), ip.cast("int").alias("ip"), *"xyz")


def _sections(rows: DataFrame, by: str, order: str, text: Column, head: Column, tail: Column | None = None) -> DataFrame:
    """One text for each group: its head, its lines in order, and its tail."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s["t"]), "\n")
    return rows.groupBy(by).agg(lines.alias("lines"), F.first(head).alias("head"), *([F.first(tail).alias("tail")] if tail is not None else [])).select(F.concat_ws("\n", *(["head", "lines"] + (["tail"] if tail is not None else []))).alias("text"))


def write_wellspecs(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Writes ``rows(well, row, columns ...)`` as WELLSPEC tables; null is NA."""
    text = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns))
    _sections(rows, "well", "row", text, F.concat(F.lit("WELLSPEC "), F.col("well").cast("string"), F.lit("\n" + " ".join(c.upper() for c in columns)))).write.text(path)


def write_fault_multipliers(rows: DataFrame, path: str) -> None:
    """Writes ``rows(name, axis, side, i1 ... k2 from 0, mult)`` as MULT tables, one for each name, axis and side."""
    ends = [(F.col(c) + 1).cast("string") for c in ("i1", "i2", "j1", "j2", "k1", "k2")]
    rows = rows.withColumn("__by", F.concat_ws(" ", "name", "axis", "side"))
    head = F.concat(F.lit("MULT T"), F.col("axis"), F.lit(" ALL "), F.col("side"), F.lit(" MULT\nGRID ROOT\nFNAME "), F.col("name"))
    _sections(rows, "__by", "i1", F.concat_ws(" ", *ends, F.col("mult").cast("string")), head).write.text(path)


def write_lines_of_points(rows: DataFrame, path: str, end: float = 999.0) -> None:
    """Writes ``rows(line, seq, x, y, z)`` with a row of ``end`` values behind each line."""
    _sections(rows, "line", "seq", F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyz")), F.lit("").cast("string"), F.lit(" ".join([str(end)] * 3))).write.text(path)


def write_charisma_points(rows: DataFrame, path: str) -> None:
    """Writes ``rows(inline, xline, x, y, z)`` as Charisma picks."""
    rows.select(F.concat(F.lit("INLINE : "), F.col("inline").cast("string"), F.lit(" XLINE : "), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("xline", "x", "y", "z"))))).write.text(path)


def write_logs(values: DataFrame, path: str, curves: list[tuple[str, str]], null: float = -999.25) -> None:
    """Writes ``values(well, md, curve columns ...)`` as LAS text, a folder for each well; ``curves`` are names and units."""
    names = "\n".join(f"{c}.{u} :" for c, u in curves)
    head = F.lit(f"~V\nVERS. 2.0 :\nWRAP. NO :\n~W\nNULL. {null} :\n~C\nDEPT.m :\n{names}\n~A")
    text = F.concat_ws(" ", F.col("md").cast("string"), *(F.coalesce(F.col(c), F.lit(null)).cast("string") for c, _ in curves))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("md", text.alias("t")))), lambda s: s["t"]), "\n")
    values.groupBy("well").agg(F.concat_ws("\n", head, lines).alias("value")).write.partitionBy("well").text(path)


#: Keywords of relative permeability tables with their phases, and column names with what they hold.
PHASES = {"WOTABLE": "water-oil", "GOTABLE": "gas-oil", "GWTABLE": "gas-water"}
RELPERM_COLUMNS = {"SW": "sw", "SG": "sg", "KRW": "krw", "KRG": "krg", "KROW": "kro", "KROG": "kro", "KRWG": "krw", "PCWO": "pc", "PCGO": "pc", "PCGW": "pc", "PC": "pc"}


def relperm_tables(spark: SparkSession, path: str) -> DataFrame:
    """path, table (from 1), phases, row (from 0), sw, sg, krw, krg, kro and pc of relative permeability tables; what a table has no column for is null.

    A line with ``!`` is a comment altogether. Rows without a number for the saturation are left out.
    """
    rows = numbered(spark, path).filter(~F.col("text").contains("!")).filter(F.trim("text") != "").withColumn("w", _words(F.upper("text")))
    rows = rows.withColumn("keyword", F.get(F.filter("w", lambda x: x.isin(*PHASES)), F.lit(0)))
    start = F.col("keyword").isNotNull()
    rows = rows.withColumns({"table": F.sum(start.cast("int")).over(_so_far()), "kind": _carried(start, F.col("keyword"))}).filter(~start & (F.col("table") > 0))
    table = Window.partitionBy("path", "table").orderBy("line")
    rows = rows.withColumns({"nth": F.row_number().over(table), "head": F.first("w").over(table)})
    names = F.create_map(*(F.lit(x) for pair in RELPERM_COLUMNS.items() for x in pair))
    of = lambda c: number(F.get("w", F.array_position(F.transform("head", lambda h: F.element_at(names, h)), F.lit(c)).cast("int") - 1))
    rows = rows.filter("nth > 1").withColumns({c: of(c) for c in dict.fromkeys(RELPERM_COLUMNS.values())})
    # the first column of saturations decides
    known = F.when(F.array_contains("head", "SW") & (~F.array_contains("head", "SG") | (F.array_position("head", F.lit("SW")) < F.array_position("head", F.lit("SG")))), F.col("sw")).otherwise(F.col("sg"))
    phases = F.create_map(*(F.lit(x) for pair in PHASES.items() for x in pair))[F.col("kind")]
    kept = rows.filter(known.isNotNull() & ~F.isnan(known))
    return kept.select("path", F.col("table").cast("long").alias("table"), phases.alias("phases"), (F.row_number().over(table) - 1).cast("long").alias("row"), "sw", "sg", "krw", "krg", "kro", "pc")


def write_relperm_tables(rows: DataFrame, path: str, keyword: str, columns: list[str]) -> None:
    """Writes ``rows(table, row, columns ...)`` as tables under ``keyword``; null is NA. Columns go by their names in the file."""
    text = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns))
    _sections(rows, "table", "row", text, F.lit(f"{keyword}\n" + " ".join(c.upper() for c in columns))).write.mode("append").text(path)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """path, step, days (cumulative) and date (null in files without dates) of the rows of simulator summaries.

    The line that begins with NO. tells hours from days, and how dates are written.
    """
    w = _words(F.col("text"))
    rows = numbered(spark, path).withColumn("w", w).filter(F.size("w") >= 5)
    head = F.upper(F.col("w")[0]) == "NO."
    rows = rows.withColumns({"unit": _carried(head, F.upper(F.get("w", F.lit(3)))), "form": _carried(head, F.upper(F.get("w", F.lit(4))))})
    rows = rows.filter(F.col("w")[0].rlike("^[0-9]+$"))
    days = number(F.get("w", F.lit(3))) / F.when(F.col("unit") == "HRS", 24.0).otherwise(1.0)
    text = F.get("w", F.lit(4))
    date = F.when(F.col("form") == "MM/DD/YYYY", F.try_to_timestamp(text, F.lit("M/d/yyyy"))).when(F.col("form") == "DD/MM/YYYY", F.try_to_timestamp(text, F.lit("d/M/yyyy")))
    return rows.select("path", F.col("w")[0].cast("long").alias("step"), days.alias("days"), date.cast("date").alias("date"))

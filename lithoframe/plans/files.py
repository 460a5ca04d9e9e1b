"""Queries that write text files from the tables into the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoframe.operators.timeseries import from_summary
from lithoframe.plans import CELLS, NI, NJ, POINTS, cells, points, q6, query, sq6, table
from lithoframe.plans.wells import SAMPLES, _samples
from lithoframe.sources import ascii, binary, tables
from lithoframe.storage import settled, shared_folder


def _text(rows: DataFrame) -> str:
    """Writes the column text."""
    path = shared_folder(rows.sparkSession)
    rows.select("text").write.text(path)
    return path


@query(f"with {CELLS} select cell_id % 1000 as place, count(*)::bigint as n, {sq6('sum(perm)')} as perm, count(*) filter (cell_id % 7 = 0)::bigint as missing from cells group by 1")
def file_ascii_array(spark: SparkSession, d: str) -> DataFrame:
    """An array written ten values a line and read back; words that are no numbers are nulls in their places."""
    path = shared_folder(spark)
    c = cells(spark, d).select("cell_id", F.when(F.col("cell_id") % 7 == 0, "none").otherwise(F.col("perm").cast("string")).alias("value"))
    ascii.write_array(c, path)
    back = ascii.array_values(spark, path, over_files=True)
    both = back.join(cells(spark, d).select("cell_id", "perm"), "cell_id")
    value = F.when(F.col("value").isNull() & (F.col("cell_id") % 7 == 0), F.col("perm")).otherwise(F.col("value"))
    return both.groupBy((F.col("cell_id") % 1000).alias("place")).agg(F.count("*").alias("n"), q6(F.sum(value)).alias("perm"), F.count_if(F.col("value").isNull()).alias("missing"))


@query(f"with {SAMPLES} select well::bigint as well, {sq6('md')} as md, 'VAL' as curve, 'm/s' as unit, {sq6('case when event_id % 5 > 0 then value end')} as value from samples union all select well::bigint, {sq6('md')}, 'ID', 'none', {sq6('event_id::double')} from samples")
def file_las(spark: SparkSession, d: str) -> DataFrame:
    """Well logs as LAS text, missing values among them."""
    path = shared_folder(spark)
    s = _samples(spark, d).withColumns({"VAL": F.when(F.col("event_id") % 5 > 0, F.col("value")), "ID": F.col("event_id").cast("double")})
    tables.write_logs(s, path, [("VAL", "m/s"), ("ID", "none")])
    back = ascii.log_values(spark, f"{path}/*")
    well = F.regexp_extract("path", "well=([0-9]+)", 1).cast("long")
    return back.select(well.alias("well"), q6(F.col("md")).alias("md"), "curve", "unit", q6(F.col("value")).alias("value"))


@query(f"with {POINTS} select id as node, {sq6('x')} as x, {sq6('y')} as y, {sq6('z')} as z from points")
def file_tsurf_nodes(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    text = p.select(F.concat_ws(" ", F.lit("VRTX"), *(F.col(c).cast("string") for c in ("id", "x", "y", "z"))).alias("text"))
    nodes, _ = ascii.triangulated(spark, _text(text))
    return nodes.select("node", *(q6(F.col(c)).alias(c) for c in "xyz"))


@query(f"with {POINTS} select label::bigint as label, row_number() over (partition by label order by id) - 1 as seq, {sq6('x')} as x, {sq6('y')} as y, {sq6('z')} as z from points")
def file_irap_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of points, told apart by a last point that carries their label."""
    p = points(spark, d).select(F.col("label").alias("line"), F.col("id").alias("seq"), "x", "y", "z")
    marks = p.select("line").distinct().select("line", F.lit(-1).cast("long").alias("seq"), F.lit(-5000.0).alias("x"), F.col("line").cast("double").alias("y"), F.lit(0.0).alias("z"))
    path = shared_folder(spark)
    tables.write_lines_of_points(p.unionByName(marks), path)
    back = ascii.lines_of_points(spark, path)
    named = back.filter("seq = 0 and x = -5000").select("path", "line", F.col("y").cast("long").alias("label"))
    return back.filter("seq > 0").join(named, ["path", "line"]).select("label", (F.col("seq") - 1).cast("long").alias("seq"), *(q6(F.col(c)).alias(c) for c in "xyz"))


@query(f"with {POINTS} select id as inline, (id * 7 % 1000)::bigint as xline, {sq6('x')} as x, {sq6('y')} as y, {sq6('z')} as z from points")
def file_charisma(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark)
    tables.write_charisma_points(points(spark, d).withColumns({"inline": F.col("id"), "xline": F.col("id") * 7 % 1000}), path)
    return tables.charisma_points(spark, path).select("inline", "xline", *(q6(F.col(c)).alias(c) for c in "xyz"))


@query("select 'W' || o_custkey as well, count(*)::bigint as rows, sum(o_orderkey % 30)::bigint as iw, count(*) filter (o_orderkey % 3 > 0)::bigint as known, floor(sum(case when o_orderkey % 3 > 0 then o_totalprice / 1000 end) * 1e3 + 0.5) / 1e3 as kh from orders group by o_custkey")
def file_wellspec(spark: SparkSession, d: str) -> DataFrame:
    """A table of cells for each well, with missing values."""
    o = table(spark, d, "orders").select(F.concat(F.lit("W"), "o_custkey").alias("well"), F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 30).alias("iw"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") / 1000).alias("kh"))
    path = shared_folder(spark)
    tables.write_wellspecs(o, path, ["iw", "kh"])
    v = F.col("values")
    back = tables.wellspecs(spark, path).select("well", "row", v["IW"].cast("long").alias("iw"), v["KH"].cast("double").alias("kh"))
    # doubles add up in the order of the table: another order can round a half the other way
    back = back.withColumn("so_far", F.sum("kh").over(Window.partitionBy("well").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))
    return back.groupBy("well").agg(F.count("*").alias("rows"), F.sum("iw").alias("iw"), F.count("kh").alias("known"), (F.floor(F.max_by("so_far", "row") * 1e3 + 0.5) / 1e3).alias("kh"))


@query("select 'F' || l_suppkey % 7 as name, ['I', 'J', 'K'][l_linenumber % 3 + 1] as axis, case when l_partkey % 2 = 0 then 'MINUS' else 'PLUS' end as side, (l_orderkey % 50)::bigint as i1, (l_partkey % 20)::bigint as k1, count(*)::bigint as n, max(l_discount) as most from lineitem group by all")
def file_fault_multipliers(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(
        F.concat(F.lit("F"), F.col("l_suppkey") % 7).alias("name"), F.expr("array('I', 'J', 'K')[l_linenumber % 3]").alias("axis"), F.when(F.col("l_partkey") % 2 == 0, "MINUS").otherwise("PLUS").alias("side"),
        (F.col("l_orderkey") % 50).alias("i1"), (F.col("l_orderkey") % 50 + 2).alias("i2"), F.lit(0).alias("j1"), F.lit(3).alias("j2"), (F.col("l_partkey") % 20).alias("k1"), (F.col("l_partkey") % 20).alias("k2"), F.col("l_discount").alias("mult"),
    )
    path = shared_folder(spark)
    tables.write_fault_multipliers(x, path)
    return tables.fault_multipliers(spark, path).groupBy("name", "axis", "side", "i1", "k1").agg(F.count("*").alias("n"), F.max("mult").alias("most"))


def _by_layer(spark: SparkSession, rows: DataFrame, head: str) -> str:
    """Writes a file for each k: a header, then the column text in the order of nth."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda s: s["text"]), "\n")
    path = shared_folder(spark)
    rows.groupBy("k").agg(F.concat_ws("\n", F.lit(head), lines).alias("value")).write.partitionBy("k").text(path)
    return path


_MESH = f"with {CELLS}, m as (select k::bigint as k, j::bigint as j, i::bigint as i, case when cell_id % 9 > 0 then perm end as z from cells)"


def _mesh_values(spark: SparkSession, d: str, null: str) -> DataFrame:
    return cells(spark, d).select("k", "j", "i", F.when(F.col("cell_id") % 9 > 0, F.col("perm").cast("string")).otherwise(null).alias("text"))


@query(_MESH + f" select k, j, i, {sq6('1000.0 + i * 50.0')} as x, {sq6('2000.0 + j * 40.0')} as y, {sq6('z')} as z from m")
def file_zmap(spark: SparkSession, d: str) -> DataFrame:
    """A ZMap+ mesh for each layer."""
    v = _mesh_values(spark, d, "-99999.0").withColumn("nth", F.col("i") * NJ + (NJ - 1 - F.col("j")))
    head = f"! a mesh\n@mesh HEADER, GRID, 5\n15, -99999.0, , 4, 1\n{NJ}, {NI}, 1000.0, {1000.0 + 50 * (NI - 1)}, 2000.0, {2000.0 + 40 * (NJ - 1)}\n0.0, 0.0, 0.0\n@\n+ data"
    m = tables.zmap_meshes(spark, f"{_by_layer(spark, v, head)}/*")
    return m.select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("long").alias("k"), "j", "i", *(q6(F.col(c)).alias(c) for c in "xyz"))


@query(_MESH + f" select k, j, i, {sq6('1000.0 + i * 50.0 * cos(radians(30)) - j * 40.0 * sin(radians(30))')} as x, {sq6('2000.0 + i * 50.0 * sin(radians(30)) + j * 40.0 * cos(radians(30))')} as y, {sq6('z')} as z from m")
def file_rms_mesh(spark: SparkSession, d: str) -> DataFrame:
    """An RMS text mesh, turned by 30 degrees, for each layer."""
    v = _mesh_values(spark, d, "9999900.0000").withColumn("nth", F.col("j") * NI + F.col("i"))
    head = f"-996 {NJ} 50.0 40.0\n1000.0 2450.0 2000.0 2960.0\n{NI} 30.0 1000.0 2000.0\n0 0 0 0 0 0 0"
    m = tables.rms_meshes(spark, f"{_by_layer(spark, v, head)}/*")
    return m.select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("long").alias("k"), "j", "i", *(q6(F.col(c)).alias(c) for c in "xyz"))


@query(f"with {SAMPLES} select well::bigint as k, row_number() over (partition by well order by md, event_id) - 1 as station, {sq6('md')} as md, {sq6('(event_id % 40)::double')} as incl, {sq6('value')} as azim_gn from samples")
def file_survey(spark: SparkSession, d: str) -> DataFrame:
    """A deviation survey for each well."""
    s = _samples(spark, d).select(F.col("well").alias("k"), F.struct("md", "event_id").alias("nth"), F.concat_ws(",", F.col("md").cast("string"), F.col("value").cast("string"), (F.col("event_id") % 40).cast("string")).alias("text"))
    back = tables.surveys(spark, f"{_by_layer(spark, s, '# a survey' + chr(10) + 'MD,AZIM_GN,INCL')}/*")
    return back.select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("long").alias("k"), "station", *(q6(F.col(c)).alias(c) for c in ("md", "incl", "azim_gn")))


@query(f"with {CELLS} select cell_id, k::bigint as k, j::bigint as j, i::bigint as i, kp, jp, ip, {sq6('(i + ip) * 50.0')} as x, {sq6('(j + jp) * 40.0')} as y, {sq6('(k + kp) * 5.0 + ntg')} as z from cells, (select unnest([0, 1]) as kp), (select unnest([0, 1]) as jp), (select unnest([0, 1]) as ip)")
def file_corner_points(spark: SparkSession, d: str) -> DataFrame:
    """The corners of all cells, eight in a row and a cell a line, as one array of numbers."""
    c = cells(spark, d)
    parts = []
    for kp in (0, 1):
        for jp in (0, 1):
            for ip in ((0, 1) if jp == 0 else (1, 0)):
                parts += [(F.col("i") + ip) * 50.0, (F.col("j") + jp) * 40.0, (F.col("k") + kp) * 5.0 + F.col("ntg")]
    text = c.select("cell_id", F.concat_ws(" ", *(p.cast("string") for p in parts)).alias("text")).repartitionByRange("cell_id").sortWithinPartitions("cell_id")
    v = ascii.array_values(spark, _text(text), over_files=True)
    p = tables.corner_points(v, NJ, NI)
    return p.select("cell_id", "k", "j", "i", "kp", "jp", "ip", *(q6(F.col(x)).alias(x) for x in "xyz"))


@query(f"with {CELLS} select cell_id, {sq6('perm')} as perm, floor(ntg::float * 1e6 + 0.4999) / 1e6 as ntg, k::bigint as k, i::integer as i, active::tinyint as active from cells")
def file_binary_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Five properties of the cells, each a binary array of another kind, written and read back."""
    c = cells(spark, d)
    kinds = {"perm": ".db", "ntg": ".fb", "k": ".lb", "i": ".ib", "active": ".bb"}
    out = None
    for name, kind in kinds.items():
        folder = shared_folder(spark)
        settled(binary.write_array(c.select("cell_id", F.col(name).cast("double" if kind in (".db", ".fb") else "long").alias("value")), folder, kind))
        back = binary.read_array(spark, folder, kind, over_files=True).select("cell_id", F.col("value").alias(name))
        # what tasks read from few file names looks small to the optimizer: a merge, lest an array be sent to all tasks
        out = back if out is None else out.join(back.hint("merge"), "cell_id")
    return out.select("cell_id", q6(F.col("perm")).alias("perm"), q6(F.col("ntg").cast("double")).alias("ntg"), "k", "i", "active")


_RELPERM = "select o_custkey as code, o_custkey % 3 as kind, row_number() over (partition by o_custkey order by o_orderkey) - 1 as row, (o_orderkey % 100) / 100.0::double as s, o_totalprice / 1e6::double as k1, case when o_orderkey % 7 > 0 then 1 - (o_orderkey % 64) / 64.0::double end as k2 from orders"


@query(
    f"""with t as ({_RELPERM}) select code::bigint as code, case kind when 0 then 'water-oil' when 1 then 'gas-oil' else 'gas-water' end as phases, row, {sq6('case when kind = 0 then s end')} as sw, {sq6('case when kind > 0 then s end')} as sg,
    {sq6('case kind when 0 then k1 when 2 then k2 end')} as krw, {sq6('case when kind > 0 then k1 end')} as krg, {sq6('case when kind < 2 then k2 end')} as kro from t"""
)
def file_relperm(spark: SparkSession, d: str) -> DataFrame:
    """A relative permeability table for each customer, in three kinds, written and read back."""
    path, key = shared_folder(spark), F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("table"), key.alias("row"), ((key % 100) / 100.0).alias("s"), (F.col("o_totalprice") / 1e6).alias("k1"), F.when(key % 7 > 0, 1 - (key % 64) / 64.0).alias("k2"), F.col("o_custkey").alias("pc"))
    for kind, (keyword, names) in enumerate((("WOTABLE", ("sw", "krw", "krow", "pcwo")), ("GOTABLE", ("sg", "krg", "krog", "pcgo")), ("GWTABLE", ("sg", "krg", "krwg", "pcgw")))):
        some = o.filter(F.col("table") % 3 == kind).select("table", "row", *(F.col(c).alias(n) for c, n in zip(("s", "k1", "k2", "pc"), names)))
        tables.write_relperm_tables(some, path, keyword, list(names))
    back = tables.relperm_tables(spark, path)
    return back.select(F.col("pc").cast("long").alias("code"), "phases", "row", *(q6(F.col(c)).alias(c) for c in ("sw", "sg", "krw", "krg", "kro")))


@query(
    """with e as (select user_id as well, row_number() over (partition by user_id order by ts, event_id) as nth, event_id from events),
    s as (select well, 2 * nth + event_id % 2 as step, 10 * nth + (event_id % 50) / 4.0::double as days from e),
    g as (select *, max(days) over (partition by well order by step) as grown, coalesce(lag(step) over (partition by well order by step), 0) as before from s),
    w as (select *, coalesce(lag(grown) over (partition by well order by step), 0) as was from g),
    f as (select well, unnest(range(before + 1, step + 1)) as n, step, grown, was from w),
    a as (select well, n as step, case when n = step then grown else was end as days from f union all select distinct well, 0, 0.0::double from s)
    select well::bigint as well, step::bigint as step, days, strftime(date '2000-01-01' + to_hours((days * 24)::bigint), '%Y-%m-%d %H') as at from a"""
)
def file_summary(spark: SparkSession, d: str) -> DataFrame:
    """Time series of wells from summaries that leave out steps and go back in time."""
    path = shared_folder(spark)
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").select(F.col("user_id").alias("well"), nth.alias("nth"), "event_id")
    s = e.select("well", (2 * F.col("nth") + F.col("event_id") % 2).alias("step"), (10 * F.col("nth") + (F.col("event_id") % 50) / 4.0).alias("days"))
    date = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.floor("days").cast("int")), "d/MM/yyyy")
    line = F.concat_ws(" ", F.col("step").cast("string"), F.lit("0 1"), F.col("days").cast("string"), date, F.lit("0.0"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", line.alias("t")))), lambda x: x["t"]), "\n")
    s.groupBy("well").agg(F.concat_ws("\n", F.lit("STEP T.S. NWT TIME DATE OIL\nNO. REP. ITN DAYS DD/MM/YYYY MSTB"), lines).alias("value")).write.partitionBy("well").text(path)
    series = from_summary(tables.summaries(spark, f"{path}/*"))
    return series.select(F.regexp_extract("path", "well=([0-9]+)", 1).cast("long").alias("well"), "step", "days", F.date_format("timestamp", "yyyy-MM-dd HH").alias("at"))

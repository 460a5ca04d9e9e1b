"""Connection-set queries: lines of an order connect its cell with that of their part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators import connections as c
from lithoframe.operators import grid as g
from lithoframe.plans import CELLS, NI, NJ, cells, query, sdsum, sq6, q6, table

CONNECTIONS = "conn as (select l_orderkey as cell0, l_partkey as cell1, l_suppkey % 5 as feature, l_linenumber % 6 as face0, (l_linenumber + 1) % 6 as face1, l_quantity as q from lineitem)"


def _connections(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select(F.col("l_orderkey").alias("cell0"), F.col("l_partkey").alias("cell1"), (F.col("l_suppkey") % 5).alias("feature"), (F.col("l_linenumber") % 6).alias("face0"), ((F.col("l_linenumber") + 1) % 6).alias("face1"), F.col("l_quantity").alias("q"))


@query(f"with {CONNECTIONS} select feature, count(*)::bigint as n from conn where floor(cell0 / {NI * NJ}) between 1 and 6 and floor(cell1 / {NI * NJ}) between 0 and 6 and floor(cell1 / {NI * NJ}) >= 1 group by feature")
def connections_by_layers(spark: SparkSession, d: str) -> DataFrame:
    return c.by_layers(_connections(spark, d), 1, 6, NI * NJ).groupBy("feature").agg(F.count("*").alias("n"))


@query(f"with {CONNECTIONS}, m as (select o_orderkey as cell from orders where o_orderstatus = 'F') select feature, count(*)::bigint as n from conn where cell0 in (select cell from m) or cell1 in (select cell from m) group by feature")
def connections_by_cells(spark: SparkSession, d: str) -> DataFrame:
    mask = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("cell_id"))
    return c.by_cells(_connections(spark, d), mask, both=False).groupBy("feature").agg(F.count("*").alias("n"))


_THICK = "case when cell_id % 13 = 0 then 'nan'::double when cell_id % 17 = 0 then 0.15::double when cell_id % 19 > 0 then poro end"


@query(
    f"""with {CELLS}, t as (select *, {_THICK} as dz from cells), r as (select cell_id, k, active, lead(cell_id) over w as cell1, lead(k) over w as k1, lead(active) over w as active1 from t where dz > 0.15 and not isnan(dz) window w as (partition by j, i order by k))
    select cell_id as cell0, cell1, k1::bigint - k::bigint - 1 as skipped from r where k1 > k + 1 and active and active1"""
)
def connections_pinch_out(spark: SparkSession, d: str) -> DataFrame:
    """Across cells without thickness: too thin, as thin as the tolerance, NaN or null; inactive cells have no connection."""
    n = F.col("cell_id")
    dz = F.when(n % 13 == 0, float("nan")).when(n % 17 == 0, 0.15).when(n % 19 > 0, F.col("poro"))
    return c.pinch_outs(cells(spark, d).withColumn("pinched", g.pinched_out(dz, 0.15)), "pinched", active="active")


@query(
    f"""with {CELLS}, t as (select *, k * 10.0 + poro as top, k * 10.0 + 10.0 - case when cell_id % 3 > 0 then 0.0 when cell_id % 5 = 0 then 'nan'::double else 0.2 end as base from cells),
    n as (select *, lead(cell_id) over w as cell1, lead(k) over w as k1, lead(top) over w as top1, lead(active) over w as active1 from t window w as (partition by j, i order by k))
    select cell_id as cell0, cell1 from n where k % 2 = 1 and k1 = k + 1 and not isnan(base) and top1 - base < 0.2 and active and active1"""
)
def connections_k_gap(spark: SparkSession, d: str) -> DataFrame:
    """Across gaps between layers (one below every second layer) where they have no thickness."""
    n = F.col("cell_id")
    x = cells(spark, d).withColumns({"top": F.col("k") * 10.0 + F.col("poro"), "base": F.col("k") * 10.0 + 10.0 - F.when(n % 3 > 0, 0.0).when(n % 5 == 0, float("nan")).otherwise(0.2), "gap": F.col("k") % 2 == 1})
    return c.gap_connections(x, "gap", "base", "top", active="active", tolerance=0.2)


@query("select l_partkey as cell_id, l_linenumber % 3 as axis, min(l_discount) as least, max(l_discount) as most, count(*)::bigint as sets from lineitem group by all")
def connections_multiplier_merge(spark: SparkSession, d: str) -> DataFrame:
    """Multipliers of many sets on the same faces: least and greatest."""
    f = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cell_id"), (F.col("l_linenumber") % 3).alias("axis"), F.col("l_discount").alias("multiplier"))
    low = c.merged_multipliers(f, "min").withColumnRenamed("multiplier", "least")
    high = c.merged_multipliers(f, "max").withColumnRenamed("multiplier", "most").drop("sets")
    return low.join(high, ["cell_id", "axis"])


@query("select l_orderkey as cell_id, l_linenumber % 3 as axis, floor(product(1 - l_discount) * 1e6 + 0.4999) / 1e6 as multiplier, count(*)::bigint as sets from lineitem group by all")
def connections_multiplier_product(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), (F.col("l_linenumber") % 3).alias("axis"), (1 - F.col("l_discount")).alias("multiplier"))
    return c.merged_multipliers(f, "product").withColumn("multiplier", q6(F.col("multiplier")))


@query(f"with {CONNECTIONS} select least(cell0, cell1) as cell0, greatest(cell0, cell1) as cell1, min(feature) as feature from conn group by 1, 2")
def connections_distinct(spark: SparkSession, d: str) -> DataFrame:
    return c.distinct_faces(_connections(spark, d))


@query("with a as (select l_orderkey as cell0, l_partkey as cell1, 'fault ' || l_suppkey % 4 as name from lineitem where l_linenumber % 2 = 1), b as (select l_orderkey as cell0, l_partkey as cell1, 'fault ' || l_suppkey % 6 as name from lineitem where l_linenumber % 2 = 0), u as (select * from a union all select * from b) select name, (dense_rank() over (order by name) - 1)::bigint as feature, n from (select name, count(*)::bigint as n from u group by name)")
def connections_append(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")

    def part(odd: int, features: int) -> DataFrame:
        return x.filter(F.col("l_linenumber") % 2 == odd).select(F.col("l_orderkey").alias("cell0"), F.col("l_partkey").alias("cell1"), F.concat(F.lit("fault "), F.col("l_suppkey") % features).alias("name"))

    return c.appended(part(1, 4), part(0, 6)).groupBy("name", "feature").agg(F.count("*").alias("n"))


@query(f"with {CONNECTIONS}, s as (select o_orderkey as cell, o_custkey % 6 as face, min(o_custkey % 9) as found from orders where o_orderstatus = 'P' group by 1, 2), j as (select coalesce(a.found, b.found) as feature from conn left join s a on cell0 = a.cell and face0 = a.face left join s b on cell1 = b.cell and face1 = b.face) select feature, count(*)::bigint as n from j group by feature")
def connections_inherit(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("cell"), (F.col("o_custkey") % 6).alias("face"), (F.col("o_custkey") % 9).alias("feature"))
    return c.inherited(_connections(spark, d).drop("feature"), s).groupBy("feature").agg(F.count("*").alias("n"))


@query(
    f"""with {CONNECTIONS}, h as (select o_orderkey as cell, o_custkey % 6 as face, o_totalprice / 1e5 as t from orders),
    j as (select feature, a.t as t0, b.t as t1, q / 50.0 as a0, 0.5 as a1 from conn left join h a on cell0 = a.cell and face0 = a.face left join h b on cell1 = b.cell and face1 = b.face),
    r as (select feature, case when coalesce(t0, 0) < 1e-5 or coalesce(t1, 0) < 1e-5 or coalesce(a0, 0) < 1e-4 then 0.0 else 1.0 / (1.0 / (t0 * a0) + 1.0 / (t1 * a1)) end as t from j)
    select feature, count(*)::bigint as n, {sdsum('t')} as t from r group by feature"""
)
def connections_transmissibility(spark: SparkSession, d: str) -> DataFrame:
    from lithoframe.plans import dsum

    h = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), (F.col("o_custkey") % 6).alias("face"), (F.col("o_totalprice") / 1e5).alias("t"))
    x = _connections(spark, d).withColumns({"area0": F.col("q") / 50.0, "area1": F.lit(0.5)})
    return c.connection_transmissibility(x, h).groupBy("feature").agg(F.count("*").alias("n"), dsum(F.col("t")).alias("t"))


@query(f"with {CELLS} select j::bigint as j, i::bigint as i, {sq6('avg(perm)')} as mean_value, min(perm) as least, max(perm) as most, count(perm)::bigint as faces from cells group by j, i")
def connections_column_summary(spark: SparkSession, d: str) -> DataFrame:
    return c.column_summary(cells(spark, d), "perm").withColumn("mean_value", q6(F.col("mean_value")))


@query(f"with {CELLS}, f as (select cell_id, perm > 470 as face, j, i, k from cells), s as (select cell_id, coalesce(max(face::int) over (partition by j, i order by k rows between unbounded preceding and 1 preceding), 0) as above, coalesce(max(face::int) over (partition by j, i order by k rows between current row and unbounded following), 0) as below from f) select cell_id, (below + 2 * above)::integer as shadow from s")
def connections_shadow(spark: SparkSession, d: str) -> DataFrame:
    x = cells(spark, d).withColumn("face", F.col("perm") > 470)
    return c.shadow(x, "face").select("cell_id", "shadow")


@query(
    """with recursive n as (select c_custkey as id from customer), e as (select a.id as a, b.id as b from n a join n b on b.id = a.id // 25 * 25 + (a.id * 7 + 3) % 25),
    b as (select a, b from e union select b, a from e), r as (select id, id as part from n union select r.id, b.b from r join b on r.part = b.a)
    select id, min(part) as part from r group by id"""
)
def grid_connected_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a graph of faces (an edge from every row): what a fault separates, or what a flood fill would reach."""
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    e = n.select(F.col("id").alias("a"), (F.expr("id div 25 * 25") + (F.col("id") * 7 + 3) % 25).alias("b")).join(n.withColumnRenamed("id", "b"), "b", "left_semi")
    return c.labelled(e, n)

"""Scaling queries: an order is a coarse cell, its lines are the fine ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.functions.text import prime_factors
from lithoframe.operators import scaling as s
from lithoframe.plans import CELLS, cells, davg, dsum, q6, query, sdsum, sq6, table


@query(f"select l_orderkey as cell_id, {sdsum('l_quantity')} as rock_volume, count(*)::bigint as fine from lineitem group by l_orderkey")
def upscale_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(dsum(F.col("l_quantity")).alias("rock_volume"), F.count("*").alias("fine"))


_NAN = "'nan'::double"
_PORO = f"case when l_linenumber = 2 then {_NAN} when l_linenumber <> 3 then l_tax end"
_WEIGHT = f"case when l_suppkey % 7 = 0 then {_NAN} when l_suppkey % 7 <> 1 then l_quantity end"


def _mean(value: str, weight: str) -> str:
    """As nansum over nansum; null and NaN are alike."""
    return sq6(f"coalesce(sum({value} * {weight}) filter (not isnan({value} * {weight})), 0) / nullif(sum({weight}) filter (not isnan({weight})), 0)")


@query(f"with f as (select l_orderkey as cell_id, {_PORO} as p, {_WEIGHT} as w, 1 - l_discount as n from lineitem) select cell_id, {_mean('p', 'w')} as poro, {_mean('n', 'w')} as ntg, {_mean('n', 'w')} as large, {_mean('n', 'w')} as small from f group by cell_id")
def upscale_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means of values and weights of which some are null or NaN, some very large."""
    x, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    p = F.when(n == 2, float("nan")).when(n != 3, F.col("l_tax"))
    w = F.when(F.col("l_suppkey") % 7 == 0, float("nan")).when(F.col("l_suppkey") % 7 != 1, F.col("l_quantity"))
    ntg = 1 - F.col("l_discount")
    means = {"poro": s.weighted_mean(p, w), "ntg": s.weighted_mean(ntg, w), "large": s.weighted_mean(ntg * 1e30, w) * 1e-30, "small": s.weighted_mean(ntg * 1e-15, w) * 1e15}
    return x.groupBy(F.col("l_orderkey").alias("cell_id")).agg(*(q6(m).alias(k) for k, m in means.items()))


@query(
    f"""with f as (select l_orderkey as cell_id, l_quantity as rv, 1 - l_discount as ntg, 0.1 + l_tax as poro, l_extendedprice / 1e5 as sw, l_extendedprice / 100.0 as perm from lineitem)
    select cell_id, {sdsum('rv')} as rv, {_mean('ntg', 'rv')} as ntg, {_mean('poro', '(rv * ntg)')} as poro, {_mean('sw', '(rv * ntg * poro)')} as sw, {_mean('perm', '(rv * ntg)')} as perm from f group by cell_id"""
)
def upscale_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Rock volume summed; net to gross weighed by it, porosity and permeability by net volume, saturation by pore volume, in one pass."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_quantity").alias("rv"), (1 - F.col("l_discount")).alias("ntg"), (0.1 + F.col("l_tax")).alias("poro"), (F.col("l_extendedprice") / 1e5).alias("sw"), (F.col("l_extendedprice") / 100.0).alias("perm"))
    rv, net = F.col("rv"), F.col("rv") * F.col("ntg")
    pore = net * F.col("poro")
    return x.groupBy("cell_id").agg(dsum(rv).alias("rv"), *(q6(s.weighted_mean(F.col(c), w)).alias(c) for c, w in (("ntg", rv), ("poro", net), ("sw", pore), ("perm", net))))


@query("select l_orderkey as cell_id, (min({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'v': l_quantity})).v as sample from lineitem group by l_orderkey")
def upscale_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(s.first_sample("l_quantity", "l_linenumber", "l_partkey", "l_suppkey").alias("sample"))


@query(
    f"""with {CELLS} select cast(floor(k / 2.0) as bigint) as k, cast(floor(j / 5.0) as bigint) as j, cast(floor(i / 6.0) as bigint) as i, {_mean('perm', 'ntg')} as perm,
        {sdsum('5.0 + ntg')} / (5 * 6) as dz, count(*)::bigint as fine from cells group by 1, 2, 3"""
)
def upscale_box(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of 2 by 5 by 6 cells: permeability weighed by net to gross, lengths summed along k and averaged over the rest."""
    c = cells(spark, d)
    by = [s.coarse_index(F.col(a), r).alias(a) for a, r in (("k", 2), ("j", 5), ("i", 6))]
    return c.groupBy(*by).agg(q6(s.weighted_mean(F.col("perm"), F.col("ntg"))).alias("perm"), (dsum(5.0 + F.col("ntg")) / (5 * 6)).alias("dz"), F.count("*").alias("fine"))


@query(f"with {CELLS} select k * 2 + a as fk, j * 2 + b as fj, i * 3 + e as fi, cell_id, perm, 50.0 / 3 as di from cells, range(2) t(a), range(2) u(b), range(3) v(e)")
def downscale_refine(spark: SparkSession, d: str) -> DataFrame:
    """Every coarse cell's value on its 2 by 2 by 3 fine cells, lengths in proportion."""
    return s.refined(cells(spark, d), {"k": 2, "j": 2, "i": 3}).select("fk", "fj", "fi", "cell_id", "perm", (F.lit(50.0) / 3).alias("di"))


@query(f"select l_orderkey as cell_id, l_linenumber, l_quantity / 2.0::double as half, {sq6('o_totalprice * l_quantity')} as share from lineitem join orders on l_orderkey = o_orderkey")
def downscale_broadcast(spark: SparkSession, d: str) -> DataFrame:
    """The value of a coarse cell brought to its fine cells by an equi-join."""
    x, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return x.join(o, x.l_orderkey == o.o_orderkey).select(F.col("l_orderkey").alias("cell_id"), "l_linenumber", (F.col("l_quantity") / 2.0).alias("half"), q6(F.col("o_totalprice") * F.col("l_quantity")).alias("share"))


@query("select l_orderkey as cell_id, list(coalesce(q, -1.0) order by r) as realizations from (select c.l_orderkey, r, max(l_quantity) as q from (select distinct l_orderkey from lineitem) c cross join (select unnest(range(1, (select max(l_linenumber) + 1 from lineitem)::bigint)) as r) left join lineitem x on x.l_orderkey = c.l_orderkey and x.l_linenumber = r group by 1, 2) group by 1")
def stack_realizations(spark: SparkSession, d: str) -> DataFrame:
    """All realizations side by side, as many as there are."""
    x = table(spark, d, "lineitem").withColumn("r", F.col("l_linenumber") - 1)
    count = (x.agg(F.max("r")).first()[0] or 0) + 1
    return s.stacked(x, "l_orderkey", "r", "l_quantity", count, -1.0).select(F.col("l_orderkey").alias("cell_id"), F.col("values").alias("realizations"))


@query(f"select l_linenumber as realization, {sdsum('l_quantity')} / count(*) as mean_value, min(l_quantity) as least, max(l_quantity) as most, count(*)::bigint as n from lineitem group by l_linenumber")
def ensemble_statistics(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.groupBy(F.col("l_linenumber").alias("realization")).agg(davg(F.col("l_quantity")).alias("mean_value"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.count("*").alias("n"))


@query(
    f"""with {CELLS}, z as (select zone, j, i, min(k) as k0, max(k) as k1, {sdsum('5.0 + ntg')} as thickness, bool_and(not active) as none_active, bool_or(not active) as some_inactive from cells group by zone, j, i)
    select zone, count(*)::bigint as columns, sum(k1 - k0 + 1)::bigint as layers, {sdsum('thickness')} as thickness, count(*) filter (none_active)::bigint as inactive_loose, count(*) filter (some_inactive)::bigint as inactive_strict from z group by zone"""
)
def zonal_grid(spark: SparkSession, d: str) -> DataFrame:
    """One layer for each zone: thickness, and inactive columns in the loose and the strict sense."""
    c = cells(spark, d)
    z = c.groupBy("zone", "j", "i").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), dsum(5.0 + F.col("ntg")).alias("thickness"), F.bool_and(~F.col("active")).alias("a"), F.bool_or(~F.col("active")).alias("b"))
    return z.groupBy("zone").agg(F.count("*").alias("columns"), F.sum(F.col("k1") - F.col("k0") + 1).alias("layers"), dsum(F.col("thickness")).alias("thickness"), F.count_if("a").alias("inactive_loose"), F.count_if("b").alias("inactive_strict"))


@query(
    """with n as (select distinct p_size from part), p as (select p from range(2, (select max(p_size) + 1 from part)) r(p) where not exists (select 1 from range(2, p) q(d) where p % d = 0)),
    f as (select p_size, string_agg(p, ' ' order by p) as primes from n, p, range(1, 32) t(e) where p_size % pow(p, e) = 0 group by p_size)
    select p_partkey, p_size, coalesce(primes, '') as primes from part left join f using (p_size)"""
)
def math_prime_factors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_size", F.array_join(prime_factors(F.col("p_size")), " ").alias("primes"))

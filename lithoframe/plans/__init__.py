"""Queries that bind operators to the driver's tables, each with its SQL counterpart.

Orders are the cells of a grid (o_orderkey is the cell id), lineitem their fine cells,
events are samples of wells (user_id) in time and depth, part and nation the catalogue,
embeddings points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NI, NJ = 30, 25


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q6(x: Column) -> Column:
    """Rounded to six decimals, by the same arithmetic in either engine; a tie, which either may miss by a bit, isn't where it rounds."""
    return F.floor(x * 1e6 + 0.4999).cast("double") / 1e6


def dsum(x: Column) -> Column:
    """A sum that doesn't depend on the order of its terms."""
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def davg(x: Column) -> Column:
    return dsum(x) / F.count(x)


def sq6(x: str) -> str:
    return f"(floor(({x}) * 1e6::double + 0.4999) / 1e6::double)"


def sdsum(x: str) -> str:
    return f"cast(sum(cast({x} as decimal(38,9))) as double)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the grid with k, j, i and properties."""
    from lithoframe.functions.index import denatural

    o = table(spark, sf_dir, "orders")
    o = o.select(
        F.col("o_orderkey").alias("cell_id"),
        (F.col("o_totalprice") / 1000.0).alias("perm"),
        (0.5 + (F.col("o_custkey") % 50) / 100.0).alias("ntg"),
        (0.1 + (F.col("o_orderkey") % 20) / 100.0).alias("poro"),
        (F.col("o_orderstatus") != "F").alias("active"),
        F.col("o_orderpriority").alias("zone"),
    )
    return denatural(o, NJ, NI)


CELLS = f"""cells as (
    select o_orderkey as cell_id, cast(floor(o_orderkey / {NI * NJ}) as bigint) as k, cast(floor(o_orderkey / {NI}) as bigint) % {NJ} as j, o_orderkey % {NI} as i,
           o_totalprice / 1000.0::double as perm, 0.5::double + (o_custkey % 50) / 100.0::double as ntg, 0.1::double + (o_orderkey % 20) / 100.0::double as poro,
           o_orderstatus <> 'F' as active, o_orderpriority as zone from orders)"""

#: Points of embeddings: the first three components.
POINTS = "points as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, label from embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")), "label")

"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, whose oversized buckets split on the next bit.

A row's bit string is 60 bits of the MD5 of its doc_id, then 60 bits of the MD5 of its
text. Bytes are summed once for each cell of ``depth`` leading bits; a bucket is a
shorter prefix, and a cell's shard is its shortest prefix whose bytes fit the limit.
Only rows of cells that are still too large are summed again, for more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.storage import settled

SHARD_BYTES = 1 << 20
#: Cells of the directory that are sent to all tasks; a larger directory is joined by a shuffle.
SENT_ROWS = 200_000
_WIDTH = 60
_MOST = 2 * _WIDTH


def _sixty(hexed: Column) -> Column:
    return F.lpad(F.conv(F.substring(hexed, 1, _WIDTH // 4), 16, 2), _WIDTH, "0")


def hash_bits(doc_id: Column, text: Column) -> Column:
    """120 bits as a string of 0 and 1; nulls hash like the empty string."""
    first = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    second = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    return F.concat(_sixty(first), _sixty(second))


def _sized(table: DataFrame) -> DataFrame:
    """``table``, to be sent to all tasks if it has at most ``SENT_ROWS`` rows (it is counted)."""
    table = settled(table)
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def _leaves(cells: DataFrame, start: int, depth: int, limit: int) -> DataFrame:
    """cell, shard and shard_bytes (null where no prefix of ``start`` to ``depth`` bits fits)."""
    sizes = (
        cells.select(F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("d"), "cell", "bytes")
        .groupBy(F.expr("substring(cell, 1, d)").alias("prefix"))
        .agg(F.sum("bytes").alias("size"))
    )
    fits = cells.select("cell", F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("d")).withColumn("prefix", F.expr("substring(cell, 1, d)"))
    best = fits.join(sizes.filter(F.col("size") <= limit), "prefix").groupBy("cell").agg(F.min_by(F.struct("prefix", "size"), "d").alias("leaf"))
    return cells.select("cell").join(best, "cell", "left").select("cell", F.col("leaf.prefix").alias("shard"), F.col("leaf.size").alias("shard_bytes"))


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with shard (its bit prefix, empty if one shard holds all), bytes (of the text) and shard_bytes.

    Every shard holds at most ``limit`` bytes, but for one that no further bit can split:
    a single row over the limit, or rows equal in doc_id and text; shard_bytes shows it.
    A null text has no bytes. Other columns stay; columns named like the results are
    replaced; an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c not in ("shard", "bytes", "shard_bytes")]
    keyed = docs.select(*rest).withColumns({"__bits": hash_bits(F.col("doc_id"), F.col("text")), "bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    start, depth = 0, min(_MOST, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3)
    done, open_rows = None, keyed
    while True:
        # the directory: a few cells for each shard
        cells = settled(open_rows.groupBy(F.substring("__bits", 1, depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), (F.min("__bits") == F.max("__bits")).alias("one")))
        leaves = _leaves(cells, start, depth, limit)
        # rows with all bits in common can't be split, however many are looked at
        alone = cells.filter((F.col("bytes") > limit) & F.col("one")).select("cell", F.col("bytes").alias("alone"))
        leaves = leaves.join(alone, "cell", "left").select(
            "cell", F.coalesce("shard", F.when(F.col("alone").isNotNull(), F.col("cell"))).alias("shard"), F.coalesce("shard_bytes", "alone").alias("shard_bytes")
        )
        placed = open_rows.withColumn("__cell", F.substring("__bits", 1, depth)).join(_sized(leaves.withColumnRenamed("cell", "__cell")), "__cell").drop("__cell")
        still = not cells.filter((F.col("bytes") > limit) & ~F.col("one")).isEmpty()
        part = (placed.filter("shard is not null") if still else placed).drop("__bits")
        done = part if done is None else done.unionByName(part)
        if not still:
            return done.select(*rest, "shard", "bytes", "shard_bytes")
        open_rows = settled(placed.filter("shard is null").drop("shard", "shard_bytes"))
        start, depth = depth + 1, min(_MOST, depth + 8)


#: The same for whole tables whose rows all fit, to a depth of 24 bits.
ORACLE_SQL = f"""
with keyed as (
    select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as bytes,
           lpad(bin(('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint), 60, '0') as bits
    from documents),
cells as (select substr(bits, 1, 24) as cell, sum(bytes) as bytes from keyed group by 1),
levels as (select cell, bytes, substr(cell, 1, d::int) as prefix, d from cells, range(0, 25) t(d)),
sizes as (select prefix, d, sum(bytes) as size from levels group by 1, 2),
leaves as (
    select l.cell, min_by(s.prefix, s.d) as shard, min_by(s.size, s.d) as shard_bytes
    from levels l join sizes s on l.prefix = s.prefix and l.d = s.d
    where s.size <= {SHARD_BYTES} group by 1)
select k.doc_id, l.shard, k.bytes, l.shard_bytes::bigint as shard_bytes
from keyed k join leaves l on substr(k.bits, 1, 24) = l.cell
"""

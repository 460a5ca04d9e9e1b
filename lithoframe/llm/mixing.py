"""Mixing sources to target weights by Pfair scheduling.

Rows of a source go, in hash order, into blocks. Block k of a source of weight w (k from
1) may not run before slot floor((k - 1) / w) and must run before slot ceil(k / w), with
the exact rational weight; each slot takes the released block with the earliest
deadline. So after any number of slots every source that still has rows is within one
block of its share. A source that runs out leaves its slots to the others, as long as
their windows allow, or empty.

A block has ``BLOCK`` rows and every source a lane of its own, however large the input is.
A caller may set ``LANES`` and ``BLOCKS`` to have fewer, coarser ones: then sources that
``weights`` doesn't name and with less than one in ``LANES`` of all rows share ``SHARED``
lanes by hash, each with the weight of its sources, and beyond ``BLOCKS`` blocks the
blocks grow.

The schedule is computed in slices of time (``schedule``). In a slice of n slots the jobs
that end in it are the n most urgent of those that its own releases alone would end and
those that earlier slices hand on. (Of jobs released within a slice, one that must wait
for the next when they are alone must do so with others beside it; jobs handed on can
take any of its slots.) So what slices hand on follows from counts, and all else is
done slice by slice and range of deadlines by range of deadlines, in tasks of their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.storage import settled

BLOCK = 16
#: None: blocks never grow, and no lanes are shared.
BLOCKS: int | None = None
LANES: int | None = None
SHARED = 256
#: Slots of a slice, at least, and blocks whose windows are computed in one go; the schedule depends on neither.
SLICE = 256
CHUNK = 4096
#: Hash ranges in which the rows of a lane are counted.
RANGES = 4096
#: Lanes and blocks that are sent to all tasks; larger tables are shuffled.
SENT_ROWS = 100_000
_REST = "\x00others/"


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The same proportions, exactly, in whole numbers."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = max((x.denominator for x in exact.values()), default=1)
    return {s: int(x * scale) for s, x in exact.items()}


def pfair(weights: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """Lane, block (from 0) and slot (from 0) of every block, in order of slots: earliest deadline first.

    Ties go to the heavier lane, then by name.
    """
    total = sum(weights.values())

    def job(s: str, k: int) -> tuple:
        return (k - 1) * total // weights[s], (-(-k * total // weights[s]), -weights[s], s, k)

    waiting, ready, t = [job(s, 1) for s in weights if blocks[s]], [], 0
    heapq.heapify(waiting)
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1])
        _, _, s, k = heapq.heappop(ready)
        yield s, k - 1, t
        if k < blocks[s]:
            heapq.heappush(waiting, job(s, k + 1))
        t += 1


def tempered(rows: Column, power: float = 0.5) -> Column:
    """A weight in proportion to a power of a source's rows."""
    return F.pow(rows.cast("double"), F.lit(power))


def _name(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(""))


def lanes(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """name and lane of the sources with lanes of their own, and lane, weight and rows of all lanes.

    Without ``weights`` a source's weight is ``tempered``. Sources that ``weights`` doesn't
    name, or names with no positive weight, share the mean of the weights by their rows.
    """
    counted = settled(docs.groupBy(_name(source).alias("name")).agg(F.count("*").alias("rows")))
    spark = docs.sparkSession
    given = {str(s): float(w) for s, w in (weights or {}).items() if w > 0}
    named = spark.createDataFrame(list(given.items()), "name string, given double")
    mean = sum(given.values()) / len(given) if given else 1.0
    # the table of given weights comes from the caller and is as small as that
    counted = counted.join(F.broadcast(named), "name", "left")
    if weights is None:
        weight = tempered(F.col("rows"))
    else:
        rest = counted.filter("given is null").agg(F.sum("rows")).first()[0] or 1
        weight = F.coalesce("given", F.lit(mean) * F.col("rows") / F.lit(float(rest)))
    if not LANES:
        found = settled(counted.select(F.col("name").alias("lane"), weight.alias("weight"), "rows"))
        return found.select(F.col("lane").alias("name"), "lane"), found
    total = counted.agg(F.sum("rows")).first()[0] or 0
    own = F.col("given").isNotNull() | (F.col("rows") * LANES >= total)
    shared = F.concat(F.lit(_REST), F.pmod(F.xxhash64("name"), F.lit(SHARED)).cast("string"))
    counted = counted.select("name", "rows", weight.alias("weight"), own.alias("own"), F.when(own, F.col("name")).otherwise(shared).alias("lane"))
    # shared lanes add up in decimals, whose sum doesn't depend on the order
    weight = F.when(F.bool_and("own"), F.max("weight")).otherwise(F.sum(F.col("weight").cast("decimal(38,12)")).cast("double"))
    found = settled(counted.groupBy("lane").agg(weight.alias("weight"), F.sum("rows").alias("rows")))
    return settled(counted.filter("own").select("name", "lane")), found


_JOB = "lane string, block long, weight double, release long, due long, late string"
_LAST = (1 << 63) - 1


def _total(found: DataFrame) -> Fraction:
    """The exact sum of the weights; each part of ``found`` sends its own sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sum((Fraction(w) for batch in batches for w in batch.column(0).to_pylist()), Fraction(0))
        yield pa.RecordBatch.from_pydict({"part": [str(part)]})

    return sum((Fraction(r.part) for r in found.select("weight").mapInArrow(run, "part string").collect()), Fraction(0))


def _jobs(found: DataFrame, block: int, tasks: int) -> DataFrame:
    """Every block of the lanes with its window: ``release``, and ``due``, the deadline. Deadlines beyond a long have all their digits in ``late``."""
    total = _total(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for lane, weight, first, end in zip(*(c.to_pylist() for c in batch.columns)):
                up, down = (total / Fraction(weight)).as_integer_ratio()
                for k in range(first, end):
                    due = -(-(k + 1) * up // down)
                    late = f"{len(str(due)):05}{due}" if due >= _LAST else ""
                    out.append((lane, k, weight, k * up // down, min(due, _LAST), late))
                if len(out) >= CHUNK:
                    yield _batch(out, _JOB)
                    out = []
        yield _batch(out, _JOB)

    blocks = f"(rows + {block - 1}) div {block}"
    cut = found.selectExpr("lane", "weight", f"{blocks} as blocks", f"explode(sequence(0L, {blocks} - 1, {CHUNK}L)) as first")
    cut = cut.repartition(tasks, "lane", "first").selectExpr("lane", "weight", "first", f"least(first + {CHUNK}, blocks) as end")
    return cut.mapInArrow(run, _JOB)


def _by_deadline(group: pa.Table, start: int, since: str) -> Iterator[tuple[int, int]]:
    """Slot and row of the jobs of ``group``, earliest deadline first, from slot ``start``. None runs before what its column ``since`` says."""
    keys = zip(*(group[c].to_pylist() for c in ("due", "late", "weight", "lane", "block")))
    waiting = sorted((r, (d, late, -w, s, k, n)) for n, (r, (d, late, w, s, k)) in enumerate(zip(group[since].to_pylist(), keys)))
    ready, t, at = [], start, 0
    while at < len(waiting) or ready:
        if not ready:
            t = max(t, waiting[at][0])
        while at < len(waiting) and waiting[at][0] <= t:
            heapq.heappush(ready, waiting[at][1])
            at += 1
        yield t, heapq.heappop(ready)[-1]
        t += 1


def _alone(group: pa.Table) -> pa.Table:
    """Jobs released within a slice, not at its start, with the slice ``at`` from which they compete with those handed on: the next for those that wait for it even by themselves."""
    start, end = group["start"][0].as_py(), group["end"][0].as_py()
    at = [end] * group.num_rows
    for t, n in _by_deadline(group, start, "release"):
        if t >= end:
            break
        at[n] = start
    return group.append_column("at", pa.array(at, pa.int64()))


def _served(slots: int):
    """Of counts (at, bucket, n), in this order: how many of each bucket, the most urgent first, end in each slice. Bucket -1 ends where it is.

    A slice ends where the next does or counts are next, or at the next multiple of ``slots``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        slices = groupby(rows, key=lambda r: r[0])
        following = next(slices, None)
        following = following and (following[0], list(following[1]))
        held, buckets, out, t = {}, [], [], 0
        while buckets or following:
            if not buckets:
                t = following[0]
            fixed = 0
            if following and following[0] == t:
                for _, bucket, n in following[1]:
                    if bucket < 0:
                        fixed += n
                        continue
                    if bucket not in held:
                        heapq.heappush(buckets, bucket)
                    held[bucket] = held.get(bucket, 0) + n
                following = next(slices, None)
                following = following and (following[0], list(following[1]))
            end = t - t % slots + slots
            end = min(end, following[0]) if following else end
            free = end - t - fixed
            while free and buckets:
                bucket = buckets[0]
                n = min(free, held[bucket])
                out.append((t, bucket, n))
                free -= n
                held[bucket] -= n
                if not held[bucket]:
                    del held[heapq.heappop(buckets)]
            t = end
            if len(out) >= 50_000:
                yield _batch(out, "at long, bucket long, n long")
                out = []
        yield _batch(out, "at long, bucket long, n long")

    return run


def _dealt(jobs: pa.Table, served: pa.Table) -> pa.Table:
    """The jobs of a bucket, with the slice ``start`` that each ends in."""
    keys = list(zip(*(jobs[c].to_pylist() for c in ("due", "late", "weight", "lane", "block"))))
    waiting = sorted((a, (d, late, -w, s, k, n)) for n, (a, (d, late, w, s, k)) in enumerate(zip(jobs["at"].to_pylist(), keys)))
    start, ready, at = [None] * len(keys), [], 0
    for t, n in sorted(zip(served["at"].to_pylist(), served["n"].to_pylist())):
        while at < len(waiting) and waiting[at][0] <= t:
            heapq.heappush(ready, waiting[at][1])
            at += 1
        for _ in range(n):
            start[heapq.heappop(ready)[-1]] = t
    return jobs.select(["lane", "block", "weight", "release", "due", "late"]).append_column("start", pa.array(start, pa.int64()))


def _slots(group: pa.Table) -> pa.Table:
    """The slots of the jobs that end in one slice."""
    slot = [None] * group.num_rows
    for t, n in _by_deadline(group, group["start"][0].as_py(), "release"):
        slot[n] = t
    return group.select(["lane", "block"]).append_column("slot", pa.array(slot, pa.int64()))


def schedule(found: DataFrame, block: int) -> DataFrame:
    """lane, block and slot of every block of the lanes ``found(lane, weight, rows)``: those of ``pfair``, in slices.

    With b blocks a slice has 8 sqrt(b) slots, ``SLICE`` at least. A slot that releases more
    jobs than that, as many sources of equal weight do, begins a slice. One task reads how
    many jobs each slice has in each of sqrt(b) / 8 ranges of deadlines: b / 64 rows at
    most, unless sources have run out, when slices may hold few jobs.
    """
    total = found.agg(F.sum(F.expr(f"(rows + {block - 1}) div {block}"))).first()[0] or 0
    slots = max(SLICE, 8 * math.isqrt(total))
    jobs = settled(_jobs(found, block, -(-total // slots) or 1))
    base = F.expr(f"release - release % {slots}")
    # a row for each of those slices, of total / slots at most
    begun = jobs.groupBy("release").agg(F.count("*").alias("n")).filter(F.col("n") > slots).groupBy(base.alias("__base")).agg(F.collect_list("release").alias("__begun"))
    jobs = jobs.withColumn("__base", base).join(F.broadcast(begun), "__base", "left")
    jobs = jobs.withColumn("start", F.expr("greatest(__base, array_max(filter(__begun, x -> x <= release)))"))
    jobs = jobs.withColumn("end", F.expr(f"least(__base + {slots}, array_min(filter(__begun, x -> x > release)))")).drop("__base", "__begun")
    inside = jobs.filter("release > start").groupBy("start").applyInArrow(_alone, f"{_JOB}, start long, end long, at long")
    jobs = settled(inside.unionByName(jobs.filter("release = start").withColumn("at", F.col("start"))))
    # jobs whose windows lie within their slices end there
    fixed = "release > start and due <= end"
    open_ = jobs.filter(f"not ({fixed})")
    tasks = -(-open_.count() // slots) or 1
    open_ = open_.repartitionByRange(tasks, "due", "late", F.col("weight").desc(), "lane", "block").withColumn("bucket", F.spark_partition_id().cast("long"))
    open_ = settled(open_.drop("start", "end"))
    counts = jobs.filter(fixed).select("at", F.lit(-1).cast("long").alias("bucket")).union(open_.select("at", "bucket")).groupBy("at", "bucket").agg(F.count("*").alias("n"))
    served = settled(counts.repartition(1).sortWithinPartitions("at", "bucket").mapInArrow(_served(slots), "at long, bucket long, n long"))
    dealt = open_.groupBy("bucket").cogroup(served.groupBy("bucket")).applyInArrow(_dealt, f"{_JOB}, start long")
    ends = dealt.unionByName(jobs.filter(fixed).drop("end", "at"))
    return settled(ends.groupBy("start").applyInArrow(_slots, "lane string, block long, slot long"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")))
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", block: int = BLOCK) -> DataFrame:
    """``docs`` with lane, block, slot (from 0) and place (within the block); sorting by slot and place gives the mixture.

    ``weights`` are the targets by source (null counts as the source ''); see ``lanes``.
    Every row is kept, once. Rows are ordered within a lane by a hash of doc_id and text,
    then by doc_id; rows equal in both follow one another. Other columns stay; columns
    named like the results are replaced; an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c not in ("lane", "block", "slot", "place")]
    own, found = lanes(docs, weights, source)
    if BLOCKS:
        block = max(block, -(-(found.agg(F.sum("rows")).first()[0] or 0) // BLOCKS))
    slots = schedule(found, block)
    shared = F.concat(F.lit(_REST), F.pmod(F.xxhash64("__name"), F.lit(SHARED)).cast("string"))
    keyed = docs.select(*rest).withColumns({"__name": _name(source), "__h": F.xxhash64("doc_id", "text"), "__t": F.xxhash64("text")})
    if LANES:
        keyed = keyed.join(_sized(own.withColumnRenamed("name", "__name")), "__name", "left").withColumn("lane", F.coalesce("lane", shared))
    else:
        keyed = keyed.withColumn("lane", F.col("__name"))
    keyed = keyed.withColumn("__range", F.shiftright("__h", 64 - RANGES.bit_length() + 1))
    # rows before each range, by lane: RANGES rows for each lane at most
    before = keyed.groupBy("lane", "__range").agg(F.count("*").alias("n"))
    before = before.select("lane", "__range", F.expr("coalesce(sum(n) over (partition by lane order by __range rows between unbounded preceding and 1 preceding), 0)").alias("__before"))
    ranked = keyed.join(before, ["lane", "__range"]).withColumn(
        "__rank", F.col("__before") + F.expr("row_number() over (partition by lane, __range order by __h, doc_id, __t)") - 1
    )
    placed = ranked.withColumns({"block": F.expr(f"__rank div {block}"), "place": F.expr(f"__rank % {block}")})
    return placed.join(_sized(slots), ["lane", "block"]).select(*rest, "lane", "block", "slot", "place")


def positions(docs: DataFrame, name: str = "position") -> DataFrame:
    """``docs`` with the place of each row, from 0, in the order in which they are stored.

    Rows of files go by the files' names and their places in them; other rows by the
    parts of the DataFrame. A column of that name is replaced.
    """
    rest = [c for c in docs.columns if c != name]
    try:
        placed = docs.select(*rest, F.col("_metadata.file_name").alias("__part"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # not read from files
        placed = docs.select(*rest, F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("__part"), F.monotonically_increasing_id().alias("__row"))
        placed = placed.withColumn("__row", F.col("__row") % F.lit(1 << 33))
    # a row for each file
    before = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = before.select("__part", F.expr("coalesce(sum(n) over (order by __part rows between unbounded preceding and 1 preceding), 0)").alias("__before"))
    return placed.join(_sized(settled(before)), "__part").select(*rest, (F.col("__before") + F.col("__row")).alias(name))


def in_order(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, in as many parts as shuffles have."""
    return mixed(docs, **how).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*docs.columns)

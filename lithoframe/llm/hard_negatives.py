"""Hard negatives by norm-bucketed search.

Candidates are sorted by their length (norm), the longest first, and cut into buckets of
bounded size that know their greatest norm. By Cauchy-Schwarz no score of an anchor in a
bucket exceeds the product of its norm and the bucket's: buckets that can't reach a
window's lower limit are not visited. The others are visited in waves that double, from
the longest vectors on; after each wave the k-th score of every window is a new limit for
those after it. Within a bucket the same bound cuts off the shorter vectors.

An anchor's positives are one search in the rows of its label with a window open at both
ends, its negatives one in those of other labels with a window for each positive, so that
an anchor scores a bucket once for all its windows. Anchors visit buckets in groups of
``ANCHORS``, each a task of its own with one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.storage import settled
from lithoframe.llm.topk_search import _matrix, usable

#: Candidates in a bucket, and anchors that visit it together.
BUCKET, ANCHORS = 8192, 2048
#: Anchors scored in one product.
_AT_ONCE = 64
#: Doubles hold whole numbers exactly up to here; products of longer vectors are computed in Python's integers.
_EXACT = 2.0**53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_ASKED = "query_id long, which long, v array<double>, label long, norm double, team long, windows array<struct<nth: bigint, low: bigint, high: bigint, least: bigint>>"
_FOUND = "query_id long, which long, nth long, vec_id long, score long"


def _scores(queries: np.ndarray, cands: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return queries @ cands.T
    left, right = ([[int(x) for x in row] for row in m.tolist()] for m in (queries, cands))
    whole = [max(_LEAST, min(_MOST, sum(x * y for x, y in zip(a, b)))) for a in left for b in right]
    return np.array(whole, dtype=object).reshape(len(left), len(right))


def _reach(norms: np.ndarray, norm: float) -> np.ndarray:
    """What no score of vectors of these lengths exceeds, with room for rounding."""
    return norms * norm * (1 + 1e-9) + 1


def in_window(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    """Of the candidates at ``at`` the k best with scores from ``low`` to ``high``; ties go to the smaller id."""
    at = at[(scores[at] >= low) & (scores[at] <= high)]
    if scores.dtype == object:
        return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    if len(at) > 8 * k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def buckets(kept: DataFrame, size: int = BUCKET) -> DataFrame:
    """``kept`` (vec_id, v, label, norm) with bucket: sorted by norm, the longest first, and cut every ``size`` rows.

    Rows are dealt by ranges of norm, those of one norm by a hash, and each task sorts its
    own range; the ranges' counts say where each begins.
    """
    tasks = max(1, -(-kept.count() // (4 * size)))
    ranged = kept.withColumn("h", F.xxhash64("vec_id", "v")).repartitionByRange(tasks, F.desc("norm"), "h").sortWithinPartitions(F.desc("norm"), "h").drop("h")
    stored = settled(ranged.withColumns({"range": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    # a row for each range
    counts = sorted((r["range"], r["count"]) for r in stored.groupBy("range").count().collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])])
    starts = kept.sparkSession.createDataFrame([(r, int(b)) for (r, _), b in zip(counts, before)], "range int, before long")
    return stored.join(F.broadcast(starts), "range").withColumn("bucket", F.floor((F.col("before") + F.col("place")) / size)).drop("range", "place", "before")


def _visits(asked: DataFrame, numbers: np.ndarray, tops: np.ndarray) -> DataFrame:
    """A row for each anchor and each of the buckets (by their greatest norms) that can reach one of its windows' limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, where = [], []
            for i, (norm, windows) in enumerate(zip(batch.column("norm"), batch.column("windows"))):
                limits = [w["least"] for w in windows.as_py() if w["low"] <= w["high"]]
                live = numbers[_reach(tops, norm.as_py()) >= min(limits)] if limits else numbers[:0]
                rows.extend([i] * len(live))
                where.extend(live.tolist())
            got = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(where, pa.int64())], names=[*got.schema.names, "bucket"])

    return asked.mapInArrow(run, _ASKED + ", bucket long")


def _scored(visits: DataFrame, table: DataFrame, same: bool, exact: bool, k: int) -> DataFrame:
    """Each window's k best in each bucket that its anchor visits."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple] = []
        sizes = np.asarray(pa.compute.list_value_length(candidates.column("v"))) if candidates.num_rows else np.empty(0)
        for n in np.unique(sizes).tolist():
            cands = candidates.filter(pa.array(sizes == n)).sort_by([("norm", "descending")])
            of_size = queries.filter(pa.compute.equal(pa.compute.list_value_length(queries.column("v")), n))
            ids, labels, norms = (np.asarray(cands.column(c)) for c in ("vec_id", "label", "norm"))
            matrix = _matrix(cands.column("v"), cands.num_rows)
            for at in range(0, of_size.num_rows, _AT_ONCE):
                part = of_size.slice(at, _AT_ONCE)
                windows, lengths = part.column("windows").to_pylist(), part.column("norm").to_pylist()
                # shorter vectors than this reach no window of the part
                limits = [[w["least"] for w in ws if w["low"] <= w["high"]] for ws in windows]
                able = [int((_reach(norms, x) >= min(ls)).sum()) if ls else 0 for x, ls in zip(lengths, limits)]
                scores = _scores(_matrix(part.column("v"), part.num_rows), matrix[: max(able)], exact)
                for row, one, which, label, ws, upto in zip(scores, *(part.column(c).to_pylist() for c in ("query_id", "which", "label")), windows, able):
                    fits = np.flatnonzero(((labels[:upto] == label) == same) & (ids[:upto] != one))
                    for w in ws:
                        best = in_window(row, ids, fits, max(w["low"], w["least"]), w["high"], k)
                        found.extend((one, which, w["nth"], i, int(s)) for i, s in zip(ids[best].tolist(), row[best]))
        columns = list(zip(*found)) or [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "which", "nth", "vec_id", "score"])

    pairs = visits.select("bucket", F.col("team").alias("crew")).distinct()
    there = table.join(pairs, "bucket").select(F.col("bucket").alias("there"), "crew", "vec_id", "v", "label", "norm")
    return visits.groupBy("bucket", "team").cogroup(there.groupBy("there", "crew")).applyInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window, with rank."""
    w = Window.partitionBy("query_id", "which", "nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _narrowed(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``asked`` with each window's limit raised to its k-th score so far."""
    full = found.groupBy("query_id", "which", "nth").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
    # at most as many entries as an anchor has windows
    kth = full.groupBy("query_id", "which").agg(F.map_from_entries(F.collect_list(F.struct("nth", "kth"))).alias("kth"))
    raised = F.transform(
        "windows", lambda w: F.struct(w["nth"].alias("nth"), w["low"].alias("low"), w["high"].alias("high"), F.greatest(w["least"], F.coalesce(F.col("kth")[w["nth"]], w["least"])).alias("least"))
    )
    return asked.join(kth, ["query_id", "which"], "left").withColumn("windows", raised).drop("kth").select(*asked.columns)


def search(asked: DataFrame, table: DataFrame, directory: list[tuple[int, float]], same: bool, exact: bool, k: int) -> DataFrame:
    """query_id, which, nth (of the window), vec_id, score and rank of each window's k best candidates of the anchor's label, or of others.

    ``directory`` has each bucket's number and greatest norm, the longest first.
    """
    numbers, tops = (np.array(c) for c in zip(*directory))
    found, at, wave = None, 0, 1
    while at < len(numbers):
        here = slice(at, at + wave)
        visits = settled(_visits(asked, numbers[here], tops[here]))
        within = table.filter(F.col("bucket").between(int(numbers[here].min()), int(numbers[here].max())))
        got = _scored(visits, within, same, exact, k)
        found = settled(_best(got if found is None else found.drop("rank").unionByName(got), k))
        at, wave = at + wave, 2 * wave
        if at < len(numbers):
            asked = settled(_narrowed(asked, found, k))
    return found


def mine(vectors: DataFrame, anchors: Column, vector: str = "embedding", label: str = "label", n_positives: int = 5, k: int = 5, least_percent: int = 80, size: int = BUCKET) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id and both scores: of each anchor and positive the k best rows of another label.

    ``anchors`` selects the rows that are asked for. Vectors count as whole numbers,
    floor(256 x); a score is an inner product, a long (beyond, its limits); ties go to the
    smaller vec_id. An anchor's positives are the ``n_positives`` best rows of its label but
    those with its own vec_id; a negative's score is at most the positive's and at least
    ``least_percent`` per cent of it (so that a negative positive score has none). Fewer
    are returned where there are no more. Rows take no part without vec_id or label, or
    whose vector is null, empty or has null or non-finite components; vectors are compared
    with those of their own length only. Rows that repeat are candidates of their own;
    anchors that are equal in id, vector and label are one. Of equal vectors of one label
    only the first ids that can count are kept. Extra columns are not looked at; an empty
    table gives an empty result.
    """
    given = vectors.filter(F.col(label).isNotNull()).select(F.col("vec_id"), F.col(vector).alias("__v"), F.col(label).cast("long").alias("__label"), anchors.alias("__asked"))
    kept = usable(given, "__v", "__label", "__asked").withColumnRenamed("__label", "label")
    # held below what products of doubles overflow at
    norm = F.least(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e150))
    stored = settled(kept.withColumn("norm", norm))
    longest = stored.agg(F.max("norm")).first()[0] or 0.0
    exact = longest * longest < _EXACT
    most = max(n_positives, k) + 1
    same = Window.partitionBy("v", "label").orderBy("vec_id")
    table = settled(buckets(stored.drop("__asked").withColumn("same", F.dense_rank().over(same)).filter(F.col("same") <= most).drop("same"), size))
    # a row for each bucket: one for thousands of vectors
    directory = [(r["bucket"], r["top"]) for r in table.groupBy("bucket").agg(F.max("norm").alias("top")).orderBy("bucket").collect()]
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not directory:
        return vectors.sparkSession.createDataFrame([], out)

    asked = stored.filter("__asked").dropDuplicates(["vec_id", "v", "label"])
    teams = max(1, -(-asked.count() // ANCHORS))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("v", "label").alias("which"), "v", "label", "norm", F.pmod(F.xxhash64("vec_id", "v"), F.lit(teams)).alias("team"))

    def window(nth: Column, low: Column, high: Column) -> Column:
        return F.struct(*(c.cast("long").alias(name) for c, name in ((nth, "nth"), (low, "low"), (high, "high"), (low, "least"))))

    whole = asked.withColumn("windows", F.array(window(F.lit(0), F.lit(_LEAST), F.lit(_MOST))))
    positives = search(settled(whole), table, directory, True, exact, n_positives)
    # the least whole number that is no smaller than the percentage
    low = F.ceil(F.col("score").cast("decimal(20,0)") * F.lit(least_percent) / F.lit(100).cast("decimal(3,0)"))
    each = positives.withColumn("w", window(F.col("rank"), low, F.col("score"))).groupBy("query_id", "which").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    negatives = search(settled(asked.join(each, ["query_id", "which"])), table, directory, False, exact, k)
    of = positives.select("query_id", "which", F.col("rank").cast("long").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["query_id", "which", "nth"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
    from v a join v c on a.vec_id <> c.vec_id and len(a.v) = len(c.v) where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
    select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
    from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""

"""Exact top-k inner-product search by pivot-table elimination.

Vectors are made whole numbers (floor(256 x)) and lifted by one component so that all
have the same norm: then a larger inner product is a smaller Euclidean distance. The
distances of every vector to ``PIVOTS`` pivots are computed once and stored with it. By
the triangle inequality the largest difference between a query's and a candidate's is a
lower bound of their distance, and so bounds the candidate's score from above.

Candidates are dealt into blocks of bounded size by their nearest pivot, and each block
knows the range of its distances to every pivot. A query first visits the block with the
best bound; its k-th score there is the threshold with which it goes on to those blocks
only whose bound can reach it. Within a block candidates are scored in the order of
their bounds, in growing runs, until no bound left can beat the k-th score. Candidates
stay in their blocks; only queries travel to several. Of equal vectors, which tie, only
the first few vec_ids are candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.storage import settled

PIVOTS = 48
#: Rows that pivots are chosen from, those with the smallest hashes of vec_id.
PIVOT_SAMPLE = 2048
CANDIDATES = 8192
#: Blocks whose ranges are sent to the queries at once; more take further passes.
SENT_BLOCKS = 20_000
#: Doubles hold whole numbers exactly up to here; scores of longer vectors are computed in Python's integers.
_EXACT = 2.0**53
_MOST = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """floor(256 x) of each component, as doubles: from 2^53 on every double is a whole number."""

    def one(x: Column) -> Column:
        y = F.lit(256.0) * x.cast("double")
        return F.when(F.abs(y) < F.lit(_EXACT), F.floor(F.when(F.abs(y) < F.lit(_EXACT), y).otherwise(F.lit(0.0))).cast("double")).otherwise(y)

    return F.transform(vector, one)


def usable(vectors: DataFrame, vector: str, *more: str) -> DataFrame:
    """vec_id, v (whole numbers) and ``more`` columns of the rows that take part."""
    fine = ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col(vector)).alias("v"), *more)


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows far from each other: the first one, then always the one farthest from those chosen."""
    at = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(at) < min(most, len(sample)):
        at.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    return sample[at]


def _lift(v: np.ndarray, norm2: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm2 - (v * v).sum(axis=1), 0.0))
    return np.concatenate([v, rest[:, None]], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0.0))


def _best(bound: np.ndarray, norm2: float) -> np.ndarray:
    """The largest inner product that a distance of at least ``bound`` leaves, with room for rounding."""
    return norm2 - np.maximum(bound - 1e-6 * np.sqrt(1.0 + norm2), 0.0) ** 2 / 2 + 1e-6 * (1.0 + norm2)


def _scores(cands: np.ndarray, q: np.ndarray, norm2: float) -> np.ndarray:
    if norm2 < _EXACT:
        return cands @ q
    mine = [int(x) for x in q.tolist()]
    return np.array([max(-_MOST - 1, min(_MOST, sum(int(x) * y for x, y in zip(c, mine)))) for c in cands.tolist()], dtype=object)


def eliminate(
    ids: np.ndarray, cands: np.ndarray, table: np.ndarray, query_id: int, q: np.ndarray, q_table: np.ndarray, norm2: float, k: int, least: float = -np.inf
) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids and scores of one query's top k among ``cands``; those below ``least`` may be left out.

    The candidates with the best bounds come first; where the bounds leave over an eighth
    of the block after them, the block's scores are one product, else runs that grow.
    """
    bound = np.abs(table - q_table[None, :]).max(axis=1).astype(float) if table.shape[1] else np.zeros(len(ids))
    best = _best(bound, norm2)
    order = np.flatnonzero((ids != query_id) & (best >= least))
    top_ids, top = np.empty(0, dtype=np.int64), np.empty(0, dtype=float if norm2 < _EXACT else object)

    def with_more(part: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who, score = np.concatenate([top_ids, ids[part]]), np.concatenate([top, scores])
        if norm2 < _EXACT and len(score) > 8 * k:
            can = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            who, score = who[can], score[can]
        keep = np.lexsort((who, -score))[:k] if norm2 < _EXACT else np.array(sorted(range(len(score)), key=lambda i: (-score[i], who[i]))[:k], dtype=np.int64)
        return who[keep], score[keep]

    run = max(64, 4 * k)
    while len(order):
        if len(order) > run:
            parted = np.argpartition(-best[order], run)
            part, order = order[parted[:run]], order[parted[run:]]
        else:
            part, order = order, order[:0]
        top_ids, top = with_more(part, _scores(cands[part], q, norm2))
        if len(top) == k:
            order = order[best[order] >= top[-1]]
        if 8 * len(order) > len(ids) and norm2 < _EXACT:
            top_ids, top = with_more(order, (cands @ q)[order])
            break
        run *= 2
    return top_ids, top


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [p.flatten().to_numpy(zero_copy_only=False) for p in parts]
    return (np.concatenate(flat) if flat else np.empty(0)).reshape(rows, -1) if rows else np.zeros((0, 0))


def pivot_table(kept: DataFrame, pivots: np.ndarray, norm2: float) -> DataFrame:
    """``kept`` with d (distances to the pivots; none where vectors are of another length) and cell (the nearest pivot, or minus the length)."""
    size = pivots.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for n in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == n))
                table = np.zeros((part.num_rows, 0))
                if n == size and len(pivots):
                    table = _distances(_lift(_matrix(part.column(1), part.num_rows), norm2), pivots)
                cell = table.argmin(axis=1) if table.shape[1] else np.full(part.num_rows, -n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * table.shape[1], pa.int32()), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(cell, pa.int64())], names=["vec_id", "v", "d", "cell"])

    return kept.mapInArrow(run, "vec_id long, v array<double>, d array<double>, cell long")


def _visits(asked: DataFrame, ranges: list, norm2: float, first: bool) -> DataFrame:
    """``asked`` (query, v, d, length, least) with cell and part of the blocks to visit: the one with the best bound, or all others that can reach ``least``."""
    cells = np.array([(r.cell, r.part) for r in ranges], dtype=np.int64)
    sizes = np.array([-r.cell if r.cell < 0 else -1 for r in ranges])
    low, high = (np.array([r[k] for r in ranges if r.cell >= 0], dtype=float) for k in ("low", "high"))
    pivoted = np.flatnonzero(cells[:, 0] >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, where = [], []
            for i, (v, d, least, seen_cell, seen_part) in enumerate(zip(*(batch.column(k) for k in (2, 3, 4, 5, 6)))):
                d = d.values.to_numpy(zero_copy_only=False)
                if len(d):
                    at, bound = pivoted, np.maximum(np.maximum(low - d, d - high).max(axis=1), 0.0) if len(pivoted) else np.empty(0)
                else:
                    at, bound = np.flatnonzero(sizes == len(v.values)), np.zeros((sizes == len(v.values)).sum())
                if first:
                    keep = [int(bound.argmin())] if len(at) else []
                else:
                    keep = np.flatnonzero((_best(bound, norm2) >= least.as_py()) & ((cells[at] != (seen_cell.as_py(), seen_part.as_py())).any(axis=1)))
                rows.extend([i] * len(keep))
                where.extend(cells[at[keep]].tolist() if len(keep) else [])
            got = batch.select(["query_id", "nth", "v", "d", "least"]).take(pa.array(rows, pa.int64()))
            pairs = np.array(where, dtype=np.int64).reshape(-1, 2)
            best = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
            yield pa.RecordBatch.from_arrays([*got.columns, *best], names=["query_id", "nth", "v", "d", "least", "cell", "part"])

    return asked.select("query_id", "nth", "v", "d", "least", "cell", "part").mapInArrow(run, "query_id long, nth long, v array<double>, d array<double>, least double, cell long, part long")


def _search(visits: DataFrame, table: DataFrame, norm2: float, k: int) -> DataFrame:
    """query_id, nth, vec_id and score: each query's top k in each block that it visits."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and candidates.num_rows:
            ids, n = np.asarray(candidates.column("vec_id")), candidates.num_rows
            # bounds allow for the rounding of single precision, whose range is smaller
            kind = np.float32 if norm2 < 1e60 else np.float64
            cands, dist = _matrix(candidates.column("v"), n), _matrix(candidates.column("d"), n).astype(kind)
            q, q_dist = _matrix(queries.column("v"), queries.num_rows), _matrix(queries.column("d"), queries.num_rows).astype(kind)
            for i, (one, nth, least) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("query_id", "nth", "least")))):
                who, score = eliminate(ids, cands, dist, one, q[i], q_dist[i], norm2, k, least)
                found.extend((one, nth, int(w), int(s)) for w, s in zip(who, score))
        columns = list(zip(*found)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "nth", "vec_id", "score"])

    by = ("cell", "part")
    return visits.groupBy(*by).cogroup(table.select(*by, "vec_id", "v", "d").groupBy(*by)).applyInArrow(run, "query_id long, nth long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each row that ``queries`` selects.

    Candidates are all rows but those with the query's own vec_id, rows that repeat
    included; ties go to the smaller vec_id. Query rows that are equal in vec_id and
    vector are one query; those that share a vec_id only give a result each. Vectors
    null, empty, or with null or non-finite components, and null vec_ids, take no part;
    vectors are compared with those of their own length only. Scores beyond a long are
    its limits. Extra columns are not looked at; an empty table gives an empty result.
    """
    kept = usable(vectors, vector)
    norm2 = float(kept.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0)
    sample = [r.v for r in kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect()]
    sample = [v for v in sample if len(v) == len(sample[0])]
    # norms beyond doubles leave no distances: then all candidates are scored
    lifted = _lift(np.array(sample, dtype=float).reshape(len(sample), -1), norm2) if sample and norm2 < 1e300 else np.zeros((0, 1))
    pivots = choose_pivots(lifted) if len(lifted) else np.zeros((0, 1))
    stored = settled(pivot_table(kept, pivots, norm2))
    # of equal vectors only the first k + 1 vec_ids can be among the k best of a query
    table = settled(stored.withColumn("same", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("same") <= k + 1).drop("same"))
    counted = table.groupBy("cell").agg(F.ceil(F.count("*") / CANDIDATES).cast("long").alias("parts"))
    # a row for each pivot or length of vectors
    table = table.join(F.broadcast(settled(counted)), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")
    spans = [F.array(*(f(F.get("d", p)) for p in range(len(pivots)))).cast("array<double>").alias(name) for name, f in (("low", F.min), ("high", F.max))]
    ranges = settled(table.groupBy("cell", "part").agg(*spans))
    passes = -(-ranges.count() // SENT_BLOCKS)
    groups = [ranges.filter(F.pmod(F.xxhash64("cell", "part"), F.lit(passes)) == g) for g in range(passes)]
    asked = stored.filter(queries).select(F.col("vec_id").alias("query_id"), "v", "d").dropDuplicates(["query_id", "v"])
    asked = settled(asked.withColumns({"nth": F.xxhash64("v"), "least": F.lit(float("-inf")), "cell": F.lit(None).cast("long"), "part": F.lit(None).cast("long")}))
    empty = asked.limit(0).select("query_id", "nth", F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    if not passes:
        return empty.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")

    # the nearest block of the first group: any block's k-th score is a threshold
    seen = settled(_visits(asked, groups[0].collect(), norm2, True))
    near = settled(_search(seen, table, norm2, k))
    least = near.groupBy("query_id", "nth").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("least"))
    visited = seen.select("query_id", "nth", "cell", "part")
    goes_on = settled(asked.drop("least", "cell", "part").join(visited, ["query_id", "nth"], "left").join(least, ["query_id", "nth"], "left"))
    goes_on = goes_on.fillna(float("-inf"), ["least"]).fillna(-(1 << 40), ["cell", "part"])
    found = near
    for group in groups:
        found = found.unionByName(_search(_visits(goes_on, group.collect(), norm2, False), table, norm2, k))
    # k rows for each query and block that it visited
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id, nth order by score desc, vec_id)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""

"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification.

For a benchmark item of w words, every run of w words of a document that holds at least
one of the item's five-word shingles gets a 128-bit SimHash over its shingles, weighted
by how often they occur. Fingerprints are cut into 16 blocks of 8 bits. By the pigeonhole
principle two fingerprints within ``RADIUS`` (47 at most) differ by at most two bits in
some block, so looking up every block's keys within two bits finds all items within the
radius. Those are then verified: weighted Jaccard similarity of the two shingle
multisets, 0.75 or more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.storage import settled
from lithoframe.llm.text import LOOSE, SHINGLE, mix, pieces, shingle_hashes, words_by_row

RADIUS = 46
BLOCKS = 16
SIMILARITY = 0.75
#: Windows of a text whose fingerprints are held at once.
WINDOWS = 8192
#: Text of benchmark items that goes to all tasks at once; more items go in further passes.
INDEX_BYTES = 16_000_000


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    return words_by_row(pc.utf8_lower(column), LOOSE)


def _bits(shingles: np.ndarray) -> np.ndarray:
    both = np.stack([shingles, mix(shingles ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1)


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash, as 16 bytes, of the ``length`` shingles from each start (fewer at the end)."""
    low, high = int(starts[0]), min(len(shingles), int(starts[-1]) + length)
    sums = np.zeros((high - low + 1, 128), dtype=np.int32)
    np.cumsum(_bits(shingles[low:high]), axis=0, dtype=np.int32, out=sums[1:])
    ends = np.minimum(starts + length, high)
    ones = sums[ends - low] - sums[starts - low]
    return np.packbits(2 * ones > (ends - starts)[:, None], axis=1)


class BenchmarkIndex:
    """Fingerprints of benchmark items with their block tables. Items of fewer than five words are no evidence and left out."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        kept = [(i, shingle_hashes(w), len(w)) for (i, _), w in zip(items, _words(pa.array([t for _, t in items], pa.string()))) if len(w) >= SHINGLE]
        self.ids = [i for i, _, _ in kept]
        self.counts = [Counter(s.tolist()) for _, s, _ in kept]
        self.lengths = np.array([len(s) for _, s, _ in kept], dtype=np.int64)
        self.prints = np.concatenate([window_fingerprints(s, np.zeros(1, dtype=np.int64), len(s)) for _, s, _ in kept]) if kept else np.empty((0, BLOCKS), np.uint8)
        self.anchors = np.unique(np.concatenate([s for _, s, _ in kept])) if kept else np.empty(0, dtype=np.uint64)
        # for each length of items, which anchors such items have
        self.of_length = {}
        for n in np.unique(self.lengths).tolist():
            mine = np.zeros(len(self.anchors), dtype=bool)
            for s in (s for _, s, _ in kept if len(s) == n):
                mine[np.searchsorted(self.anchors, s)] = True
            self.of_length[n] = mine
        ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)
        near = ones[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS
        # tables[block, key]: the items that have a key within two bits there
        self.tables = [[np.flatnonzero(near[key, self.prints[:, b]]) for key in range(256)] for b in range(BLOCKS)]
        self.ones = ones

    def matches(self, words: np.ndarray) -> list[tuple[int, float, int]]:
        """(item, similarity, first word of the window) of each item that a window of the text matches, at its best."""
        if len(words) < SHINGLE or not len(self.anchors):
            return []
        shingles = shingle_hashes(words)
        at = np.minimum(np.searchsorted(self.anchors, shingles), len(self.anchors) - 1)
        hits = np.flatnonzero(self.anchors[at] == shingles)
        if not len(hits):
            return []
        best: dict[int, tuple[float, int]] = {}
        for n, mine in self.of_length.items():
            places = hits[mine[at[hits]]]
            if not len(places):
                continue
            # windows that hold a hit: runs of starts, looked at in pieces of bounded size
            low, high = np.maximum(places - n + 1, 0), np.minimum(places, max(0, len(shingles) - n))
            new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1] + 1]))
            for a, b in zip(low[new].tolist(), high[np.append(new[1:] - 1, len(high) - 1)].tolist()):
                for start in range(a, b + 1, WINDOWS):
                    self._lookup(shingles, np.arange(start, min(b + 1, start + WINDOWS)), n, best)
        return [(self.ids[k], sim, start) for k, (sim, start) in sorted(best.items())]

    def _lookup(self, shingles: np.ndarray, starts: np.ndarray, n: int, best: dict[int, tuple[float, int]]) -> None:
        for start, mark in zip(starts.tolist(), window_fingerprints(shingles, starts, n)):
            found = np.unique(np.concatenate([self.tables[b][key] for b, key in enumerate(mark.tolist())]))
            found = found[self.lengths[found] == n]
            if not len(found):
                continue
            far = self.ones[self.prints[found] ^ mark].sum(axis=1)
            found = found[far <= RADIUS]
            if not len(found):
                continue
            window = Counter(shingles[start : start + n].tolist())
            for k in found.tolist():
                shared = sum((window & self.counts[k]).values())
                sim = shared / (window.total() + n - shared)
                if sim >= SIMILARITY and (k not in best or sim > best[k][0]):
                    best[k] = (sim, start)


def _indexes(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in groups of bounded size, by a hash of their ids, one after the other; and whether there are several."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // INDEX_BYTES
    for k in range(parts):
        yield [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()], parts > 1


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, word_start for each benchmark item that a document holds.

    Null or empty texts hold nothing, nor do texts or items of fewer than five words; a
    document shorter than an item is compared as a whole. Rows that share a doc_id
    report together, at their best window; null doc_ids report as null. Words are runs of
    other than white space and ASCII punctuation, in lower case; extra columns are not
    looked at.
    """
    found = None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items, several in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = BenchmarkIndex(items)
            for batch in pieces(batches, 1):
                rows = [(d, *m) for d, w in zip(batch.column(0).to_pylist(), _words(batch.column(1))) for m in index.matches(w)]
                cols = list(zip(*rows)) or [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "similarity", "word_start"])

        part = docs.mapInArrow(run, "doc_id long, item_id long, similarity double, word_start long")
        # of several groups each is looked up, and let go, before the next is read
        part = settled(part) if several else part
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("similarity", (-F.col("word_start")).alias("back")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.similarity", (-F.col("m.back")).alias("word_start"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; filtered in place, without a shuffle."""
    at = docs.columns.index("text")
    for items, several in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = BenchmarkIndex(items)
            for batch in pieces(batches, at):
                yield batch.filter(pa.array([not index.matches(w) for w in _words(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = settled(docs) if several else docs
    return docs

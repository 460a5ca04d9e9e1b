"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two texts link when the Jaccard similarity of their sets of five-word shingles is at
least 0.75. A set of n shingles links only with sets that share at least T = ceil(0.75 n)
of them. As in DivideSkip the L longest of its inverted lists are set aside: the others
are merged, a partner must occur in T - L of them, and the lists set aside are then only
probed by binary search for the partners that remain.

Sets travel packed: a bucket is one row with the sorted hashes of many documents. For a
bucket each distinct shingle asks its list once, and the lists (hash ranges, dealt into
blocks) answer with their length and smallest member, so that a shingle that a third of
all documents hold costs one question a bucket and is never gathered.

1. ``signatures``: size, digest and first hashes of every text; equal digests are copies.
2. ``_reaching``: with hashes as the order of lists, a document whose first n - L shingles
   are not found elsewhere T - L times links with nothing and goes no further.
3. ``_index``: lists ordered by length, shortest first. A document posts the n - L first
   of them; those it shares with no one need no list.
4. Leaders: a list names its smallest document; each document is verified against those
   that most of its lists name. That joins large families at linear cost.
5. Hot lists (over ``HOT`` documents) are not merged: a pair that meets in them alone
   consists of documents with fewer than n - T + 1 other shingles, and shares just hot
   shingles. Those with equal hot sets link exactly if their sizes add up to 7/3 of it
   at most, so that a star around the smallest one connects them.
6. ``_pairs_of_lists`` and ``merge_lists``: in lists that hold several components, pairs of
   different ones are counted by query; those with T - L occurrences are verified.
7. Connected components over all verified links.

Verification (``_probed``) is exact on whole sets of 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm.graph import components
from lithoframe.llm.storage import settled
from lithoframe.llm.text import mix, pieces, shingle_hashes, words_by_row

#: Postings in a block of inverted lists, on average.
BLOCK = 300_000
#: Shingles in a bucket of documents; a larger document is a bucket of its own.
BUCKET = 300_000
#: Bytes of first hashes that are sorted at once, to be asked for.
HEADS = 1 << 22
#: Documents whose answers are added up together, on average.
ANSWERS = 50_000
#: A list of more documents than this is hot.
HOT = 256
#: A list of more documents than this is a block of its own, which bounds the pairs of a block.
ALONE = 32
#: Documents of a list that are paired by one task; longer lists are paired piece by piece.
CHUNK = 2000
#: Leaders that a document may try.
LEADERS = 4
#: Documents that one leader's set is sent along with.
TOGETHER = 500
#: Tables of at most so many rows are sent to all tasks for joins with the documents; larger ones are shuffled.
SENT_ROWS = 400_000


def least_overlap(n: int) -> int:
    """T: shingles that a set of n must share with any set it links with."""
    return -(-3 * n // 4)


def set_aside(n: int) -> int:
    """L: lists of a set of n that are not merged."""
    return 4 * least_overlap(n) // 5


def occurrences(n: int, m: int | None = None) -> int:
    """T - L: merged lists in which sets of n and m that link meet at least; without m, for any partner.

    Of the shingles that two sets share, the first T - L in the order of lists have at
    most n - T shingles of either set before them that aren't shared, so that both post
    them; T is the overlap that the two need, ceil(3 (n + m) / 7), and L the larger of theirs.
    """
    if m is None:
        return least_overlap(n) - set_aside(n)
    return -(-3 * (n + m) // 7) - max(set_aside(n), set_aside(m))


def _sized(table: DataFrame) -> tuple[DataFrame, bool]:
    """``table``, to be sent to all tasks if it has at most ``SENT_ROWS`` rows (it is counted), and whether it is."""
    small = table.count() <= SENT_ROWS
    return (F.broadcast(table) if small else table), small


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte (all first bytes, then all second ones ...), which packs well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _numbers(data, kind=np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def _near(values: np.ndarray) -> bytes:
    """Whole numbers that often differ little from the one before."""
    return _planes(np.diff(values, prepend=0))


def _from_near(data) -> np.ndarray:
    return np.cumsum(_numbers(data))


def _column(table: pa.Table, name: str, read) -> np.ndarray:
    """All numbers of a packed column, in the order of the rows."""
    parts = [read(x.as_buffer()) for x in table.column(name)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def _u64(data) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def _short_hashes(hashes: np.ndarray) -> bytes:
    """Leading 48 bits of each hash: enough to pass a document over by, which whole hashes then verify."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_short(data) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view(">u8").reshape(-1).astype(np.uint64)


def _block_of(tokens: np.ndarray, blocks: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)


_SIG = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("head", pa.binary())])


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n, digest and head (its first n - L hashes, packed; null where its task had the same set before) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in pieces(batches, 1):
            sizes, digests, heads = [], [], []
            for words in words_by_row(batch.column(1)):
                s = np.unique(shingle_hashes(words))
                place = mix(s + np.arange(len(s), dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
                d = np.array([place.sum(dtype=np.uint64), np.bitwise_xor.reduce(s) if len(s) else 0, len(s)], dtype=np.uint64).tobytes()
                sizes.append(len(s))
                digests.append(d)
                heads.append(None if d in seen else _short_hashes(s[: len(s) - set_aside(len(s))]))
                if len(seen) < 200_000:
                    seen.add(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(heads, pa.binary())], schema=_SIG)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n long, digest binary, head binary")


def _reaching(heads: DataFrame, total: int) -> DataFrame:
    """doc_id of the documents whose first hashes are found in other documents often enough for a link.

    A hash that a batch of documents holds twice is sent once, without documents: they
    need no answer.
    """
    blocks = max(8, total // BLOCK)
    parts = 1 + heads.count() // ANSWERS

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, HEADS):
            ids = np.asarray(batch.column(0))
            parts = [_from_short(x.as_buffer()) for x in batch.column(1)]
            if not parts:
                continue
            token, row = np.concatenate(parts), np.repeat(np.arange(len(ids)), [len(p) for p in parts])
            order = np.argsort(token, kind="stable")
            token, row = token[order], row[order]
            start = _runs(token)
            size = np.diff(start, append=len(token))
            known = np.bincount(row[np.repeat(size > 1, size)], minlength=len(ids))
            one = start[size == 1]
            # rows of those that come once, then the others without
            token, who = np.concatenate([token[one], token[start[size > 1]]]), np.concatenate([row[one], np.full((size > 1).sum(), len(ids))])
            order = np.lexsort((who, _block_of(token, blocks)))
            token, who = token[order], who[order]
            cuts = np.append(_runs(_block_of(token, blocks)), len(token))
            out = {k: [] for k in ("block", "tokens", "docs", "known", "times")}
            for nth, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                out["block"].append(int(_block_of(token[a : a + 1], blocks)[0]))
                out["tokens"].append(_short_hashes(token[a:b]))
                out["docs"].append(_near(ids[who[a:b][who[a:b] < len(ids)]]))
                told = nth == int(ids[0]) % (len(cuts) - 1)
                out["known"].append(_near(ids[known > 0]) if told else b"")
                out["times"].append(_planes(known[known > 0]) if told else b"")
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in ("tokens", "docs", "known", "times"))]))

    def answer(table: pa.Table) -> pa.Table:
        token, docs = _column(table, "tokens", _from_short), _column(table, "docs", _from_near)
        lengths = [(len(t.as_buffer()) // 6, len(d.as_buffer()) // 8) for t, d in zip(table.column("tokens"), table.column("docs"))]
        owned = np.concatenate([np.arange(t) < d for t, d in lengths])
        at = np.where(owned, np.cumsum(owned) - 1, -1)
        order = np.argsort(token, kind="stable")
        token, at = token[order], at[order]
        size = np.diff(_runs(token), append=len(token))
        found = at[np.repeat(size > 1, size)]
        docs, times = docs[found[found >= 0]], np.ones((found >= 0).sum(), dtype=np.int64)
        docs, times = np.concatenate([docs, _column(table, "known", _from_near)]), np.concatenate([times, _column(table, "times", _numbers)])
        docs, times = _summed(docs, times)
        part = (docs % parts).astype(np.int64)
        order = np.lexsort((docs, part))
        cuts = np.append(_runs(part[order]), len(order))
        out = {"part": [], "docs": [], "times": []}
        for a, b in zip(cuts[:-1], cuts[1:]):
            out["part"].append(int(part[order[a]]))
            out["docs"].append(_near(docs[order[a:b]]))
            out["times"].append(_planes(times[order[a:b]]))
        return pa.table(out, schema=pa.schema([("part", pa.int64()), ("docs", pa.binary()), ("times", pa.binary())]))

    def added(table: pa.Table) -> pa.Table:
        docs, times = _summed(_column(table, "docs", _from_near), _column(table, "times", _numbers))
        return pa.table({"doc_id": docs, "times": times})

    asked = heads.select("doc_id", "head").mapInArrow(ask, "block long, tokens binary, docs binary, known binary, times binary")
    answers = asked.groupBy("block").applyInArrow(answer, "part long, docs binary, times binary")
    times = answers.groupBy("part").applyInArrow(added, "doc_id long, times long")
    least = F.expr("cast(ceil(0.75 * n) as long) - cast(ceil(0.75 * n) as long) * 4 div 5")
    return heads.select("doc_id", least.alias("least")).join(times, "doc_id").filter("times >= least").select("doc_id")


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    start = _runs(keys[order])
    return keys[order][start], np.add.reduceat(values[order], start) if len(start) else values


_BUCKET = "bucket long, ids binary, sizes binary, tokens binary"


def buckets_of(docs: DataFrame) -> DataFrame:
    """The sets of ``docs(doc_id, text)``, many to a row: bucket, ids, sizes and tokens, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held, nth = [], [], 0, TaskContext.get().partitionId() << 32

        def packed() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            row = {"bucket": [nth], "ids": [_near(np.array(ids, dtype=np.int64))], "sizes": [_planes(sizes)], "tokens": [np.concatenate(sets).tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("bucket", pa.int64()), *((k, pa.binary()) for k in ("ids", "sizes", "tokens"))]))

        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), words_by_row(batch.column(1))):
                s = np.unique(shingle_hashes(words))
                if held and held + len(s) > BUCKET:
                    yield packed()
                    ids, sets, held, nth = [], [], 0, nth + 1
                ids.append(doc)
                sets.append(s)
                held += len(s)
        if held:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(run, _BUCKET)


def _list_facts(buckets: DataFrame, blocks: int) -> DataFrame:
    """bucket, tokens, count, low, high: of each list that a bucket's ``tokens`` ask for, its length and its smallest and largest value.

    ``buckets`` has values, packed, beside ids. Lists of one value give no answer.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, values, sizes, tokens in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3))):
                token, value = _u64(tokens.as_buffer()), np.repeat(_from_near(values.as_buffer()), _numbers(sizes.as_buffer()))
                order = np.argsort(token, kind="stable")
                token, value = token[order], value[order]
                start = _runs(token)
                if not len(start):
                    continue
                facts = [np.diff(start, append=len(token)), np.minimum.reduceat(value, start), np.maximum.reduceat(value, start)]
                token = token[start]
                block = _block_of(token, blocks)
                cuts = np.append(_runs(block), len(block))
                out = {"block": block[cuts[:-1]].tolist(), "bucket": [bucket] * (len(cuts) - 1), "tokens": [], "count": [], "low": [], "over": []}
                for a, b in zip(cuts[:-1], cuts[1:]):
                    out["tokens"].append(token[a:b].tobytes())
                    out["count"].append(_planes(facts[0][a:b]))
                    out["low"].append(_planes(facts[1][a:b]))
                    out["over"].append(_planes(facts[2][a:b] - facts[1][a:b]))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int64()), *((k, pa.binary()) for k in ("tokens", "count", "low", "over"))]))

    def answer(table: pa.Table) -> pa.Table:
        token, count, low, over = (_column(table, k, read) for k, read in (("tokens", _u64), ("count", _numbers), ("low", _numbers), ("over", _numbers)))
        asker = np.repeat(np.asarray(table.column("bucket")), [len(x.as_buffer()) // 8 for x in table.column("tokens")])
        order = np.argsort(token, kind="stable")
        token, count, low, high, asker = token[order], count[order], low[order], (low + over)[order], asker[order]
        start = _runs(token)
        size = np.diff(start, append=len(token))
        facts = [np.repeat(x, size) for x in (np.add.reduceat(count, start), np.minimum.reduceat(low, start), np.maximum.reduceat(high, start))]
        mixed = np.flatnonzero(facts[1] < facts[2])
        mixed = mixed[np.argsort(asker[mixed], kind="stable")]
        cuts = np.append(_runs(asker[mixed]), len(mixed))
        out = {"bucket": asker[mixed[cuts[:-1]]].tolist(), "tokens": [], "count": [], "low": []}
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = mixed[a:b]
            out["tokens"].append(token[at].tobytes())
            out["count"].append(_planes(facts[0][at]))
            out["low"].append(_planes(facts[1][at]))
        return pa.table(out, schema=pa.schema([("bucket", pa.int64()), *((k, pa.binary()) for k in ("tokens", "count", "low"))]))

    asked = buckets.select("bucket", "values", "sizes", "tokens").mapInArrow(ask, "block long, bucket long, tokens binary, count binary, low binary, over binary")
    return asked.groupBy("block").applyInArrow(answer, "bucket long, tokens binary, count binary, low binary")


def _facts_for(token: np.ndarray, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Length (0 where there is no answer) and smallest value of the list of each token."""
    known, count, low = _column(right, "tokens", _u64), _column(right, "count", _numbers), _column(right, "low", _numbers)
    if not len(known):
        return np.zeros(len(token), dtype=np.int64), np.zeros(len(token), dtype=np.int64)
    order = np.argsort(known)
    known, count, low = known[order], count[order], low[order]
    at = np.minimum(np.searchsorted(known, token), len(known) - 1)
    return np.where(known[at] == token, count[at], 0), low[at]


_INDEX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("leaders", pa.list_(pa.int64())), ("tokens", pa.binary()), ("hot", pa.binary()), ("kind", pa.binary()), ("hot_size", pa.int64())])


def _index(left: pa.Table, right: pa.Table) -> pa.Table:
    """What each document of a bucket posts: its n - L shortest lists, less those that hold no other document.

    kind, the digest of its hot shingles, is given to documents whose other shingles
    don't fill a prefix of n - T + 1. Documents that share less than T shingles go.
    """
    out = {k: [] for k in _INDEX.names}
    for ids, sizes, tokens in zip(*(left.column(k) for k in ("ids", "sizes", "tokens"))):
        token, sizes = _u64(tokens.as_buffer()), _numbers(sizes.as_buffer())
        length, low = _facts_for(token, right)
        ends = np.cumsum(sizes)
        for doc, n, b in zip(_from_near(ids.as_buffer()).tolist(), sizes.tolist(), ends.tolist()):
            t, size, least = token[b - n : b], length[b - n : b], low[b - n : b]
            shared = np.flatnonzero(size)
            if len(shared) < least_overlap(n):
                continue
            shared = shared[np.argsort(size[shared], kind="stable")]
            posted = shared[: len(shared) - set_aside(n)]
            named, votes = np.unique(least[posted], return_counts=True)
            best = named[np.argsort(-votes, kind="stable")]
            hot = t[size > HOT]
            crowded = len(hot) >= least_overlap(n)
            out["doc_id"].append(doc)
            out["n"].append(n)
            out["leaders"].append(best[best != doc][:LEADERS])
            out["tokens"].append(t[posted].tobytes())
            out["hot"].append((size[posted] > HOT).tobytes())
            out["kind"].append(np.array([mix(hot).sum(dtype=np.uint64), np.bitwise_xor.reduce(hot), len(hot)], dtype=np.uint64).tobytes() if crowded else None)
            out["hot_size"].append(len(hot))
    return pa.table(out, schema=_INDEX)


def _probed(pairs: DataFrame, buckets: DataFrame) -> DataFrame:
    """The pairs a, b that link. Whole sets: that of b is sent once for ``TOGETHER`` partners, and every shingle of a probed in it."""
    pairs = settled(pairs.select("a", "b"))
    sizes, few = _sized(settled(pairs.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))))
    dealt = pairs.join(sizes, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("doc_id"), F.lit(1).alias("side"))
    heads = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("doc_id"), F.lit(0).alias("side"))
    needed, small = _sized(settled(dealt.unionByName(heads)))
    ids, few = _sized(settled(needed.select("doc_id").distinct()))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, tokens in zip(*(batch.column(k) for k in range(3))):
                ids, ends, data = _from_near(ids.as_buffer()), np.cumsum(_numbers(sizes.as_buffer())) * 8, tokens.as_buffer().to_pybytes()
                for lo in range(0, len(ids), 256):
                    sets = [data[a:b] for a, b in zip([0, *ends][lo : lo + 256], ends[lo : lo + 256])]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 256]), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    sets = buckets.select("ids", "sizes", "tokens").mapInArrow(unpacked, "doc_id long, shingles binary")
    rows = (sets.join(ids, "doc_id", "left_semi") if few else sets).join(needed, "doc_id").select("b", "part", "side", "doc_id", "shingles")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, dtype=np.uint64)
        for batch in batches:
            found = []
            for b, side, doc, s in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), batch.column(4)):
                s = _u64(s.as_buffer())
                if side == 0:
                    held = s.copy()
                elif len(held) and 4 * min(len(s), len(held)) >= 3 * max(len(s), len(held)):
                    q, c = (s, held) if len(s) < len(held) else (held, s)
                    shared = int((c[np.minimum(np.searchsorted(c, q), len(c) - 1)] == q).sum())
                    if 100 * shared >= 75 * (len(s) + len(held) - shared):
                        found.append((doc, b))
            yield _two(found)

    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "side").mapInArrow(probe, "a long, b long")


def _two(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


#: Of each document that posts lists: id, component, size, hot lists among its posted ones, and number of its kind (0 for none).
_FACTS = ("ids", "comps", "ns", "hots", "kinds")


def _posting_buckets(index: DataFrame) -> DataFrame:
    """``index(doc_id, comp, n, kind, tokens, hot)`` many to a row; values are the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) // 8 for x in batch.column(4)], dtype=np.int64)
            docs, comps, ns, kinds = (np.asarray(batch.column(k)) for k in range(4))
            cuts = [0, *np.flatnonzero(np.diff(np.cumsum(sizes) // BUCKET)) + 1, len(sizes)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                hot = [np.frombuffer(x.as_buffer(), dtype=bool) for x in batch.column(5)[a:b]]
                facts = (docs[a:b], comps[a:b], ns[a:b], np.array([h.sum() for h in hot], dtype=np.int64), kinds[a:b])
                row = {"bucket": [nth], "values": [_near(comps[a:b])], "sizes": [_planes(sizes[a:b])], "tokens": [b"".join(x.as_py() for x in batch.column(4)[a:b])]}
                row |= {"hot": [np.packbits(np.concatenate(hot)).tobytes()], "facts": [_planes(np.concatenate(facts))]}
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("bucket", pa.int64()), *((k, pa.binary()) for k in ("values", "sizes", "tokens", "hot", "facts"))]))
                nth += 1

    return index.select("doc_id", "comp", "n", "kind", "tokens", "hot").mapInArrow(run, "bucket long, values binary, sizes binary, tokens binary, hot binary, facts binary")


_LISTS = "block long, piece int, other int, pieces int, tokens binary, hot binary, runs binary, facts binary"


def _postings(blocks: int):
    """Deals a bucket's postings in lists of several components to the blocks of those lists.

    Of hot lists only documents with a kind are sent. Lists of over ``ALONE`` documents
    are blocks of their own; those of over ``CHUNK`` are cut into pieces, and each pair of
    pieces is one.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k.split()[0]: [] for k in _LISTS.split(", ")}
        for sizes, tokens, hot, facts in zip(*(left.column(k) for k in ("sizes", "tokens", "hot", "facts"))):
            token, sizes = _u64(tokens.as_buffer()), _numbers(sizes.as_buffer())
            hot = np.unpackbits(np.frombuffer(hot.as_buffer(), dtype=np.uint8), count=len(token)).astype(bool)
            facts = _numbers(facts.as_buffer()).reshape(len(_FACTS), -1)
            row = np.repeat(np.arange(len(sizes)), sizes)
            length, _ = _facts_for(token, right)
            sent = np.flatnonzero((length > 0) & (~hot | (facts[4, row] != 0)))
            token, hot, row, length = token[sent], hot[sent], row[sent], length[sent]
            pieces = -(-length // CHUNK)
            block = np.where(length <= ALONE, _block_of(token, blocks), mix(token).view(np.int64) | np.int64(1 << 62))
            mine = np.where(pieces == 1, 0, facts[0, row] % pieces)
            for most in np.unique(pieces).tolist():
                of = np.flatnonzero(pieces == most)
                for other in range(most):
                    low, high = np.minimum(mine[of], other), np.maximum(mine[of], other)
                    order = of[np.lexsort((row[of], high, low, block[of]))]
                    ends = np.lexsort((row[of], high, low, block[of]))
                    key = np.stack([block[of], low, high])[:, ends]
                    cuts = np.append(np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])), len(order))
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        at = order[a:b]
                        who = _runs(row[at])
                        out["block"].append(int(key[0, a]))
                        out["piece"].append(int(key[1, a]))
                        out["other"].append(int(key[2, a]))
                        out["pieces"].append(most)
                        out["tokens"].append(token[at].tobytes())
                        out["hot"].append(np.packbits(hot[at]).tobytes())
                        out["runs"].append(_planes(np.diff(who, append=len(at))))
                        out["facts"].append(_planes(facts[:, row[at][who]].ravel()))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table(out, schema=pa.schema(list(zip(out, kinds))))

    return run


_FOUND = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("cands", pa.binary())])


def _pairs_of_lists(table: pa.Table) -> pa.Table:
    """Pairs of different components in the lists of a block, by query: partner, its size, lists that hold both, and hot lists that may."""
    piece, other, pieces = (table.column(k)[0].as_py() for k in ("piece", "other", "pieces"))
    token = _column(table, "tokens", _u64)
    hot = np.concatenate([np.unpackbits(np.frombuffer(h.as_buffer(), dtype=np.uint8), count=len(t.as_buffer()) // 8) for h, t in zip(table.column("hot"), table.column("tokens"))]).astype(bool)
    info = np.concatenate([np.repeat(_numbers(f.as_buffer()).reshape(len(_FACTS), -1), _numbers(r.as_buffer()), axis=1) for f, r in zip(table.column("facts"), table.column("runs"))], axis=1)
    order = np.lexsort((info[0], token))
    token, hot, info = token[order], hot[order], info[:, order]
    start = _runs(token)
    size = np.diff(start, append=len(token))
    # element k of a list meets the k elements before it
    nth = np.arange(len(token)) - np.repeat(start, size)
    doc, comp, n, hots, kind = info
    found: list[tuple[np.ndarray, ...]] = []
    total = np.cumsum(nth)
    at = 0
    while at < len(token):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 500_000, side="right")))
        x = np.repeat(np.arange(at, to), nth[at:to])
        y = x - 1 - (np.arange(len(x)) - np.repeat(np.cumsum(nth[at:to]) - nth[at:to], nth[at:to]))
        ok = (comp[x] != comp[y]) & (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y]))
        # two documents with kinds meet in hot lists unless they are of one kind
        apart = (kind[x] != 0) & (kind[y] != 0) & (kind[x] != kind[y])
        ok &= ~hot[x] | apart
        if pieces > 1:
            ok &= (np.minimum(doc[x] % pieces, doc[y] % pieces) == piece) & (np.maximum(doc[x] % pieces, doc[y] % pieces) == other)
        x, y, apart = x[ok], y[ok], apart[ok]
        found.append(_counted(doc[x], n[x], doc[y], n[y], np.ones(len(x), dtype=np.int64), np.where(apart, 0, np.minimum(hots[x], hots[y]))))
        if sum(len(f[0]) for f in found[1:]) > 500_000:
            found = [_counted(*(np.concatenate(c) for c in zip(*found)))]
        at = to
    q, size, p, m, hits, room = _counted(*(np.concatenate(c) for c in zip(*found))) if found else [np.empty(0, dtype=np.int64)] * 6
    cuts = np.append(_runs(q), len(q))
    out = {"q": q[cuts[:-1]], "n": size[cuts[:-1]], "cands": [_planes(np.concatenate([v[a:b] for v in (p, m, hits, room)])) for a, b in zip(cuts[:-1], cuts[1:])]}
    return pa.table(out, schema=_FOUND)


def _counted(q, n, p, m, hits, room) -> tuple[np.ndarray, ...]:
    """One row for each query and partner, in order."""
    order = np.lexsort((p, q))
    q, n, p, m, hits, room = (v[order] for v in (q, n, p, m, hits, room))
    start = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (p[1:] != p[:-1])])) if len(q) else np.empty(0, dtype=np.int64)
    return q[start], n[start], p[start], m[start], np.add.reduceat(hits, start) if len(q) else hits, room[start]


def merge_lists(n: int, lists: list[np.ndarray]) -> Iterator[int]:
    """T-occurrence search for a query of n shingles: heap-merges its short lists and gives the partners that occur often enough.

    A list (sorted by partner) has partner, its size, how many of the lists that it
    stands for hold it, and how many hot lists may hold it and are not merged.
    """
    now, hits, least = None, 0, 0
    for partner, m, count, room in heapq.merge(*(zip(*x.tolist()) for x in lists)):
        if partner != now:
            if now is not None and hits >= least:
                yield now
            now, hits, least = partner, 0, occurrences(n, m) - room
        hits += count
    if now is not None and hits >= least:
        yield now


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs ``merge_lists`` for each query of rows q, n, cands that are sorted by q."""
    now, size, lists = None, 0, []
    for batch in batches:
        found = []
        for q, n, cands in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if q != now:
                found.extend((now, p) for p in merge_lists(size, lists))
                now, size, lists = q, n, []
            lists.append(_numbers(cands.as_buffer()).reshape(4, -1))
        yield _two(found)
    yield _two([(now, p) for p in merge_lists(size, lists)])


def _stars(index: DataFrame) -> DataFrame:
    """Links of documents of one kind: they share all hot shingles, so a star around the smallest connects those that this alone links."""
    of = index.filter("kind is not null").select("kind", "doc_id", "n", "hot_size")
    hubs = of.groupBy("kind").agg(F.min(F.struct("n", "doc_id")).alias("hub"), F.count("*").alias("rows")).filter("rows > 1")
    hubs, _ = _sized(settled(hubs.select("kind", "hub")))
    return of.join(hubs, "kind").filter("doc_id <> hub.doc_id and 7 * hot_size >= 3 * (n + hub.n)").select(F.col("doc_id").alias("a"), F.col("hub.doc_id").alias("b"))


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures of ``docs(doc_id, text)``, and links ``a, b`` that connect what similarity links connect.

    The links are those between copies, and links between different sets of which a
    pair already connected by others may be left out.
    """
    sig = settled(signatures(docs))
    real = sig.filter("doc_id is not null and n > 0")
    same = real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    repeated, _ = _sized(settled(same.filter("copies > 1")))
    copies = settled(real.select("doc_id", "digest").join(repeated, "digest").filter("doc_id > rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), "digest"))
    others, _ = _sized(copies.select(F.col("a").alias("doc_id")))
    reps = real.join(others, "doc_id", "left_anti")
    # a head is left out where its task had it already, from a copy with a larger doc_id
    lost = settled(reps.filter("head is null").select("doc_id", "n", "digest"))
    heads = reps.filter("head is not null").select("doc_id", "n", "head")
    if not lost.isEmpty():
        digests, _ = _sized(lost.select("digest"))
        found = real.filter("head is not null").join(digests, "digest", "left_semi").groupBy("digest").agg(F.first("head").alias("head"))
        heads = heads.unionByName(lost.join(found, "digest").select("doc_id", "n", "head"))
    copies = copies.select("a", "b")
    total = heads.agg(F.sum(F.length("head"))).first()[0] or 0
    reaching, few = _sized(settled(_reaching(heads, total // 6)))
    texts = docs.select("doc_id", "text").join(reaching, "doc_id", "left_semi")
    buckets = settled(buckets_of(texts))
    total = buckets.agg(F.sum(F.length("tokens"))).first()[0] or 0
    if not total:
        return sig, copies
    blocks = max(8, total // 8 // BLOCK)
    facts = _list_facts(buckets.withColumn("values", F.col("ids")), blocks)
    schema = "doc_id long, n long, leaders array<long>, tokens binary, hot binary, kind binary, hot_size long"
    index = settled(buckets.groupBy("bucket").cogroup(facts.groupBy("bucket")).applyInArrow(_index, schema))
    first = settled(_probed(index.filter("size(leaders) > 0").select(F.col("doc_id").alias("a"), F.col("leaders")[0].alias("b")), buckets))
    led, _ = _sized(first.select(F.col("a").alias("doc_id")))
    rest = index.filter("size(leaders) > 1").join(led, "doc_id", "left_anti").select(F.col("doc_id").alias("a"), F.explode(F.slice("leaders", 2, LEADERS)).alias("b"))
    near = settled(first.unionByName(_probed(rest, buckets)).unionByName(_stars(index)))
    comps, _ = _sized(settled(components(near).withColumnRenamed("node", "doc_id")))
    # the number of a kind only keeps apart; equal numbers of different kinds would leave out pairs, so it is of 63 bits
    number = F.when(F.col("kind").isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64("kind"), 1) + 1)
    posted = index.join(comps, "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).withColumn("kind", number)
    postings = settled(_posting_buckets(posted))
    mixed = _list_facts(postings, blocks)
    lists = postings.groupBy("bucket").cogroup(mixed.groupBy("bucket")).applyInArrow(_postings(blocks), _LISTS)
    found = lists.groupBy("block", "piece", "other", "pieces").applyInArrow(_pairs_of_lists, "q long, n long, cands binary")
    pairs = found.repartition("q").sortWithinPartitions("q").mapInArrow(_merge, "a long, b long")
    return sig, copies.unionByName(near).unionByName(_probed(pairs, buckets))


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document of ``docs(doc_id, text)``.

    Null text counts as empty; a text without words has no shingles and links with
    nothing. A null doc_id stays out of the linking and gets a null component. Rows that
    share a doc_id are one document, with the greatest of their texts; extra columns are
    not looked at, and an empty table gives an empty result.
    """
    docs = one_row_each(docs)
    sig, links = jaccard_links(docs)
    comps = components(links)
    return (
        sig.select("doc_id", F.col("n").alias("n_shingles"))
        .join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def one_row_each(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the greatest text of each doc_id that repeats."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = docs.groupBy("doc_id").count().filter("count > 1")
    return docs if repeated.isEmpty() else docs.groupBy("doc_id").agg(F.max("text").alias("text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: that with the smallest doc_id.

    Documents without words and rows of a null doc_id stay. Of rows that share a doc_id
    one stays, with the greatest text.
    """
    once = docs
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        best = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
        once = settled(docs.filter("doc_id is null").unionByName(best))
    gone = ngram_components(once).filter("component_id <> doc_id").select("doc_id")
    return once.join(_sized(settled(gone))[0], "doc_id", "left_anti").select(*docs.columns)

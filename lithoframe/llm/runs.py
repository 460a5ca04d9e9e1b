"""Periodic runs of words by bit-parallel lags.

Each text's distinct words are numbered, and the numbers are kept as bit planes: big
integers with a bit for each word. For a lag q every plane is XORed with itself shifted by
q, and the results are ORed: a zero stands where a word equals the one q further on. ANDs
of the matches with themselves, shifted by doubling distances, leave the starts of zero
stretches that are long enough. A stretch that a smaller lag has found too isn't q's.

A lag costs a pass over the planes, so that a text of n words costs n * n / 60 steps of a
machine word. Texts of more than ``WHOLE`` bytes have their lags cut into bands of equal
work, as many as the text has times ``WHOLE``, which are rows of their own; their runs meet
again as one list for each text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a run has at least; and periods.
LEAST, TIMES = 12, 2
WHOLE = 1 << 19
#: Planes looked at before a lag is given up; the others only where something is left.
_FIRST = 4
_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_SUMMARY = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planes(words: list[bytes]) -> list[int]:
    """The bit planes of the words' numbers, in which bit i belongs to word i."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint32, count=len(words))
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(max(len(numbers) - 1, 0).bit_length())]


def _bits(x: int) -> np.ndarray:
    """Places of the bits set."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), dtype=np.uint8), bitorder="little"))


def _stretches(match: int, least: int) -> int:
    """Places from which at least ``least`` bits of ``match`` in a row are set."""
    have = 1
    while match and have < least:
        step = min(have, least - have)
        match &= match >> step
        have += step
    return match


def lag_runs(bits: list[int], n: int, lags: range, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """start, length and lag of all stretches of words that are ``lag`` apart equal and are long enough; ``bits`` are the planes of n words."""
    full = (1 << n) - 1
    first, rest = bits[:_FIRST], bits[_FIRST:]
    for q in lags:
        need = max(least - q, (times - 1) * q)
        mask = full >> q
        differ = 0
        for p in first:
            differ |= p ^ (p >> q)
        match = (differ & mask) ^ mask
        found = _stretches(match, need)
        if found and rest:
            for p in rest:
                differ |= p ^ (p >> q)
            found = _stretches((differ & mask) ^ mask, need)
        if found:
            starts, ends = _bits(found & ~(found << 1)), _bits(found & ~(found >> 1))
            for a, b in zip(starts.tolist(), ends.tolist()):
                yield a, b - a + need + q, q


def smallest(found: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs by start, then period: of equal stretches that with the smallest lag, which is their period."""
    period: dict[tuple[int, int], int] = {}
    for start, length, q in found:
        period[start, length] = min(q, period.get((start, length), q))
    return sorted(((s, n, q) for (s, n), q in period.items()), key=lambda r: (r[0], r[2]))


def most_lag(n: int, times: int = TIMES) -> int:
    return n // times


def rewritten(words: list[bytes], h: int | None) -> list[bytes]:
    """``words`` with a periodic tail where the hash says so (one in ten)."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what any run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def _words(text: str | None, h: int | None) -> list[bytes]:
    # bytes.split() cuts at space and 0x09 to 0x0D only
    return rewritten(text.encode().split(), h) if text else []


def _summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    longest = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
    if longest is None:
        return 0, None, None, None, None, listed, kept
    start, length, q = longest
    return len(runs), start, length, q, 1000 * length // q, listed, kept


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType], *before: pa.Array) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([*before, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)


_KINDS = [*[pa.int64()] * 5, pa.string(), pa.string()]
_NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_RUN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def planted(doc_id: Column) -> Column:
    """The hash that says whether and how a text gets a periodic tail."""
    return F.crc32(doc_id.cast("string"))


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Column | None = None, least: int = LEAST, times: int = TIMES, whole: int = WHOLE) -> DataFrame:
    """``key``, words (those left after collapsing, joined by a space), runs (by start, then period) and n_words of each row.

    A run is a stretch of words of smallest period q, with ``least`` words and ``times``
    periods at least, that neither neighbour extends. Words are runs of anything but
    ASCII white space and count as they are written. ``rewrite`` is a hash by which texts
    get a periodic tail first (null: as they are). Null and empty texts have no words and
    no runs; rows that repeat, or share a key or have none, give a row each. Other columns
    are not looked at. Texts are taken whole whatever their length.
    """
    return _found(docs, key, text, rewrite, least, times, whole, False)


def summaries(docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Column | None = None, whole: int = WHOLE) -> DataFrame:
    """As ``find_runs``, but for the runs and words of a row: their number, the longest one (ties: smallest start, then period) and digests."""
    return _found(docs, key, text, rewrite, LEAST, TIMES, whole, True)


def _found(docs: DataFrame, key: str, text: str, rewrite: Column | None, least: int, times: int, whole: int, brief: bool) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), (rewrite if rewrite is not None else F.lit(None)).cast("long").alias("__hash"))
    names, kinds = (_NAMES, _KINDS) if brief else (["words", "runs", "n_words"], [pa.string(), _RUN_LIST, pa.int64()])
    schema = f"`{key}` {kind}, " + (_SUMMARY if brief else f"words string, runs array<{_RUN}>, n_words long")

    def ended(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        if brief:
            return _summary(words, runs)
        return b" ".join(collapsed(words, runs)).decode(), [dict(zip(("start", "length", "period"), r)) for r in runs], len(words)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, h in zip(batch.column(1), batch.column(2)):
                words = _words(t.as_py(), h.as_py())
                rows.append(ended(words, smallest(lag_runs(planes(words), len(words), range(1, most_lag(len(words), times) + 1), least, times))))
            yield _table(rows, [key, *names], kinds, batch.column(0))

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, t, h, nth, bands in ((x.as_py() for x in r) for r in zip(*batch.columns)):
                words = _words(t, h)
                # a lag's work is the number of words that it compares: from n down to n / times
                top = most_lag(len(words), times)
                cuts = [len(words) - math.sqrt(len(words) ** 2 - k / bands * (len(words) ** 2 - (len(words) - top) ** 2)) for k in (nth, nth + 1)]
                to = top if nth + 1 == bands else int(cuts[1])
                runs = lag_runs(planes(words), len(words), range(int(cuts[0]) + 1, to + 1), least, times)
                rows.extend((row, *r) for r in runs)
            yield _table(rows, ["__row", "start", "length", "period"], [pa.string(), *[pa.int64()] * 3])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, h, runs in zip(*(batch.column(c) for c in (1, 2, 3))):
                rows.append(ended(_words(t.as_py(), h.as_py()), smallest((r["start"], r["length"], r["period"]) for r in runs.as_py())))
            yield _table(rows, [key, *names], kinds, batch.column(0))

    size = F.coalesce(F.octet_length("__text"), F.lit(0))
    short = given.filter(size <= whole).mapInArrow(at_once, schema)
    # equal texts with equal hashes have equal runs
    long = given.filter(size > whole).withColumn("__row", F.concat_ws(" ", F.sha2("__text", 256), "__hash"))
    bands = F.ceil(size / whole).cast("int")
    # a given number, as adaptive execution would join tasks that are small in bytes but not in work
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = long.dropDuplicates(["__row"]).withColumn("bands", bands).withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    spread = each.select("__row", "__text", "__hash", "nth", "bands").repartition(tasks, "__row", "nth")
    runs = spread.mapInArrow(band, "__row string, start long, length long, period long").groupBy("__row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    ends = long.join(runs, "__row", "left").select("__key", "__text", "__hash", F.coalesce("runs", F.array().cast(f"array<{_RUN}>")).alias("runs"))
    return short.unionByName(ends.mapInArrow(joined, schema))

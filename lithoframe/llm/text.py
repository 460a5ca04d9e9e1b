"""Vectorised word hashing shared by the shingle operators.

Whole texts are hashed inside a task with numpy: every byte gets a random 64-bit value, a
running sum weighted by powers of an odd base gives the hash of any byte range, and a
finalising mix breaks up the structure of the sum. A batch costs a fixed number of
passes over its bytes and no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_CHUNK = 1 << 18
#: Bytes of text that a task works on, and hands back, at once.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LANES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation, for matching that should not depend on punctuation.
LOOSE = SPACE.copy()
LOOSE[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 4096)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hash_block(data: np.ndarray, docs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data``, and their start offsets; ``docs`` are offsets at which a word is cut."""
    n = len(data)
    solid = ~separators[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    docs = docs[docs < n]
    start[docs] = solid[docs]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | start[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _power_table(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    values = _BYTE_LOWER[data]
    values *= up[:n]
    np.cumsum(values, out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * _LANES[0]), starts


def word_hashes(data: np.ndarray, separators: np.ndarray = SPACE) -> np.ndarray:
    """Hashes of all words of one text, given as bytes; long texts go in pieces cut at separators."""
    out, at, n = [], 0, len(data)
    while at < n:
        to = min(n, at + _CHUNK)
        while to < n:
            cut = np.flatnonzero(separators[data[to : to + 4096]])
            if len(cut):
                to += int(cut[0])
                break
            to = min(n, to + 4096)
        out.append(_hash_block(data[at:to], np.zeros(1, dtype=np.int64), separators)[0])
        at = to
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def pieces(batches: Iterator[pa.RecordBatch], at: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``most`` bytes in column ``at``, or one row that has more.

    What a task makes of a batch, and hands back at once, then doesn't grow with the
    batch that it was sent.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
        row, before = 0, 0
        while row < len(ends):
            last = max(row + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(row, last - row)
            row, before = last, int(ends[last - 1])


def words_by_row(column: pa.Array, separators: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """For each row of a string column the hashes of its words in order; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from words_by_row(chunk, separators)
        return
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < n:
        if offsets[row + 1] - offsets[row] > _CHUNK:
            yield word_hashes(data[offsets[row] : offsets[row + 1]], separators)
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _CHUNK, side="right")) - 1)
        cuts = offsets[row : last + 1] - offsets[row]
        if cuts[-1] == 0:
            for _ in range(row, last):
                yield np.empty(0, dtype=np.uint64)
        else:
            hashes, starts = _hash_block(data[offsets[row] : offsets[last]], cuts[:-1], separators)
            bounds = np.searchsorted(starts, cuts)
            for k in range(last - row):
                yield hashes[bounds[k] : bounds[k + 1]]
        row = last


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in order; a shorter text is one run, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        lanes = _lanes(n)
        return mix(np.array([(words * lanes).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
    lanes = _lanes(size)
    out = words[: n - size + 1] * lanes[0]
    for j in range(1, size):
        out += words[j : n - size + 1 + j] * lanes[j]
    return mix(out)


def _lanes(size: int) -> np.ndarray:
    if size <= len(_LANES):
        return _LANES[:size]
    more = mix(np.arange(1, size - len(_LANES) + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    return np.concatenate([_LANES, more])

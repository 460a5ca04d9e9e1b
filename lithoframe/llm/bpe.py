"""Byte-level BPE by DuckDB's recursive queries, one engine in each Python worker.

Texts are split by the tokenizer's pattern. Each task keeps the words that it meets for
the first time as rows (word, position, token), one for each byte, and joins neighbours
with the merge table; the recursive query contracts every word's leftmost pair of least
rank until none is left. A word that is a token itself is that token. Ids go back to bytes
by the ordered aggregate of their tokens.

Only the vocabulary is sent to the tasks, whose size doesn't depend on the data. A worker
remembers at most ``KNOWN_WORDS`` words, then starts over; texts are taken in slices of
``SLICE`` bytes, longer ones in pieces cut where white space begins, where a match of the
pattern always ends.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 4 << 20
KNOWN_WORDS = 1_000_000
#: Words of more bytes have all equal pairs contracted in one step where the order makes no difference.
LONG = 48
#: Unicode's white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ESCAPE = regex.compile(r"\\p\{[LN]\}|\\[sS]")
_CLASS = regex.compile(r"\[(?:\\.|[^\]\\])*\]|" + _ESCAPE.pattern)
_LAST_SPACE = r"|\s+(?!\S)"
#: A non-character that stands before the last white space of a run; texts with it are split by the other engine.
_MARK = "﷐"
_CUT = regex.compile(f"[^{_SPACE}][{_SPACE}]")

_STEP = """
with recursive step(k, id, settled) as (
    select (w << 32) | (n - 1), b.id, false from long_or_short p, range(1, octet_length(p.b) + 1) g(n) join bytes b on b.h = hex(p.b)[2 * n - 1:2 * n]
    union all
    select k, id, settled from (
        with pairs as (
            select k, id, lead(id) over (order by k) as next_id, lead(k) over (order by k) as next_k, row_number() over (order by k) as nth
            from step where not settled),
        ranked as (select p.k, p.id, p.next_k, p.nth, m.m, m.free from pairs p left join merges m on m.l = p.id and m.r = p.next_id and p.next_k >> 32 = p.k >> 32),
        best as (select k >> 32 as w, min(m) as m, min(struct_pack(m := m, k := k, next_k := next_k)) filter (m is not null) as at from ranked group by 1)
        {contracted}))
select k >> 32 as w, list(id order by k)::integer[] as ids from step where settled group by 1
"""
_LEFTMOST = """
        select r.k, case when r.k = b.at.k then b.m else r.id end as id, b.m is null as settled
        from ranked r join best b on b.w = r.k >> 32 where r.k is distinct from b.at.next_k"""
# pairs that overlap are those of equal tokens: of each row of them every other one counts
_ALL_EQUAL = """
        , hits as (select r.*, r.nth - row_number() over (order by r.nth) as isle from ranked r join best b on b.w = r.k >> 32 and b.m = r.m where r.free or r.k = b.at.k),
        taken as (select * from (select *, row_number() over (partition by isle order by nth) as place from hits) where place % 2 = 1)
        select r.k, coalesce(t.m, r.id) as id, b.m is null as settled
        from ranked r join best b on b.w = r.k >> 32 left join taken t on t.k = r.k anti join taken e on e.next_k = r.k"""


def read_ranks(path: str) -> list[tuple[int, bytes]]:
    """Id and bytes of each token of a rank file: a line holds base64 and the rank."""
    with open(path, "rb") as lines:
        return [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]


def _ranges(points: list[str]) -> str:
    found: list[list[int]] = []
    for c in map(ord, points):
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in found)


@cache
def classes() -> tuple[str, str]:
    """What the tokenizer's library takes for letters and for numbers, as ranges; its tables are of another version of Unicode than RE2's or Python's, so it is asked for each code point."""
    single = [bytes([b]) for b in range(256)]
    ranks = {b: k for k, b in enumerate([*single, *(b"a" + b for b in single), *(b"1" + b for b in single)])}
    own = tiktoken.Encoding("classes", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]", mergeable_ranks=ranks, special_tokens={})
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]

    def with_lead(lead: str) -> list[str]:
        """Those that make one match with ``lead``, whose byte is then one token with the next."""
        ids = np.array(own.encode_ordinary("".join(f"!{lead}{c}" for c in points)))
        begins = np.concatenate([[0], np.cumsum(np.where(ids < 256, 1, 2))])[:-1]
        sizes = np.array([len(c.encode()) + 2 for c in points])
        at = np.searchsorted(begins, np.cumsum(sizes) - sizes + 1)
        return [c for c, joined in zip(points, ids[at] >= 256) if joined]

    return _ranges(with_lead("a")), _ranges(with_lead("1"))


def spelled_out(pattern: str, letters: str, numbers: str) -> str:
    """``pattern`` with its classes of letters, numbers and white space as ranges of characters."""
    ranges = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": _SPACE, r"\S": "^" + _SPACE}
    return _CLASS.sub(lambda m: _ESCAPE.sub(lambda e: ranges[e[0]], m[0]) if m[0].startswith("[") else f"[{ranges[m[0]]}]", pattern)


def for_re2(pattern: str) -> str | None:
    """``pattern`` without its lookahead ``\\s+(?!\\S)``, which RE2 lacks and a mark in the text stands for; None if it has others or none."""
    plain = pattern.replace(_LAST_SPACE, "", 1)
    if "(?" in plain or plain == pattern or r"[^\s" not in plain or not plain.endswith(r"|\s+"):
        return None
    return plain.replace(r"[^\s", rf"[^{_MARK}\s")


class Engine:
    """The vocabulary and the words met so far in one DuckDB connection."""

    def __init__(self, tokens: list[tuple[int, bytes]], pattern: str, letters: str, numbers: str, known_words: int = KNOWN_WORDS) -> None:
        plain = for_re2(pattern)
        self.pattern, self.re2 = regex.compile(spelled_out(pattern, letters, numbers)), plain and spelled_out(plain, letters, numbers)
        self.known_words = known_words
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.db.register("given", pa.table({"id": pa.array([t for t, _ in tokens], pa.int32()), "b": pa.array([b for _, b in tokens], pa.binary())}))
        self.db.execute("create table tokens as select id, b, hex(b) as h from given")
        self.db.execute("create table bytes as select id, h from tokens where length(h) = 2")
        self.db.execute("""create table merges as
            with halves as (select id, h[:2 * n] as l, h[2 * n + 1:] as r from tokens, range(1, length(h) // 2) g(n)),
            found as (select a.id as l, b.id as r, s.id as m from halves s join tokens a on a.h = s.l join tokens b on b.h = s.r)
            select *, m not in (select l from found where m < l union all select r from found where m < r) as free from found""")
        # at id + 1; an id that no token has stands for nothing, as does the place after the last
        self.end = max(t for t, _ in tokens) + 1
        self.db.execute(f"set variable spelled = (select list(coalesce(h, '') order by n) from range(0, {self.end + 1}) g(n) left join tokens on id = n)")
        self.forget()

    def forget(self) -> None:
        self.db.execute("create or replace table known (b blob, ids integer[])")
        self.known = 0

    def words(self, texts: pa.Array) -> pa.ListArray:
        """The matches of the pattern in each text."""
        texts = texts.cast(pa.string())
        if self.re2 is None or pc.any(pc.match_substring(texts, _MARK)).as_py():
            return pa.array([self.pattern.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        self.db.register("texts", pa.table({"t": texts}))
        # the order of the rows is kept: the query has one thread and neither joins nor groups
        found = self.db.sql(
            "select regexp_extract_all(regexp_replace(t, $last, $marked, 'g'), $pattern) as words from texts",
            params={"last": f"([{_SPACE}]+)([{_SPACE}][^{_SPACE}])", "marked": f"\\1{_MARK}\\2", "pattern": self.re2},
        ).to_arrow_table()
        return found.column(0).combine_chunks()

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and where each one's begin (and the last one's end)."""
        if self.known > self.known_words:
            self.forget()
        self.db.register("asked", pa.table({"w": pa.array(np.arange(len(words)), pa.int64()), "b": words.cast(pa.binary())}))
        self.db.execute("create or replace temp table fresh as select w, b from asked anti join known using (b)")
        self.db.execute("insert into known select b, [id] from fresh join tokens using (b)")
        for test, contracted in (("<=", _LEFTMOST), (">", _ALL_EQUAL)):
            self.db.execute(f"create or replace temp table long_or_short as select w, b from fresh anti join tokens using (b) where octet_length(b) {test} {LONG}")
            self.db.execute(f"insert into known select b, ids from ({_STEP.format(contracted=contracted)}) join long_or_short using (w)")
        self.known = self.db.sql("select count(*) from known").fetchall()[0][0]
        found = self.db.sql("select ids from asked join known using (b) order by w").to_arrow_table().column(0).combine_chunks()
        return np.asarray(found.flatten()), np.concatenate([[0], np.cumsum(np.asarray(found.value_lengths(), dtype=np.int64))])

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Token ids of each text (null: none)."""
        words = self.words(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        flat, starts = self.ids_of(coded.dictionary)
        at = np.asarray(coded.indices, dtype=np.int64)
        ends = np.cumsum(starts[at + 1] - starts[at])
        total = int(ends[-1]) if len(ends) else 0
        lengths = starts[at + 1] - starts[at]
        ids = flat[np.arange(total) + np.repeat(starts[at] - (ends - lengths), lengths)]
        by_word = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum(np.asarray(words.value_lengths(), dtype=np.int64))])
        return pa.ListArray.from_arrays(pa.array(by_word[bounds], pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids."""
        self.db.register("lists", pa.table({"ids": ids}))
        spelled = f"list_select(getvariable('spelled'), list_transform(ids, lambda x: case when x between 0 and {self.end} then x + 1 else {self.end + 1} end))"
        found = self.db.sql(f"select coalesce(unhex(list_aggregate({spelled}, 'string_agg', '')), ''::blob) as b from lists").to_arrow_table()
        return found.column(0).combine_chunks().cast(pa.binary())


_engines: dict[tuple, Engine] = {}


def _engine(vocabulary: Broadcast, pattern: str) -> Engine:
    key = (vocabulary.value[0], pattern)
    if key not in _engines:
        _engines.clear()
        _engines[key] = Engine(vocabulary.value[1], pattern, *vocabulary.value[2])
    return _engines[key]


def _pieces(text: str, size: int) -> Iterator[str]:
    """Pieces of at least ``size`` characters, if there is white space to cut at."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows with about ``size`` bytes."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to


def _encoded(engine: Engine, texts: pa.Array) -> pa.ListArray:
    if len(texts) == 1 and texts[0].is_valid and len(texts[0].as_py()) > SLICE:
        parts = [engine.encode(pa.array([p], pa.string())).flatten() for p in _pieces(texts[0].as_py(), SLICE)]
        ids = pa.concat_arrays(parts)
        return pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return engine.encode(texts)


def _vocabulary(df: DataFrame, path: str) -> Broadcast:
    """Token list of one file for all tasks: as large as the vocabulary, whatever the data."""
    return df.sparkSession.sparkContext.broadcast((path, read_ranks(path), classes()))


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", restore: bool = False) -> DataFrame:
    """``key`` and ids (array of int) of every row, by the rank file at ``path``, without special tokens; with ``restore`` also decoded, the bytes that the ids stand for.

    Null and empty texts have no ids. Rows that repeat or share a key give a row each,
    null keys too; an empty table gives an empty result; other columns are not looked at,
    whatever their names. Texts of any length are taken whole; a word of n bytes without
    anything to split it takes up to n steps.
    """
    vocabulary = _vocabulary(docs, path)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>" + (", decoded binary" if restore else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            engine = _engine(vocabulary, pattern)
            for at, to in _slices(batch.column(1), SLICE):
                ids = _encoded(engine, batch.column(1)[at:to])
                columns = [batch.column(0)[at:to], ids] + ([engine.decode(ids)] if restore else [])
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "decoded"][: len(columns)])

    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and decoded (binary) of every list of ids; a null list gives no bytes, as does an id, also null, that is no token's."""
    vocabulary = _vocabulary(coded, path)
    kind = coded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _engine(vocabulary, ".").decode(batch.column(1))], names=[key, "decoded"])

    return coded.select(key, F.col(ids).cast("array<int>").alias("__ids")).mapInArrow(run, f"`{key}` {kind}, decoded binary")


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of rows with ids and decoded: how many ids, and the digests of the ids (decimal, joined by commas) and of the bytes."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""WARC archives: a writer with payload deduplication and a splittable reader.

Every record is a gzip member of its own. Read tasks get byte ranges of the archives:
each looks for gzip magic in its range, validates a candidate by decoding the start of
its member (which must be a WARC header) and owns the records that start in the range,
following the last one beyond its end. Archives are written under names of their own by
each attempt of a task, and only those that a finished task reports are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm.storage import settled, shared_folder

#: Payloads shorter than this are always stored.
LEAST_BYTES = 100
#: Bytes of an archive that one read task looks for records in.
SPLIT_BYTES = 4 << 20
#: Rows of a table of digests that is sent to all tasks.
SENT_ROWS = 100_000
#: Read tasks at most; with more ranges a task reads several.
TASKS = 20_000
_READ = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the WARC 1.1 format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sized(table: DataFrame) -> DataFrame:
    """``table``, to be sent to all tasks if it has at most ``SENT_ROWS`` rows (it is counted)."""
    table = settled(table)
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for a stored record) of each page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.filter((F.length("payload") >= LEAST_BYTES) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    # where the digests that repeat are few, they go to the pages; otherwise the pages go to them
    joined = rows.join(_sized(first), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member: a response with its payload, or a revisit without."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {_DATE}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http.encode() + (b"\r\n" if payload is None else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages(page_id, url, payload, digest, refers_to)`` and returns path, size and records of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name, size, count, out = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                out = out or files.open_output_stream(f"{root}/{name}", compression=None)
                data = record(*row)
                out.write(data)
                size, count = size + len(data), count + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [size], "records": [count]})

    return settled(pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, size long, records long"))


def archives(spark: SparkSession, glob: str) -> DataFrame:
    """path and size of the archives that match a path or glob; the files themselves are not read."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("size"))


class _Range:
    """Bytes of a file from an offset on, read in pieces as they are asked for."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.held = file, at, b""

    def more(self) -> bool:
        got = self.file.read_at(_READ, self.at + len(self.held)) if self.at + len(self.held) < self.file.size() else b""
        self.held += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.at, self.held = self.at + n, self.held[n:]


def _is_record(window: _Range) -> bool:
    while len(window.held) < 1024 and window.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(window.held[:1024], 7) == b"WARC/1."
    except zlib.error:
        return False


def _member(window: _Range) -> bytes:
    """The whole member at the window's start, its checksum verified; the window moves behind it."""
    unpack, out, fed = zlib.decompressobj(31), [], 0
    while not unpack.eof:
        if fed == len(window.held) and not window.more():
            raise ValueError("an archive ends inside a record")
        part = window.held[fed:]
        out.append(unpack.decompress(part))
        fed = len(window.held) - len(unpack.unused_data)
    window.skip(fed)
    return b"".join(out)


def records_in(file, start: int, end: int) -> Iterator[bytes]:
    """The records whose members start from ``start`` up to before ``end``."""
    window = _Range(file, start)
    while window.at < end:
        at = window.held.find(_MAGIC)
        if at < 0:
            window.skip(max(0, len(window.held) - 2))
            if not window.more():
                return
            continue
        window.skip(at)
        if window.at >= end:
            return
        if _is_record(window):
            yield _member(window)
        else:
            window.skip(1)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the payload: of an HTTP response what follows its header, else the whole block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t"):  # a folded line goes on
            fields[last] += " " + line.strip()
            continue
        last, _, value = line.partition(":")
        last = last.strip().lower()
        fields[last] = value.strip()
    block = rest[: int(fields.get("content-length", len(rest)))]
    http = fields.get("content-type", "").lower().startswith("application/http")
    return fields, block.partition(b"\r\n\r\n")[2] if http else block


_OWN = re.compile(r"<urn:page:([0-9-]+)>")
_SHOWN = "record_id string, page_id long, url string, record_type string, refers_to_id string, refers_to long, header_digest string, payload binary, payload_digest string"


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each record, of any type, of ``files(path, size)``.

    record_id and refers_to_id are as written; page_id and refers_to are the numbers in
    ids that ``write`` made, null in others. Revisits have no payload and payload_digest,
    the hexadecimal SHA-256 of what was read; header_digest is what the header says. A
    missing field is null.
    """
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    count = files.agg(F.sum(F.ceil(F.greatest("size", F.lit(1)) / split_bytes))).first()[0] or 1
    # a range is a row of few bytes, but work for a task: the number of tasks is given, lest they be put together
    ranges = ranges.repartition(int(min(count, TASKS)), "path", "start")
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in _SHOWN.split(", ")]

    def number(ident: str | None) -> int | None:
        own = _OWN.fullmatch(ident or "")
        return int(own[1]) if own else None

    def row(data: bytes) -> tuple:
        fields, payload = parse(data)
        ids = [fields.get(k) for k in ("warc-record-id", "warc-refers-to")]
        kind = fields.get("warc-type")
        stored = kind != "revisit"
        said = fields.get("warc-payload-digest")
        return (
            ids[0], number(ids[0]), fields.get("warc-target-uri"), kind, ids[1], number(ids[1]), said and said.removeprefix("sha256:"),
            payload if stored else None, hashlib.sha256(payload).hexdigest() if stored else None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, at = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with files.open_input_file(at) as file:
                    for data in records_in(file, start, start + split_bytes):
                        rows.append(row(data))
                        held += len(data)
                        if held > 16 << 20:
                            yield made(rows)
                            rows, held = [], 0
                yield made(rows)

    return ranges.mapInArrow(run, _SHOWN)


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes ``pages(page_id, url, html)``, reads the archives back and gives payload_bytes, payload_digest, record_type and refers_to of each page.

    Null html is an empty payload; of pages with equal payloads of 100 bytes or more,
    the one with the smallest page_id (every row that has it) is stored, and the others
    refer to it. A null page_id never is the stored one unless its payload has no other.
    A null url is left out of the record; extra columns are not looked at; an empty
    table gives no archive and no rows.
    """
    spark = pages.sparkSession
    found = write(with_revisits(pages), shared_folder(spark))
    # digests are of what was read; a revisit takes them from the record it refers to
    records = settled(read(found, split_bytes).withColumn("payload_bytes", F.length("payload").cast("long")).drop("payload", "url"))
    stored = records.filter("record_type = 'response'")
    again = records.filter("record_type = 'revisit'").drop("payload_digest", "payload_bytes")
    wanted = _sized(again.select(F.col("refers_to").alias("page_id")).distinct())
    origin = stored.join(wanted, "page_id", "left_semi").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    origin = _sized(origin)
    again = again.join(origin, (again.refers_to == origin.refers_to) & (again.header_digest == origin.payload_digest)).drop(origin.refers_to)
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return stored.select(*out).unionByName(again.select(*out))


ORACLE_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {LEAST_BYTES} and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {LEAST_BYTES} and page_id <> first then first end as refers_to
from f
"""

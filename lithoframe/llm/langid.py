"""Language identification by Bayesian evidence fusion.

The posterior of a language multiplies four kinds of evidence: the text's likelihood
under byte-trigram models, the language declared in markup or metadata, the address
suffix, and a prior of the host. Host priors are smoothed hierarchically: a host's
counts lean on its domain's, a domain's on those of all rows. Counts, and how far
declarations and suffixes can be trusted, come from grouped aggregation over all rows,
with each row's language taken from its text alone. Only the trigram models are fitted
on a sample: ``SAMPLE`` labelled rows of each language at most. Every label that occurs
has a model; labels are compared in lower case, by their language without region. Models
are fitted and applied ``LANGUAGES`` at a time, so that their number takes passes, not
memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.storage import settled
from lithoframe.llm.text import pieces

SAMPLE = 300
LANGUAGES = 64
BUCKETS = 1 << 16
#: Trigrams of a text that count in full; a longer text weighs as much as this many.
EVIDENCE = 60
#: Pseudo-counts with which a host leans on its domain, and a domain on all rows.
LEAN = 20.0
#: A row is rejected below this posterior, or where no language explains its text better than chance.
LEAST = 0.5
#: Hosts whose priors may go to all tasks; beyond that the rows are shuffled by host.
BROADCAST_ROWS = 100_000
_CHUNK = 1 << 18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32


def _codes(data: np.ndarray) -> np.ndarray:
    d = _FOLD[data].astype(np.uint32)
    code = d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA77) ^ d[2:] * np.uint32(0xC2B2AE3D)
    return (code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


def _blank(data: np.ndarray) -> np.ndarray:
    """Which trigrams hold no letter."""
    b = _FOLD[data] == 32
    return b[:-2] & b[1:-1] & b[2:]


def text_scores(column: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-likelihoods (rows by languages) and numbers of trigrams; whole texts, in pieces of bounded size."""
    column = pc.utf8_lower(column.cast(pa.large_string())).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    score, count = np.zeros((n, len(model))), np.zeros(n, dtype=np.int64)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _CHUNK, side="right")) - 1)
        for at in range(int(offsets[row]), int(offsets[last]), _CHUNK):
            end = min(int(offsets[last]), at + _CHUNK + 2)
            if end - at < 3:
                continue
            part = data[at:end]
            codes, dull = _codes(part), _blank(part)
            # a trigram belongs to the row it starts in, if it ends there too
            owner = np.searchsorted(offsets[row + 1 : last + 1], np.arange(at, end - 2), side="right") if last - row > 1 else np.zeros(end - at - 2, dtype=np.int64)
            ok = ~dull & (np.arange(at, end - 2) + 2 < offsets[row + 1 + owner])
            codes, owner = codes[ok], owner[ok]
            count[row:last] += np.bincount(owner, minlength=last - row)
            for k in range(len(model)):
                score[row:last, k] += np.bincount(owner, weights=model[k][codes], minlength=last - row)
        row = last
    return score, count


def normal_label(label: Column) -> Column:
    """The language of a label: en of EN, en-US and en_GB; other labels in lower case."""
    plain = F.lower(F.trim(label.cast("string")))
    return F.regexp_replace(plain, "^([a-z]{2,3})[-_].*$", "$1")


def _named(docs: DataFrame, text: str, label: str, key: str) -> DataFrame:
    return docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(normal_label(F.col(label)).alias("label"), F.col(key).alias("key"), F.col(text).alias("text"))


def labels(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> list[str]:
    """All languages that label a text, sorted."""
    return sorted(r.label for r in _named(docs, text, label, key).select("label").distinct().collect())


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", only: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Languages (all, or those of ``only``) and their log-probabilities of trigram buckets, from a bounded sample of labelled rows."""
    named = _named(docs, text, label, key)
    top = labels(docs, text, label, key) if only is None else only
    if not top:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    order = Window.partitionBy("label").orderBy(F.xxhash64("key"), "key")
    picked = named.select("label", "key").filter(F.col("label").isin(top)).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= SAMPLE)
    # SAMPLE keys for each of the languages asked for
    sample = named.join(F.broadcast(picked.select("label", "key").distinct()), ["label", "key"], "left_semi")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for t in rows.text:
            data = np.frombuffer(t.lower().encode(), dtype=np.uint8)
            if len(data) > 2:
                total += np.bincount(_codes(data)[~_blank(data)], minlength=BUCKETS)
        return pd.DataFrame({"label": rows.label.iloc[:1], "counts": [total.tobytes()]})

    counts = {r.label: np.frombuffer(r.counts, dtype=np.int64) for r in sample.groupBy("label").applyInPandas(count, "label string, counts binary").collect()}
    names = sorted(counts)
    model = np.stack([np.log((counts[x] + 0.05) / (counts[x].sum() + 0.05 * BUCKETS)) for x in names]).astype(np.float32)
    return names, model


def _scored(docs: DataFrame, text: str, names: list[str], model: np.ndarray) -> DataFrame:
    """``docs`` with __ll (log-likelihood of each language, weighed as ``EVIDENCE`` trigrams at most), __by_text, __best (its mean) and __odd.

    Docs that have these columns from other languages keep them: the new ones come after.
    """
    rest = [c for c in docs.columns if c not in ("__ll", "__by_text", "__best", "__odd")]
    earlier = len(rest) < len(docs.columns)
    docs = docs.select(*rest, *(["__ll", "__by_text", "__best", "__odd"] if earlier else []))
    at, n = rest.index(text), len(rest)
    # text that no language explains better than letters drawn evenly from this many trigrams is no language
    chance = float(-np.log(40_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            score, count = text_scores(batch.column(at), model)
            mean = score / np.maximum(count, 1)[:, None]
            ll = mean * np.minimum(count, EVIDENCE)[:, None]
            first, best, none = mean.argmax(axis=1), mean.max(axis=1), count == 0
            by_text = [None if x else names[f] for x, f in zip(none, first)]
            if earlier and len(count):
                old = batch.column(n + 2).to_numpy(zero_copy_only=False)
                by_text = [b if new else a for a, b, new in zip(batch.column(n + 1).to_pylist(), by_text, best > old)]
                best = np.maximum(best, old)
                ll = np.hstack([batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(len(count), -1), ll])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], lists, pa.array(by_text, pa.string()), pa.array(best), pa.array(none | (best < chance))], names=[*rest, "__ll", "__by_text", "__best", "__odd"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)
    return docs.mapInArrow(run, f"{fields}, __ll array<double>, __by_text string, __best double, __odd boolean")


def _smooth(counts: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key and an array of counts by language."""
    return counts.groupBy(key).agg(F.array(*(F.sum(F.when(F.col("__by_text") == x, F.col("n")).otherwise(0)).cast("double") for x in names)).alias("counts"))


def _evidence(scored: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log evidence, as arrays by language: of hosts, declarations and suffixes."""
    by = scored.filter("__by_text is not null").groupBy("__host", "__domain", "__declared", "__suffix", "__by_text").agg(F.count("*").alias("n"))
    by = settled(by)
    whole = by.groupBy("__by_text").agg(F.sum("n").alias("n"))
    all_rows = {r[0]: float(r[1]) for r in whole.collect()}
    total = sum(all_rows.values()) + len(names)
    base = F.array(*(F.lit((all_rows.get(x, 0.0) + 1.0) / total) for x in names))

    def lean(counts: Column, on: Column) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, on, lambda c, p: (c + F.lit(LEAN) * p) / (n + F.lit(LEAN)))

    domains = _smooth(by, "__domain", names).select("__domain", lean(F.col("counts"), base).alias("p"))
    of_host = by.filter("__host is not null").groupBy("__host", "__by_text").agg(F.sum("n").alias("n"), F.first("__domain").alias("__domain"))
    hosts = _smooth(of_host, "__host", names).join(of_host.select("__host", "__domain").distinct(), "__host")
    hosts = hosts.join(domains, "__domain").select("__host", F.transform(lean(F.col("counts"), F.col("p")), lambda p: F.log(p)).alias("__prior"))

    def likelihood(key: str, out: str) -> DataFrame:
        # P(value | language), smoothed by one pseudo-count spread over the values seen
        table = _smooth(by.filter(F.col(key).isNotNull()), key, names)
        size = F.array(*(F.lit(all_rows.get(x, 0.0)) for x in names))
        return table.select(key, F.zip_with("counts", size, lambda c, n: F.log((c + 0.5) / (n + 50.0))).alias(out))

    return hosts, likelihood("__declared", "__said"), likelihood("__suffix", "__ends")


def _sized(table: DataFrame) -> DataFrame:
    """``table`` marked for broadcast if it is small enough, which is counted first."""
    table = settled(table)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None, key: str = "doc_id", label: str | None = None, narrow: bool = False, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with language, probability, by_text (the text's own verdict) and kept.

    ``declared``, ``host`` and ``suffix`` name columns of evidence, which may be null or
    left out; a host's domain is its last two labels. Null texts, or texts without a
    run of letters, have no evidence of their own: their language is null, their
    probability 0, and they are not kept. Rows repeat as they come; ties go to the
    language first by name. Columns named like the results are replaced; without
    labelled rows every language is null. ``narrow`` keeps key and evidence only. Models
    are fitted on ``labelled(doc_id, text, lang)``, or else on ``docs`` and its ``label``
    (that which is declared, if none is named).
    """
    columns = [c for c in docs.columns if c not in ("language", "probability", "by_text", "kept")]
    of = (docs, text, label or declared or "lang", key) if labelled is None else (labelled,)
    names = labels(*of)
    found = docs.select(*columns)
    out = [key] if narrow else columns
    if not names:
        return found.select(*out, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("by_text"), F.lit(False).alias("kept"))
    evidence = {"__declared": declared, "__host": host, "__suffix": suffix}
    found = found.withColumns({k: (F.lower(F.col(v).cast("string")) if v else F.lit(None).cast("string")) for k, v in evidence.items()})
    found = found.withColumn("__domain", F.coalesce(F.regexp_extract("__host", r"[^.]+\.[^.]+$|[^.]+$", 0), F.lit("")))
    if narrow:
        found = found.select(key, text, *evidence, "__domain")
    # one group's models at a time are in memory; a further group reads what the last one wrote
    scored = found
    for at in range(0, len(names), LANGUAGES):
        scored = _scored(settled(scored) if at else scored, text, *fit(*of, only=names[at : at + LANGUAGES]))
    if narrow:
        scored = settled(scored.drop(text))
    hosts, said, ends = (_sized(t) for t in _evidence(scored if narrow else scored.drop(*columns), names))
    joined = scored.join(hosts, "__host", "left").join(said, "__declared", "left").join(ends, "__suffix", "left")
    none = F.array(*(F.lit(0.0) for _ in names))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = F.col("__ll")
    for c in ("__prior", "__said", "__ends"):
        total = add(total, F.coalesce(F.col(c), none))
    joined = joined.withColumn("__sum", total)
    most = F.array_max("__sum")
    joined = joined.withColumns({"__most": most, "__mass": F.aggregate("__sum", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("__sum")))})
    best = F.element_at(F.array(*(F.lit(x) for x in names)), F.array_position("__sum", F.col("__most")).cast("int"))
    fine = F.col("__by_text").isNotNull()
    return joined.select(
        *out,
        F.when(fine, best).alias("language"),
        F.when(fine, F.round(1 / F.col("__mass"), 6)).otherwise(F.lit(0.0)).alias("probability"),
        F.col("__by_text").alias("by_text"),
        (fine & ~F.col("__odd") & (1 / F.col("__mass") >= LEAST)).alias("kept"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host and suffix of web pages: language attribute, host name and top-level domain."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    said = F.lower(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    return pages.select("page_id", plain.alias("text"), F.nullif(said, F.lit("")).alias("declared"), host.alias("host"), F.regexp_extract(host, r"[^.]+$", 0).alias("suffix"))

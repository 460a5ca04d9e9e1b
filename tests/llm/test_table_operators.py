"""Sharding, archives, chats, mixtures and search against brute force and round trips."""

import gzip
import hashlib
import io
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lithoframe.llm import chat, mixing, sharding, topk_search, warc
from lithoframe.llm.storage import settled

DOCS = "doc_id long, text string"


def test_shards_fit(spark):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randint(0, 400)) for k in range(600)] + [(700, None), (None, "y" * 300), (None, "z" * 300), (701, "w" * 5000)]
    df = spark.createDataFrame([(*r, "s", "c") for r in rows], "doc_id long, text string, shard string, cell string")
    assert sharding.shards(df, 2000).columns == ["doc_id", "text", "cell", "shard", "bytes", "shard_bytes"]
    got = sharding.shards(df, 2000).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    held, seen = Counter(), defaultdict(set)
    for r in got:
        held[r.shard] += r.bytes
        seen[r.shard].add(r.doc_id)
        assert r.bytes == len(r.text or "")
    for r in got:
        assert held[r.shard] == r.shard_bytes and (r.shard_bytes <= 2000 or seen[r.shard] == {701})
    # no two shards' prefixes overlap, and no split was needless
    names = sorted(held)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for s in names:
        if s and held[s] <= 2000:
            parent = sum(v for k, v in held.items() if k.startswith(s[:-1]))
            assert parent > 2000


def test_shards_edges(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (1, "same")], DOCS)
    got = sharding.shards(df, 5).collect()
    assert len(got) == 3 and len({r.shard for r in got}) == 1 and got[0].shard_bytes == 12
    other = sharding.shards(spark.createDataFrame([(1, f"text {k}") for k in range(40)], DOCS), 20).collect()
    assert max(r.shard_bytes for r in other) <= 20
    assert sharding.shards(df.limit(0)).count() == 0
    assert [r.shard for r in sharding.shards(df).collect()] == [""] * 3


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("split", [300, 1 << 20])
def test_warc_round_trip(spark, split):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefgh <>\né") for _ in range(400))
    rows = [(k, f"http://h/{k}", body if k % 3 == 0 else f"<p>{k}</p>" * rng.randint(0, 60)) for k in range(90)]
    rows += [(200, None, None), (201, "http://h/é \r\nX: y", ""), (202, "u", "short"), (203, "u", "short"), (204, "u", "WARC/1.1\r\n\r\n" * 30), (205, "u", "z" * 300_000), (None, "u", body), (0, "http://h/0", body)]
    df = spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", digest int").repartition(3)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, split).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and i != first.get(h or "", i)
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert got == want


def test_warc_members_and_false_magic():
    parts = [warc.record(k, "u", data, hashlib.sha256(data).hexdigest(), None) for k, data in enumerate([b"", b"\x1f\x8b\x08" * 500, bytes(range(256)) * 40])]
    blob = b"\x1f\x8b\x08junk" + b"".join(parts)

    class File(io.BytesIO):
        def size(self):
            return len(blob)

        def read_at(self, n, at):
            return blob[at : at + n]

    for step in (1, 7, 100, 5000, 1 << 20):
        found = [x for at in range(0, len(blob), step) for x in warc.records_in(File(blob), at, at + step)]
        assert found == [gzip.decompress(p) for p in parts]


def test_foreign_records(spark, tmp_path):
    def record(kind, ident, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", *more, f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>"
    blob = record("warcinfo", "<urn:uuid:1>", b"software: x\r\n", "Content-Type: application/warc-fields")
    blob += record("request", "<urn:uuid:2>", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request", "X-Folded: a", "  b")
    blob += record("response", "<urn:uuid:3>", http, "content-type:application/http;msgtype=response", "WARC-Target-URI: http://a:80/b", "WARC-Payload-Digest: sha1:ABC")
    blob += record("revisit", "<urn:uuid:4>", b"", "WARC-Refers-To: <urn:uuid:3>")
    (tmp_path / "f.warc.gz").write_bytes(blob)
    got = {r.record_id[-2]: r for r in warc.read(warc.archives(spark, f"file://{tmp_path}/*.gz"), 150).collect()}
    assert [got[k].record_type for k in "1234"] == ["warcinfo", "request", "response", "revisit"] and all(r.page_id is None for r in got.values())
    assert bytes(got["1"].payload) == b"software: x\r\n" and bytes(got["3"].payload) == b"<p>" and got["3"].payload_digest == hashlib.sha256(b"<p>").hexdigest()
    assert (got["3"].url, got["3"].header_digest) == ("http://a:80/b", "sha1:ABC") and (got["4"].refers_to_id, got["4"].payload) == ("<urn:uuid:3>", None)


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_are_listed(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "<p>")], PAGES)
    warc.write(warc.with_revisits(df), f"file://{tmp_path}/w")
    files = warc.archives(spark, f"file://{tmp_path}/w/*.warc.gz")
    assert [(r.page_id, r.url, bytes(r.payload)) for r in warc.read(files).collect()] == [(1, "u", b"<p>")]


CONV = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a\\b <|im_end|>\n"), (1, 2, "assistant", "</s>[INST] \\< ok <|im_start|>"), (1, 3, "user", "x"), (1, 4, "assistant", ""), (1, 5, "user", "tailé\U0001f600")]
    rows += [(2, 0, "assistant", "\\"), (2, 0, "assistant", "\\"), (2, None, "us\ner<|", None), (3, 1, None, "only"), (None, 0, "assistant", "n"), (4, 0, "assistant", "y" * 100_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], CONV + ", example int")
    out = chat.examples(df)
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, _, a, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1].formatted_chars == sum(len(r.text) for r in out.collect() if r.conv_id == 1)
    whole = {(r.conv_id, r.example): r for r in out.collect()}
    assert {k: r.target_start is None for k, r in whole.items() if k[0] == 1} == {(1, 0): False, (1, 1): False, (1, 2): True}
    first, second = whole[1, 0], whole[1, 1]
    assert second.text.startswith(first.text) and second.text.count("<|im_start|>") == 5
    assert second.target_start == second.target_end and len(first.text) == first.target_end + len(chat.END)
    assert chat.examples(df.limit(0)).count() == 0
    # every reply has all turns before it as context, and is the only trainable text
    for (c, e), r in whole.items():
        if r.target_start is not None:
            assert r.text[r.target_end :] == chat.END and all(r.text.startswith(whole[c, x].text) for x in range(e))


def test_pfair_stays_within_a_block():
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 40, 300):
        targets = {f"s{k:03}": rng.random() ** 4 + 1e-6 for k in range(n)}
        total = sum(Fraction(w) for w in targets.values())
        blocks = {s: math.ceil(4000 * Fraction(w) / total) for s, w in targets.items()}
        have, runs = Counter(), 0
        for s, k, t in mixing.pfair(mixing.whole_weights(targets), blocks):
            if runs == 4000:
                break  # from here on sources run out
            assert k == have[s] and t == runs
            have[s], runs = have[s] + 1, runs + 1
            if runs % 50 == 0 or n < 8:
                assert all(abs(have[x] - runs * Fraction(w) / total) < 1 for x, w in targets.items())
        assert runs == 4000


def test_pfair_windows_when_sources_run_out():
    weights, blocks = {"a": 5, "b": 3, "c": 1000}, {"a": 40, "b": 90, "c": 3}
    slots = defaultdict(list)
    for s, k, t in mixing.pfair(weights, blocks):
        assert k * 1008 // weights[s] <= t < -(-(k + 1) * 1008 // weights[s])
        slots[s].append(t)
    assert {s: len(v) for s, v in slots.items()} == blocks and len({t for v in slots.values() for t in v}) == 133


def brute_mixture(rows, got, targets, block):
    """Checks ``got`` against one that is scheduled slot by slot from all windows; returns the slots of each lane."""
    lanes = defaultdict(list)
    for r in got:
        lanes[r.lane].append((r.block, r.place, r.slot))
    total = sum(Fraction(targets[s]) for s in lanes)
    open_blocks = {s: -(-len(v) // block) for s, v in lanes.items()}
    done, want, t = Counter(), {}, 0
    while sum(done.values()) < sum(open_blocks.values()):
        can = []
        for s in lanes:
            k, w = done[s], Fraction(targets[s]) / total
            if k < open_blocks[s] and math.floor(k / w) <= t:
                can.append((math.ceil((k + 1) / w), -w, s))
        if can:
            s = min(can)[2]
            want[s, done[s]] = t
            done[s] += 1
        t += 1
    for s, v in lanes.items():
        assert sorted((b, p) for b, p, _ in v) == [divmod(k, block) for k in range(len(v))]
        assert all(want[s, b] == t for b, _, t in v)
    return lanes


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(k, f"t{k}", rng.choice("aaaaab") if k % 50 else "c") for k in range(3000)] + [(9001, None, None), (None, "n", "a"), (5, "t5", "b"), (5, "t5", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, block int")
    got = mixing.mixed(df, {"a": 2.0, "b": 1.0, "c": 1.0}).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    assert all(r.lane == (r.source or "") for r in got)
    brute_mixture(rows, got, {"a": 2.0, "b": 1.0, "c": 1.0, "": 4 / 3}, mixing.BLOCK)
    again = {(r.doc_id, r.text, r.source): (r.slot, r.place) for r in mixing.mixed(df.repartition(7), {"a": 2.0, "b": 1.0, "c": 1.0}).collect()}
    assert all(again[r.doc_id, r.text, r.source] == (r.slot, r.place) for r in got if r.doc_id != 5)
    plain = mixing.mixed(df).collect()
    brute_mixture(rows, plain, {s: math.sqrt(n) for s, n in Counter(r[2] or "" for r in rows).items()}, mixing.BLOCK)
    assert mixing.mixed(df.limit(0)).count() == 0
    assert mixing.in_order(df).columns == df.columns


def test_mixture_of_many_sources(spark, monkeypatch):
    """A named source keeps its lane and weight however small it is; small ones share lanes; blocks grow."""
    for name, value in (("LANES", 50), ("SHARED", 4), ("BLOCKS", 200), ("SENT_ROWS", -1)):
        monkeypatch.setattr(mixing, name, value)
    rows = [(k, f"t{k}", "big" if k % 2 else f"s{k % 700}") for k in range(8000)] + [(9000 + k, "x", "tiny") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df, {"tiny": 0.25, "big": 0.5, "absent": 9.0}).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    names = {r.lane for r in got}
    assert {"tiny", "big"} < names and len(names) == 6 and max(r.place for r in got) == 40
    assert all(r.lane == r.source for r in got if r.source in ("tiny", "big"))
    of = Counter(r.lane for r in got)
    rest = sum(n for s, n in of.items() if s not in ("tiny", "big"))
    mean = (0.25 + 0.5 + 9.0) / 3
    # sums of doubles of the shared lanes may differ in the last digit: their slots may differ by one
    first = {s: min(r.slot for r in got if r.lane == s) for s in names}
    assert all(first[s] < math.ceil((0.75 + mean) / (mean * of[s] / rest if s not in ("tiny", "big") else {"tiny": 0.25, "big": 0.5}[s])) for s in names)


def test_mixture_at_any_size(spark):
    """Small sources keep lanes of their own beside a large one, and blocks their rows, however many there are."""
    rows = [(k, f"t{k}", "big") for k in range(40_000)] + [(50_000 + k, "x", f"s{k % 10}") for k in range(20)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.lane == r.source for r in got) and len(got) == len(rows)
    brute_mixture(rows, got, {s: math.sqrt(n) for s, n in Counter(r[2] for r in rows).items()}, mixing.BLOCK)
    n = (1 << 20) + 1000
    many = spark.range(n).selectExpr("id as doc_id", "'' as text", "if(id % 3 = 0, 'a', 'b') as source")
    assert mixing.mixed(many, block=1).agg(F.count("*"), F.max("place"), F.countDistinct("slot")).first() == (n, 0, n)


def test_mixture_of_ten_thousand_sources(spark):
    """Each small source has its own target."""
    rows = [(k, f"t{k}", f"s{k % 10_000:04}") for k in range(0, 30_000) if k < 10_000 or k % 7 < 3] + [(40_000 + k, "x", "big") for k in range(9_000)]
    held = Counter(r[2] for r in rows)
    want = {(s, k): t for s, k, t in mixing.pfair(mixing.whole_weights({s: math.sqrt(n) for s, n in held.items()}), {s: -(-n // 2) for s, n in held.items()})}
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=2).collect()
    assert len(got) == len(rows) and {(r.source, r.block): r.slot for r in got} == want


def test_schedule_in_slices(spark, monkeypatch):
    """Slices give the slots of the plain schedule: equal weights, sources that run out, slots that stay empty, deadlines beyond a long."""
    monkeypatch.setattr(mixing, "SLICE", 1)
    rng = random.Random(9)
    cases = [
        {f"s{k}": (7.0, rng.randint(1, 12)) for k in range(500)},
        {f"s{k}": (rng.random() ** 6 + 1e-9, rng.choice([1, 9, 200])) for k in range(60)},
        {"a": (5.0, 40), "b": (3.0, 900), "c": (1000.0, 3)},
        {"a": (1.0, 2000), "b": (1e-200, 1), "c": (3e-200, 1), "d": (2e-200, 1)},
    ]
    for lanes in cases:
        found = spark.createDataFrame([(s, w, n) for s, (w, n) in lanes.items()], "lane string, weight double, rows long")
        want = list(mixing.pfair(mixing.whole_weights({s: w for s, (w, _) in lanes.items()}), {s: n for s, (_, n) in lanes.items()}))
        assert len(want) > 3 * 8 * math.isqrt(len(want)) or len(want) < 1000
        assert sorted(mixing.schedule(found, 1).collect()) == sorted((s, k, t) for s, k, t in want)
    assert mixing.schedule(found.limit(0), 1).count() == 0


def brute_top(rows, ask, k):
    v = {(i, tuple(math.floor(256 * float(x)) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for i, e in v:
        if ask(i):
            near = sorted((-sum(a * b for a, b in zip(e, f)), j) for j, f in v if j != i and len(f) == len(e))[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("blocks", [7, 20_000])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk_search, "CANDIDATES", 20)
    monkeypatch.setattr(topk_search, "PIVOTS", 12)
    monkeypatch.setattr(topk_search, "SENT_BLOCKS", blocks)
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(0, 0.3 + k % 5, 8).astype(np.float32).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[50][1]) for k in range(9)] + [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (2200, [1.0, 2.0]), (2250, []), (50, rows[50][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {tuple(r) for r in topk_search.top_k(df, F.expr("vec_id % 50 = 0")).collect()}
    assert got == brute_top(rows, lambda i: i % 50 == 0, 5)
    assert topk_search.top_k(df.limit(0), F.expr("vec_id % 50 = 0")).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert topk_search.top_k(few, F.expr("vec_id % 50 = 0")).count() == 2
    # rows that repeat are candidates each
    twice = few.unionByName(few).select("vec_id", F.array(F.lit(1.0), F.lit(-0.5)).alias("embedding"))
    assert [tuple(r) for r in topk_search.top_k(twice, F.expr("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 81920), (0, 2, 1, 81920), (0, 3, 2, 81920), (0, 4, 2, 81920)]


@pytest.mark.parametrize("size", [2e7, 1e100, 1e200])
def test_top_k_of_large_components(spark, size):
    rng = random.Random(1)
    rows = [(k, [size * rng.random() * (rng.random() < 0.5) * 1e-3 ** (k % 4) for _ in range(3)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.expr("vec_id % 20 = 0")).collect())
    limit = (1 << 63) - 1
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    want = []
    for i in (0, 20, 40):
        near = sorted((-min(limit, sum(a * b for a, b in zip(v[i], f))), j) for j, f in v.items() if j != i)[:5]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(near, 1)]
    assert got == want


def test_elimination_stops_early():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 100, (20, 16))
    x = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 3, (4000, 16)))
    norm2 = float((x * x).sum(axis=1).max())
    lifted = topk_search._lift(x, norm2)
    pivots = topk_search.choose_pivots(lifted[::7])
    table = topk_search._distances(lifted, pivots)
    ids, score = topk_search.eliminate(np.arange(4000), x, table, 5, x[5], table[5], norm2, 5)
    s = x @ x[5]
    s[5] = -np.inf
    want = np.lexsort((np.arange(4000), -s))[:5]
    assert ids.tolist() == want.tolist() and score.tolist() == s[want].tolist()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    now, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(DATA))
        if name != "shards":
            assert out.columns == docs.columns
        now = out
        sizes.append(out.count())
    assert sizes[3] == sizes[4] == sizes[5] < sizes[0] and sizes[1] == sizes[0]
    assert corpus_pipeline.run(spark, str(DATA)).count() == sizes[5]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(DATA)).count() == 0


def test_pipeline_output_carries_the_mixture(spark):
    import corpus_pipeline

    docs = spark.range(3000).selectExpr("id as doc_id", "repeat(cast(id as string), 300) as text", "if(id % 10 = 0, 'b', 'a') as source")
    by_shard = defaultdict(list)
    written = corpus_pipeline.settled(corpus_pipeline.mixture(spark, docs, ""))
    for r in corpus_pipeline.shards(spark, written, "").select("shard", "position", "source").collect():
        by_shard[r.shard].append((r.position, r.source))
    assert len(by_shard) > 1 and sum(map(len, by_shard.values())) == 3000
    for rows in by_shard.values():
        assert [r[0] for r in rows] == sorted(r[0] for r in rows)
        # tempered weights are 3 to 1 where rows are 9 to 1
        head = rows[: len(rows) // 5]
        assert 0.15 < sum(r[1] == "b" for r in head) / len(head) < 0.35


def test_positions(spark):
    df = spark.range(50).selectExpr("id", "id % 3 as position").repartitionByRange(4, "id").sortWithinPartitions("id")
    assert all(r.id == r.position for r in mixing.positions(df).collect())
    assert all(r.id == r.position for r in mixing.positions(settled(df)).coalesce(1).collect())
    assert mixing.positions(df.limit(0)).count() == 0


def test_registered_queries(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= names

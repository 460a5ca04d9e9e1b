"""The whole pipeline against brute force, and its stages on nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from test_table_operators import brute_mixture
from test_text_operators import brute_components, brute_leaks, brute_posteriors

import corpus_pipeline
from lithoframe.llm import langid, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SAID = {"en": "the cat and dog of house is that was with for on as by".split(), "de": "der hund und die katze in dem haus ist mit von auf nicht ein".split()}


def corpus():
    rng = random.Random(21)
    items = [(k, " ".join(rng.choice(SAID["en"]) + str(rng.randrange(9)) for _ in range(12))) for k in range(4)]
    rows = []
    for k in range(140):
        x = "en" if k % 3 else "de"
        t = [rng.choice(SAID[x]) for _ in range(rng.choice([0, 1, 4, 12, 60]))]
        if k % 11 == 0:
            t = t[:3] + items[k % 4][1].split() + t[3:]
        if k % 5 == 0 and len(rows) > 20:
            t = (rng.choice(rows)[1] or "").split()
            if t:
                t[rng.randrange(len(t))] = rng.choice(SAID[x])
        rows.append((k, " ".join(t), x, "a.org" if k % 4 else "b.org", 1))
    rows += [(200, None, "en", "a.org", 0), (201, "", None, None, 0), (202, "zq xj qzv kxw " * 20, None, None, 0), (203, rows[7][1], "en", None, 0), (204, "the cat and the dog " * 4000, "en", "a.org", 0)]
    return rows, items


def brute_shards(rows, limit):
    """doc_id to shard: the shortest bit prefix whose rows fit."""
    def bits(d, t):
        return "".join(f"{int(hashlib.md5(x.encode()).hexdigest()[:15], 16):060b}" for x in (str(d), t or ""))

    left, out, depth = [(d, bits(d, t), len((t or "").encode())) for d, t in rows], {}, 0
    while left:
        size = Counter()
        for _, b, n in left:
            size[b[:depth]] += n
        alone = {p for p in size if len({b for _, b, _ in left if b.startswith(p)}) == 1}
        out |= {d: (b[:depth], size[b[:depth]]) for d, b, _ in left if size[b[:depth]] <= limit or b[:depth] in alone}
        left = [r for r in left if r[0] not in out]
        depth += 1
    return out


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    # a shard can't hold the long text: it is alone in one, and its prefix is as deep as it was looked at
    monkeypatch.setattr(corpus_pipeline.sharding, "SHARD_BYTES", 1500)
    monkeypatch.setattr(sharding.shards, "__defaults__", (1500,))
    monkeypatch.setattr(mixing.mixed, "__defaults__", (None, "source", 2))
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    names, model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    verdict = brute_posteriors([(d, t, x, s, None) for d, t, x, s, _ in rows], names, model)
    chance = -__import__("math").log(40_000)
    kept = []
    for r in rows:
        score, count = langid.text_scores(__import__("pyarrow").array([r[1]], "string"), model)
        if count[0] and score[0].max() / count[0] >= chance and verdict[r[0]][1] >= langid.LEAST:
            kept.append(r)
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    assert {200, 201, 202} <= gone and 204 not in gone
    first = {d: c for d, _, c in brute_components([r[:2] for r in kept])}
    once = [r for r in kept if first[r[0]] == r[0]]
    assert len(once) < len(kept)
    leaks = {d for d, _ in brute_leaks([r[:2] for r in once], items)}
    clean = [r for r in once if r[0] not in leaks]
    assert leaks
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in got) == Counter(r[:4] for r in clean)
    weights = {s: n**0.5 for s, n in Counter(r[3] or "" for r in clean).items()}
    mixed = mixing.mixed(spark.createDataFrame(clean, SCHEMA)).collect()
    brute_mixture(clean, mixed, weights, 2)
    order = [r.doc_id for r in sorted(mixed, key=lambda r: (r.slot, r.place))]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == order and sorted(r.position for r in got) == list(range(len(clean)))
    want = brute_shards([r[:2] for r in clean], 1500)
    for r in got:
        if r.doc_id != 204:
            assert (r.shard, r.shard_bytes) == want[r.doc_id]
        assert r.bytes == len((r.text or "").encode())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, tmp_path, name):
    """Every stage takes nulls in any column, repeated rows, further columns with names of results, and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    rows, items = corpus()
    spark.createDataFrame(items + [(None, None), (9, None), (10, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(None, None, None, None, None), (None, "the cat and the dog", "en", None, None), (7, rows[7][1], "en", "a.org", 1), (7, rows[7][1], "en", "a.org", 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows[:40] + odd], SCHEMA + ", shard int, component_id int")
    out = stage(spark, df, str(tmp_path))
    found = out.collect()
    assert set(df.columns) - {"shard"} <= set(out.columns) and 0 < len(found) <= 44
    if name in ("mixture", "shards"):
        assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows[:40] + odd)
    if name != "shards":
        assert out.columns == df.columns
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_files_hold_the_mixture(spark):
    """Read in the order of its files, what the mixture stage writes keeps the shares of the sources."""
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text", "'en' as lang", "if(id % 10 = 0, 'b', 'a') as source", "1L as n_chars")
    parts = defaultdict(list)
    for r in corpus_pipeline.mixture(spark, docs, "").selectExpr("spark_partition_id() as p", "source").collect():
        parts[r.p].append(r.source)
    head = [s for p in sorted(parts) for s in parts[p]][:1000]
    # tempered weights are 3 to 1 where rows are 9 to 1
    assert 0.2 < head.count("b") / len(head) < 0.3

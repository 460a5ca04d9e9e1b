"""Hard negatives, periodic runs and byte-level BPE against brute force and the tokenizer itself."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
import tiktoken
from conftest import DATA
from pyspark.sql import functions as F

from lithoframe.llm import bpe, hard_negatives, pii, runs

public_tokenizers = pytest.importorskip("public_tokenizers")


def mined(rows, asked, n=5, k=5):
    """Brute force over (vec_id, embedding, label) with whole-number components."""
    seen = list(dict.fromkeys((i, tuple(v), lab) for i, v, lab in rows if asked(i)))
    out = []
    for a, v, lab in seen:
        scored = [(-sum(x * y for x, y in zip(v, w)), i, lb) for i, w, lb in rows if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == lab)[:n]:
            fits = sorted(x for x in scored if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fits, 1)]
    return Counter(out)


@pytest.mark.parametrize(("size", "dims", "scale"), [(16, 6, 40), (4096, 3, 9), (7, 2, 3)])
def test_mine(spark, monkeypatch, size, dims, scale):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = random.Random(size)
    rows = [(i, [rng.randint(-scale, scale) * rng.choice([1, 1, 5]) for _ in range(dims)], rng.randrange(3)) for i in range(240)]
    # equal vectors, rows that repeat, another length, zero vectors
    rows += [(300 + i, rows[0][1], i % 2) for i in range(40)] + rows[:6] + [(400 + i, [i, 2], 0) for i in range(8)] + [(500 + i, [0] * dims, i % 2) for i in range(8)]
    df = spark.createDataFrame([(i, [x / 256 for x in v], lab, 0, "n") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, v int, norm string")
    got = hard_negatives.mine(df, F.expr("vec_id % 10 = 0"), size=size).collect()
    assert Counter(tuple(r) for r in got) == mined(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine(df, F.expr("vec_id % 10 = 0"), size=size).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_mine_edges(spark):
    kind = "vec_id long, embedding array<double>, label int"
    odd = [(1, None, 0), (2, [], 0), (3, [math.nan, 1.0], 0), (4, [math.inf, 1.0], 0), (5, [None, 1.0], 0), (None, [1.0, 1.0], 0), (6, [1.0, 1.0], None)]
    assert hard_negatives.mine(spark.createDataFrame(odd, kind), F.lit(True)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    fine = [(0, [1.0, 0.0], 0), (7, [0.5, 0.0], 0), (8, [0.45, 0.0], 1), (9, [0.3, 0.0], 1)]
    got = hard_negatives.mine(spark.createDataFrame(fine + odd, kind), F.expr("vec_id = 0")).collect()
    # 0.3 is below four fifths of 0.5; floor(256 * 0.45) = 115
    assert [tuple(r) for r in got] == [(0, 7, 1, 8, 256 * 128, 256 * 115)]
    # a third person's label alone: no positives, so no rows
    assert hard_negatives.mine(spark.createDataFrame([(0, [1.0], 0), (1, [1.0], 1)], kind), F.lit(True)).count() == 0
    # products beyond what doubles hold exactly
    far = [(0, [2.0**40 + 1, 3.0], 0), (1, [2.0**20 + 1, 1.0], 0), (2, [2.0**20, 1.0], 1)]
    got = hard_negatives.mine(spark.createDataFrame(far, kind), F.expr("vec_id = 0")).collect()
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in far]
    most = (1 << 63) - 1
    scores = [min(most, sum(a * b for a, b in zip(whole[0], w))) for w in whole]
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, scores[1], scores[2])]


def all_runs(w):
    """Every run of a list of words, lag by lag and word by word."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            stretch = w[i : i + length]
            if j > i and length >= max(12, 2 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def spaced(text):
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    return words + [word] * bool(word)


def summary(doc_id, text):
    words = spaced(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    some = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return (doc_id, len(found), *some, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("whole", [runs.WHOLE, 40])
def test_runs(spark, whole):
    rng = random.Random(whole)
    texts = [None, "", " \t\n", "one", "a " * 12, "a " * 11, "a b " * 9, "x y " * 6 + "x", "A a " * 8 + "a A " * 8, "ab ab\x1cab " * 7]
    for _ in range(150):
        words = [str(rng.randrange(rng.choice([2, 3, 30]))) for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = words[at : at + rng.randrange(1, 9)] * rng.randrange(1, 8)
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, "other " * 14), (None, "n " * 20), (None, None)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n_words int, __row string")
    got = runs.summaries(df, rewrite=runs.planted(F.col("doc_id")), whole=whole).collect()
    assert Counter(tuple(r) for r in got) == Counter(summary(*r) for r in rows)
    found = runs.find_runs(df, whole=whole).collect()
    assert Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs)) for r in found) == Counter((i, len(spaced(t)), tuple(all_runs(spaced(t)))) for i, t in rows)
    assert next(r.words for r in found if r.doc_id == 4) == "a"
    assert runs.summaries(df.limit(0)).count() == 0


def test_runs_of_long_texts(spark):
    rng = random.Random(8)
    unit = [str(rng.randrange(10**6)) for _ in range(9000)]
    words = unit * 2 + [str(k) for k in range(30_000)]
    rows = [(1, " ".join(words)), (2, "w " * 120_000), (3, "x" * 1_500_000)]
    got = {r.doc_id: r.runs for r in runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string"), whole=100_000).collect()}
    assert [tuple(r) for r in got[1]] == [(0, 18000, 9000)] and [tuple(r) for r in got[2]] == [(0, 120_000, 1)] and got[3] == []


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in bpe.read_ranks(PATH)}, special_tokens={})


def coded(tokenizer, text):
    return tokenizer.encode_ordinary(text or "")


def test_engine(tokenizer):
    rng = random.Random(13)
    letters = [chr(c) for c in range(0x20, 0x250)] + list(" \n\t'　 \x85\x1c") * 20 + [c for c in (chr(rng.randrange(0x110000)) for _ in range(400)) if not "\ud800" <= c < ""]
    texts = [None, "", " ", "  ", "\n\n a  b \t\t x's 'S  's", "<|endoftext|>", "﷐ a  b", "a" * 150, "ab" * 70, "=-" * 60, "啊哦" * 40, " " * 90 + "x", "x" + "\n" * 50]
    texts += [f"a{c}1 {c}{c}b  {c}" for c in map(chr, [*range(0x500, 0x600), *range(0x10D40, 0x10DA0), *range(0x2EBF0, 0x2EC00), *range(0x16E90, 0x16EE0)])]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]
    engine = bpe.Engine(bpe.read_ranks(PATH), public_tokenizers.PATTERN, *bpe.classes(), known_words=200)
    for some in (texts[:400], [t for t in texts if "﷐" not in (t or "")], texts[-50:]):
        ids = engine.encode(pa.array(some, pa.string()))
        assert ids.to_pylist() == [coded(tokenizer, t) for t in some]
        assert engine.decode(ids).to_pylist() == [(t or "").encode() for t in some]
    # a pattern that RE2 can't take is another engine's
    assert bpe.for_re2(r"\w+(?=x)|\s+") is None and bpe.for_re2(public_tokenizers.PATTERN)


def test_encode_and_decode(spark, tokenizer, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows += [rows[0], (None, "no key"), (None, None), (-1, ""), (-2, "long  text, \n of words " * 300_000)]
    df = spark.createDataFrame([(*r, [1], "d") for r in rows], "doc_id long, text string, ids array<int>, decoded string")
    both = bpe.encode(df, PATH, public_tokenizers.PATTERN, restore=True)
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in both.collect())
    assert got == Counter((i, tuple(coded(tokenizer, t)), (t or "").encode()) for i, t in rows)
    digest = {r.doc_id: r for r in bpe.digests(both.filter("doc_id >= 0")).collect()}
    for i, t in rows[:40]:
        ids = coded(tokenizer, t)
        assert digest[i][1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [-7, 10**6, None])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(odd, PATH).collect()] == [b""] * 3
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_pieces():
    text = "ab  c\n" * 100 + "x" * 500 + " y" * 50
    for size in (1, 7, 64, 10_000):
        parts = list(bpe._pieces(text, size))
        assert "".join(parts) == text and all(p[0].isspace() and not q[-1].isspace() for q, p in zip(parts, parts[1:]))


def test_pseudonyms_of_long_names(spark):
    """A domain of a million labels, as other repetitive texts, takes no stack."""
    rows = [(1, "x@" + "a." * 1_000_000 + "b"), (2, "\\" * 20_000), (3, "1-" * 300_000), (4, "+1 " * 200_000), (5, "me@" + "a." * 30 + "org, bye")]
    got = {r.doc_id: r.text for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == rows[1][1] and got[1].endswith(".b") and not got[5].startswith("me@") and got[5].endswith(", bye")

"""Readers of text files."""

import random

import numpy as np
import pytest

from lithoframe.sources import ascii as a
from lithoframe.sources import binary, tables


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def test_array_with_repeats_and_comments(spark, tmp_path):
    path = put(tmp_path, "grid", "! a grid\nPORO\n2*0.5 1.0E-1 ! half\n 3 1D2\n\nKX\n7 8\n")
    assert [(r.cell_id, r.value) for r in a.array_values(spark, path, "PORO").orderBy("cell_id").collect()] == [(0, 0.5), (1, 0.5), (2, 0.1), (3, 3.0), (4, 100.0)]
    assert [r.value for r in a.array_values(spark, path, "kx").orderBy("cell_id").collect()] == [7.0, 8.0]


def test_logs(spark, tmp_path):
    path = put(tmp_path, "w.las", "~V\nVERS. 2.0 :\n~W\nNULL.  -999.25 : none\n~C\nDEPT.M  : depth\nGR.gAPI : gamma\n# note\nNPHI.v/v : phi\n~A\n1.0 50 0.1\n2.0 -999.25 0.2\n")
    got = sorted(tuple(r)[1:] for r in a.log_values(spark, path).collect())
    assert got == [(1.0, "GR", "gAPI", 50.0), (1.0, "NPHI", "v/v", 0.1), (2.0, "GR", "gAPI", None), (2.0, "NPHI", "v/v", 0.2)]


def test_triangulated(spark, tmp_path):
    nodes, triangles = a.triangulated(spark, put(tmp_path, "s.ts", "GOCAD TSurf 1\nVRTX 1 0 0 5\nVRTX 2 1 0 5\nPVRTX 3 0 1.5 5 9\nTRGL 1 2 3\nEND\n"))
    assert nodes.count() == 3 and nodes.filter("node = 3").first().y == 1.5
    assert [tuple(r)[1:] for r in triangles.collect()] == [(1, 2, 3)]


def test_lines_of_points(spark, tmp_path):
    path = put(tmp_path, "l.irap", "0 0 1\n1 0 1\n999 999 999\n5 5 5\n999 999 999\n")
    assert sorted((r.line, r.seq, r.x) for r in a.lines_of_points(spark, path).collect()) == [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 5.0)]


def test_write_and_read(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    a.write_array(spark.range(35).selectExpr("id as cell_id", "cast(id as double) / 2 as value"), out)
    parts = sorted((tmp_path / "out").glob("part*"))
    text = "".join(p.read_text() for p in parts)
    assert [float(x) for x in text.split()] == [k / 2 for k in range(35)]


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few lines, and no merging of tasks."""
    small = {"spark.sql.files.maxPartitionBytes": "70", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k in small:
        spark.conf.unset(k)


def test_array_in_many_splits(spark, tmp_path, tiny_splits):
    """An array keeps its numbers over the splits of one file and over several files."""
    rng = random.Random(2)
    words, values = [], []
    for k in range(900):
        n = rng.choice([1, 1, 1, 0, 7])
        words.append(rng.choice([f"{k}.5", "none"]) if n == 1 else f"{n}*{k}")
        values += [None if words[-1] == "none" else float(words[-1].split("*")[-1])] * n
    lines, at = [], 0
    while at < len(words):
        n = rng.randrange(0, 9)
        lines.append(" ".join(words[at : at + n]) + rng.choice(["", "  ", " ! 5 6", "\r"]))
        at += n
    path = put(tmp_path, "one", "\n".join(lines) + "\n")
    got = a.array_values(spark, path)
    assert got.rdd.getNumPartitions() > 1 and spark.read.text(path).rdd.getNumPartitions() > 20
    assert [tuple(r)[1:] for r in got.orderBy("cell_id").collect()] == list(enumerate(values))
    assert [tuple(r)[1:] for r in a.numbered(spark, path).orderBy("line").collect()] == [(k, x.removesuffix("\r")) for k, x in enumerate(lines)]
    (tmp_path / "many").mkdir()
    for n in range(12):
        part = lines[n * len(lines) // 12 : (n + 1) * len(lines) // 12]
        put(tmp_path / "many", f"part-{99994 + n}-x", "".join(x + "\n" for x in part))
    several = a.array_values(spark, f"file://{tmp_path}/many", over_files=True)
    assert [(r.cell_id, r.value) for r in several.orderBy("cell_id").collect()] == list(enumerate(values))


def test_section_in_many_splits(spark, tmp_path, tiny_splits):
    text = "! head\nTITLE a b\n" + "1 2 3\n" * 30 + "name PORO 5 6 ! x\n" + "7 2*8 / 9\n" * 40 + "nan 4\nKX\n" + "0 0\n" * 20 + "PORO 1\n"
    want = [5.0, 6.0] + [7.0, 8.0, 8.0, 9.0] * 40
    got = [r.value for r in a.array_values(spark, put(tmp_path, "s", text), "poro").orderBy("cell_id").collect()]
    assert got == want
    assert a.array_values(spark, put(tmp_path, "t", "NONE\n1 2\n"), "PORO").count() == 0


def test_write_and_read_many_files(spark, tmp_path, tiny_splits):
    out = f"file://{tmp_path}/out"
    a.write_array(spark.range(1000).selectExpr("id as cell_id", "cast(id as double) / 2 as value"), out)
    assert len(list((tmp_path / "out").glob("part*"))) > 1
    assert [(r.cell_id, r.value) for r in a.array_values(spark, out, over_files=True).orderBy("cell_id").collect()] == [(k, k / 2) for k in range(1000)]


@pytest.mark.parametrize(("data_type", "wide"), [("real", True), ("float", False), ("int", True), ("integer", False), ("bool", True), ("boolean", False)])
def test_binary_arrays(spark, tmp_path, data_type, wide):
    """Written by ranges, read by ranges: every kind comes back as it went."""
    kind = binary.ending(data_type, wide)
    given = [k % 2 if "bool" in data_type else k / 4 if data_type in ("real", "float") else -k * 3 for k in range(501)]
    df = spark.createDataFrame([(k, float(v), "x") for k, v in enumerate(given)], "cell_id long, value double, path string").repartition(5)
    folder = f"file://{tmp_path}/a"
    parts = binary.write_array(df, folder, kind).collect()
    assert sum(p.n for p in parts) == 501 and not [f for f in (tmp_path / "a").iterdir() if f.name.startswith("_")]
    for split in (24, 1 << 20):
        got = binary.read_array(spark, folder, kind, over_files=True, split_bytes=split)
        assert [(r.cell_id, r.value) for r in got.orderBy("cell_id").collect()] == list(enumerate(given))
    code = np.dtype(binary.KINDS[kind][0])
    (tmp_path / f"one{kind}").write_bytes(np.array(given[:7], dtype=code).tobytes() + b"\1" * (code.itemsize - 1))
    one = binary.read_array(spark, f"file://{tmp_path}/one{kind}", kind, split_bytes=1).orderBy("cell_id").collect()
    assert [(r.cell_id, r.value) for r in one] == list(enumerate(given[:7])) and one[0].path.endswith(f"one{kind}")


def test_binary_corner_points(spark, tmp_path):
    values = [float(v) for v in range(48)]
    df = spark.createDataFrame(list(enumerate(values)), "cell_id long, value double")
    binary.write_array(df, f"file://{tmp_path}/c", ".db").collect()
    got = tables.corner_points(binary.read_array(spark, f"file://{tmp_path}/c", ".db", over_files=True, split_bytes=40), 1, 2)
    assert {(r.i, r.kp, r.jp, r.ip, r.x, r.z) for r in got.collect()} == {(n, c // 4, c // 2 % 2, (c + c // 2) % 2, 24.0 * n + 3 * c, 24.0 * n + 3 * c + 2) for n in (0, 1) for c in range(8)}

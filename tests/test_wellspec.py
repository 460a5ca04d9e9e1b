"""Frames of well specifications, relative permeability tables, and time series of summaries."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from lithoframe.operators import timeseries, wellspec
from lithoframe.plans import files
from lithoframe.sources import tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def intervals(spark):
    rows = [("A", 10.0 * n, 10.0 * n + 10.0, n, 2, 3, 1.0, 2.0, 1000.0 + 10 * n, 1000.0 + 10 * n, n != 4, 0.1 * n, n % 3, 0.0, 0.0, 100.0, 0.5, 50.0, 50.0, 10.0) for n in range(8)]
    names = "well string, md0 double, md1 double, k long, j long, i long, x double, y double, depth double, cell_depth double, active boolean, satw double, region int, anglv double, angla double, ki double, ntg double, di double, dj double, dk double"
    return spark.createDataFrame(rows, names)


def _layers(df):
    return [r.L for r in df.orderBy("row").collect()]


def test_frame(spark, intervals):
    all_rows = wellspec.frame(intervals).orderBy("row").collect()
    assert [(r.row, r.IW, r.JW, r.L, r.MD, r.LENGTH, r.PPERF) for r in all_rows] == [(n, 4, 3, n + 1, 10.0 * n + 5, 10.0, 1.0) for n in range(8)]
    # vertical: length times the mean of horizontal permeabilities, less what isn't net
    assert all(r.KH == pytest.approx(10.0 * 50.0) and r.STAT == "ON" and r.RADW == 0.1 for r in all_rows)
    assert all(r.WBC == pytest.approx(8.5270171e-5 * r.KH * r.WI) and r.RADB > 1 for r in all_rows)
    L = wellspec.Limits
    for limits, want in (
        (L(active_only=True), [1, 2, 3, 4, 6, 7, 8]), (L(min_k=2, max_k=4), [3, 4, 5]), (L(layers=(1, 6)), [2, 7]), (L(layers=()), []), (L(regions=(0,)), [1, 4, 7]),
        (L(max_depth=1025.0), [1, 2, 3]), (L(max_satw=0.35), [1, 2, 3, 4]), (L(min_length=10.5), []), (L(min_kh=501.0), []), (L(min_k=1, active_only=True, regions=(1,)), [2, 8]),
    ):
        assert _layers(wellspec.frame(intervals, limits)) == want
    assert _layers(wellspec.frame(intervals, one_based=False, columns=("MD",))) == list(range(8))


def test_frame_of_perforations(spark, intervals):
    open_parts = spark.createDataFrame([("A", 12.0, 16.0), ("A", 18.0, 20.005), ("A", 35.0, 62.5), ("B", 0.0, 99.0)], "well string, md0 double, md1 double")
    rows = wellspec.frame(intervals, perforations=open_parts).orderBy("row").collect()
    assert [(r.L, r.PPERF, r.LENGTH) for r in rows] == [(2, pytest.approx(0.6), pytest.approx(6.0)), (4, 0.5, 5.0), (5, 1.0, 10.0), (6, 1.0, 10.0), (7, 0.25, 2.5)]
    # up to half the cell is pay, which is perforated first
    assert [r.KH for r in rows] == pytest.approx([6.0 * 100 * 0.5 / 0.6, 500.0, 500.0, 500.0, 250.0])
    assert [r.KH for r in wellspec.frame(intervals, perforations=open_parts, preferential=False).orderBy("row").collect()] == pytest.approx([300.0, 250.0, 500.0, 500.0, 125.0])
    assert wellspec.frame(intervals, perforations=open_parts.filter("false")).count() == 0
    with pytest.raises(ValueError):
        wellspec.frame(intervals.drop("ki"))
    assert wellspec.frame(intervals.drop("ki"), columns=("LENGTH", "STAT")).count() == 8


def test_relperm_tables(spark, tmp_path):
    (tmp_path / "t.dat").write_text("! tables\nWOTABLE\nSW KROW KRW PCWO\n0.1 1.0 0.0 NA\n0.9\t0 .5 1E-1\n! no\nGOTABLE extra\nSG KRG KROG\n0.0 0.0 1.0\nnone 1 1\n0.5 0.4\n\nGWTABLE\nsg KRG KRWG PC\n0.2 0.1 0.7 3\n")
    got = sorted(tuple(r)[1:] for r in tables.relperm_tables(spark, f"file://{tmp_path}").collect())
    assert got == [
        (1, "water-oil", 0, 0.1, None, 0.0, None, 1.0, None), (1, "water-oil", 1, 0.9, None, 0.5, None, 0.0, 0.1),
        (2, "gas-oil", 0, None, 0.0, None, 0.0, 1.0, None), (2, "gas-oil", 1, None, 0.5, None, 0.4, None, None),
        (3, "gas-water", 0, None, 0.2, 0.7, 0.1, None, 3.0),
    ]


def test_summaries(spark, tmp_path):
    head = "some run\nSTEP T.S. NWT TIME DATE\nNO. REP. ITN {} {} MSTB\n---- --- -- ---- ----\n"
    (tmp_path / "a.sum").write_text(head.format("DAYS", "DD/MM/YYYY") + "1 0 2 1.5 2/01/2000 0.1\n3 0 1 4.0 4/01/2000 0.1\n3 0 1 5.0 5/01/2000 9\n4 0 1 3.0 3/01/2000 1\n6 0 1 7.25 8/01/2000 1\n7 0 1\n")
    (tmp_path / "b.sum").write_text(head.format("HRS", "kCC") + "1 0 2 12 0.0 0.1\n2 0 1 36 0.0 0.1\n")
    (tmp_path / "c.sum").write_text(head.format("DAYS", "MM/DD/YYYY") + "0 0 2 0.0 12/31/1999 0.1\n1 0 2 1.0 1/01/2000 0.1\n")
    rows = tables.summaries(spark, f"file://{tmp_path}").withColumn("path", F.regexp_extract("path", r"(\w)\.sum$", 1))
    assert rows.count() == 9
    got = {(r.path, r.step): (r.days, r.timestamp) for r in timeseries.from_summary(rows, "2021-05-01").collect()}
    a = dt.datetime(2000, 1, 1)
    want = {("a", n): (d, a + dt.timedelta(days=d)) for n, d in enumerate((0.0, 1.5, 1.5, 4.0, 4.0, 4.0, 7.25))}
    want |= {("b", n): (d, dt.datetime(2021, 5, 1) + dt.timedelta(days=d)) for n, d in enumerate((0.0, 0.5, 1.5))}
    want |= {("c", n): (d, dt.datetime(1999, 12, 31) + dt.timedelta(days=d)) for n, d in enumerate((0.0, 1.0))}
    assert got == want


def test_permeability_adds_up_in_the_order_of_the_table(spark, tmp_path):
    # in this order the sum falls just short of a half, as in SQL; in others it reaches it
    prices = duckdb.sql(f"select o_totalprice from '{SMALL}/orders.parquet' where o_custkey = 144 and o_orderkey % 3 > 0 order by o_orderkey").fetchall()
    rows = [(3 * (40 * n + c) + 1, c, p) for n, (p,) in enumerate(prices) for c in range(40)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.well: r.kh for r in files.file_wellspec(spark, str(tmp_path)).collect()}
    assert got == {f"W{c}": 1174.5 for c in range(40)}

"""The frame of well specifications: a row for each cell interval of a well that passes all limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.operators import intervals as spans
from lithoframe.operators.wells import WELL_CONSTANT, block_radius, effective_ntg, flow_capacity, well_index

#: Columns of the frame besides well, row, IW, JW and L.
COLUMNS = ("MD", "LENGTH", "ANGLA", "ANGLV", "DEPTH", "X", "Y", "PPERF", "KH", "RADW", "SKIN", "RADB", "WI", "WBC", "STAT")

#: Intervals with less perforated length have no perforation.
LEAST_PERFORATED = 0.01


@dataclass(frozen=True)
class Limits:
    """What intervals must fulfil; None is no condition, an empty tuple excludes all. Layers count from 0, depths and lengths are in the units of the intervals."""

    active_only: bool = False
    min_k: int | None = None
    max_k: int | None = None
    layers: tuple[int, ...] | None = None
    regions: tuple[int, ...] | None = None
    max_depth: float | None = None
    max_satw: float | None = None
    min_sato: float | None = None
    max_satg: float | None = None
    min_length: float | None = None
    min_kh: float | None = None


def _allowed(limits: Limits) -> Column:
    """Conditions on the cell; a property that is null breaks no limit, but is in no list."""
    fine = F.lit(True)
    ranges = (("k", limits.min_k, limits.max_k), ("cell_depth", None, limits.max_depth), ("satw", None, limits.max_satw), ("sato", limits.min_sato, None), ("satg", None, limits.max_satg))
    for name, low, high in ranges:
        if low is not None:
            fine &= ~F.coalesce(F.col(name) < low, F.lit(False))
        if high is not None:
            fine &= ~F.coalesce(F.col(name) > high, F.lit(False))
    for name, some in (("k", limits.layers), ("region", limits.regions)):
        if some is not None:
            fine &= F.coalesce(F.col(name).isin(*some), F.lit(False)) if some else F.lit(False)
    if limits.active_only:
        fine &= F.coalesce(F.col("active"), F.lit(False))
    return fine


def perforated_part(intervals: DataFrame, perforations: DataFrame) -> DataFrame:
    """``intervals`` with the perforated part of each (1 at most); those with less than ``LEAST_PERFORATED`` of it are left out."""
    b = perforations.select("well", F.col("md0").alias("b_md0"), F.col("md1").alias("b_md1"))
    keys = ["well", "md0", "md1"]
    shared = spans.overlapping(intervals.select(*keys).distinct(), b, ["well"], ("md0", "md1"), ("b_md0", "b_md1"))
    length = F.sum(F.least("md1", "b_md1") - F.greatest("md0", "b_md0"))
    parts = shared.groupBy(*keys).agg(length.alias("open")).filter(F.col("open") >= LEAST_PERFORATED)
    part = F.least(F.lit(1.0), F.col("open") / (F.col("md1") - F.col("md0")))
    return intervals.join(parts.select(*keys, part.alias("part")), keys)


def frame(intervals: DataFrame, limits: Limits = Limits(), perforations: DataFrame | None = None, columns: tuple[str, ...] = COLUMNS, one_based: bool = True, straight: bool = False, preferential: bool = True, radius: float | None = None, skin: float = 0.0, stat: str = "ON", unit: str = "m") -> DataFrame:
    """well, row (from 0 along the well), IW, JW, L and ``columns`` of the intervals within all limits.

    ``intervals`` hold well, md0, md1, k, j, i (from 0), x, y, depth (of the middle), anglv
    and angla (radians to the cell), ki, and, as limits and columns need them, kj, kk (else
    as ki), ntg (else 1), di, dj, dk (lengths of the cell), cell_depth, active, satw, sato,
    satg, region, and chord for ``straight`` lengths. md0, md1 are distinct within a well.
    Only intervals that ``perforations(well, md0, md1)`` open are kept where they are given:
    length is the perforated one, and with ``preferential`` pay is perforated first.
    Intervals that fail one limit are left out; later ones of the well may still be in.
    """
    rows = intervals.filter(_allowed(limits))
    rows = perforated_part(rows, perforations) if perforations is not None else rows.withColumn("part", F.lit(1.0))
    rows = rows.withColumn("length", (F.col("chord") if straight else F.col("md1") - F.col("md0")) * F.col("part"))
    if limits.min_length is not None:
        rows = rows.filter(F.col("length") >= limits.min_length)
    there = set(intervals.columns)
    if "ki" in there:
        ntg = F.col("ntg") if "ntg" in there else F.lit(1.0)
        net = F.when(F.abs(ntg - 1.0) <= 0.001, ntg).otherwise(effective_ntg(ntg, F.col("part"))) if preferential else ntg
        perm = lambda c: F.col(c) if c in there else F.col("ki")
        rows = rows.withColumns({"p_i": F.col("ki") * net, "p_j": perm("kj") * net, "p_k": perm("kk")})
        k, angles = tuple(F.col(f"p_{a}") for a in "ijk"), (F.col("anglv"), F.col("angla"))
        rows = rows.withColumn("kh", flow_capacity(F.col("length"), *k, *angles))
        if limits.min_kh is not None and limits.min_kh > 0:
            rows = rows.filter(F.col("kh") >= limits.min_kh)
    elif limits.min_kh or {"KH", "RADB", "WI", "WBC"} & set(columns):
        raise ValueError("KH, RADB, WI and WBC need the permeability ki")
    well_radius = F.lit(radius if radius is not None else {"m": 0.1, "ft": 0.33}[unit])
    if {"RADB", "WI", "WBC"} & set(columns):
        rows = rows.withColumn("radb", block_radius(well_radius, k, tuple(F.col(f"d{a}") for a in "ijk"), *angles))
        rows = rows.withColumn("wi", well_index(F.col("radb"), well_radius, F.lit(skin)))
    made = {
        "MD": lambda: (F.col("md0") + F.col("md1")) * 0.5, "LENGTH": lambda: F.col("length"), "ANGLA": lambda: F.degrees("angla"), "ANGLV": lambda: F.degrees("anglv"), "DEPTH": lambda: F.col("depth"), "X": lambda: F.col("x"), "Y": lambda: F.col("y"),
        "PPERF": lambda: F.col("part"), "KH": lambda: F.col("kh"), "RADW": lambda: well_radius, "SKIN": lambda: F.lit(skin), "RADB": lambda: F.col("radb"), "WI": lambda: F.col("wi"),
        "WBC": lambda: F.lit(WELL_CONSTANT[unit]) * F.col("kh") * F.col("wi"), "STAT": lambda: F.lit(stat),
    }
    row = F.row_number().over(Window.partitionBy("well").orderBy("md0", "md1")) - 1
    cells = [(F.col(a) + int(one_based)).alias(n) for n, a in (("IW", "i"), ("JW", "j"), ("L", "k"))]
    return rows.select("well", row.cast("long").alias("row"), *cells, *(made[c]().alias(c) for c in columns))

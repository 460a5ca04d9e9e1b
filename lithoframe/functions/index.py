"""Natural cell numbers: (k * nj + j) * ni + i and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural(k: Column, j: Column, i: Column, nj: int, ni: int) -> Column:
    return (k * nj + j) * ni + i


def denatural(df: DataFrame, nj: int, ni: int, cell: str = "cell_id") -> DataFrame:
    c = F.col(cell)
    return df.withColumns({"k": F.floor(c / (nj * ni)), "j": F.floor(c / ni) % nj, "i": c % ni})

"""Matrices that grow with a stream: the running sum of a cell is the state, one value a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import INTEGER, ScalarType


def accumulate(stream: DataFrame, row: Column, col: Column, val: Column, row_level: int, col_level: int, stype: ScalarType = INTEGER) -> DataFrame:
    """row, col, val of a streaming table, for update or complete mode. A cell whose values cancel is given as zero, so that
    readers of updates learn of it. Rows with a null in any of the three are left out."""
    cut = stream.select(F.pmod(row.cast("long"), F.lit(1 << row_level)).alias("row"), F.pmod(col.cast("long"), F.lit(1 << col_level)).alias("col"), val.cast(stype.dtype).alias("val"))
    return cut.where("row IS NOT NULL AND col IS NOT NULL AND val IS NOT NULL").groupBy("row", "col").agg(stype.total(F.col("val")).alias("val"))

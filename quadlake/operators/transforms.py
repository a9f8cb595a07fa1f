"""Walsh-Hadamard and Fourier transforms by butterflies: level passes of an explode and a partial sum, with no join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import COMPLEX
from ..matrix import Matrix
from ..plans.staging import cut
from ..sources.build import root_of_unity

EVERY = 8  # passes between cuts of the lineage


def _passes(m: Matrix, along: str, step) -> Matrix:
    df = m.df
    other = "col" if along == "row" else "row"
    for k in range(m.row_level if along == "row" else m.col_level):
        low = F.col(along).bitwiseAND(F.lit(~(1 << k)).cast("long"))
        high = F.shiftright(along, k).bitwiseAND(F.lit(1)) == 1
        to_low, to_high = step(k, low, high)
        both = df.select(other, F.explode(F.array(F.struct(low.alias("i"), to_low.alias("v")), F.struct((low + F.lit(1 << k)).alias("i"), to_high.alias("v")))).alias("x"))
        df = m.stype.sum_by(both.select(F.col("x.i").alias(along), other, F.col("x.v").alias("val")), ["row", "col"])
        if k % EVERY == EVERY - 1:
            df = cut(df)
    return Matrix(df.select("row", "col", "val"), m.row_level, m.col_level, m.stype)


def _walsh(m: Matrix, along: str) -> Matrix:
    if (m.row_level if along == "row" else m.col_level) < 1:
        raise ValueError("level must be at least 1")
    v = F.col("val")
    return _passes(m, along, lambda k, low, high: (v, F.when(high, m.stype.minus(v)).otherwise(v)))


def hadamard_times(m: Matrix) -> Matrix:
    """H m, for the Hadamard matrix of m's rows."""
    return _walsh(m, "row")


def times_hadamard(m: Matrix) -> Matrix:
    return _walsh(m, "col")


def fourier(m: Matrix) -> Matrix:
    """F m: the columns' sums of val e^(2 pi i jk / n). Rows are put in the order of their reversed bits first."""
    if m.stype is not COMPLEX:
        raise ValueError("complex scalars are needed")
    back = F.lit(0).cast("long")
    for k in range(m.row_level):
        back = back.bitwiseOR(F.shiftleft(F.shiftright("row", k).bitwiseAND(F.lit(1).cast("long")), m.row_level - 1 - k))
    turned = Matrix(m.df.select(back.alias("row"), "col", "val"), m.row_level, m.col_level, COMPLEX)

    def step(k, low, high):
        w = root_of_unity(F.pmod(low, F.lit(1 << k)), 2 << k)
        v = F.when(high, COMPLEX.times(w, F.col("val"))).otherwise(F.col("val"))
        return v, F.when(high, COMPLEX.minus(v)).otherwise(v)

    return _passes(turned, "row", step)

"""Matrices from formulas: each is one projection of a range of cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import COMPLEX, INTEGER, ScalarType
from ..matrix import SPARSE, Matrix, cells


PART_BYTES = 2 << 20  # of a file, for a task that sums sparse cells


def zero(spark: SparkSession, r: int, c: int, stype: ScalarType = INTEGER) -> Matrix:
    return Matrix(spark.createDataFrame([], f"row bigint, col bigint, val {stype.dtype}"), r, c, stype)


def identity(spark: SparkSession, level: int, stype: ScalarType = INTEGER) -> Matrix:
    return Matrix(spark.range(1 << level).select(F.col("id").alias("row"), F.col("id").alias("col"), stype.one().alias("val")), level, level, stype)


def constant(spark: SparkSession, value, r: int, c: int, stype: ScalarType = INTEGER) -> Matrix:
    df = cells(spark, r, c).withColumn("val", stype.lit(value))
    return Matrix(df.where(stype.nonzero(F.col("val"))), r, c, stype)


def scalar(spark: SparkSession, value, stype: ScalarType = INTEGER) -> Matrix:
    return constant(spark, value, 0, 0, stype)


def hadamard(spark: SparkSession, level: int, stype: ScalarType = INTEGER) -> Matrix:
    """Entries 1 and -1 by the parity of the bits that row and column share."""
    odd = F.bit_count(F.col("row").bitwiseAND(F.col("col"))) % 2 == 1
    df = cells(spark, level, level).withColumn("val", F.when(odd, stype.minus(stype.one())).otherwise(stype.one()))
    return Matrix(df, level, level, stype)


def one_hot(spark: SparkSession, level: int, i: int, j: int, value, stype: ScalarType = INTEGER) -> Matrix:
    return zero(spark, level, level, stype).replaced(i, j, value)


def not_gate(spark: SparkSession, stype: ScalarType = INTEGER) -> Matrix:
    return inverse_shuffle(spark, 1, stype).replaced(0, 0, 0).replaced(1, 1, 0).replaced(0, 1, 1).replaced(1, 0, 1)


def globals_of(spark: SparkSession, stype: ScalarType = INTEGER) -> dict[str, Matrix]:
    """Constants by name: 0, 1 and -1; halves where the type is no integer; i and its halves where it is complex; and the
    2 by 2 identity, negation and Hadamard matrices."""
    out = {"0": scalar(spark, 0, stype), "1": scalar(spark, 1, stype)}
    signed = stype.name not in ("BOOLEAN", "UPPER", "LOWER")
    if signed:
        out["-1"] = scalar(spark, -1, stype)
    if signed and stype.name not in ("INTEGER", "MPINTEGER"):
        out |= {k: scalar(spark, v, stype) for k, v in (("1/2", "0.5"), ("-1/2", "-0.5"))}  # exact in every type
    if stype.complex and stype.name != "CLIFFORD":
        out |= {k: scalar(spark, v, stype) for k, v in (("i", "0+I*1"), ("-i", "0-I*1"), ("i/2", "0+I*0.5"), ("-i/2", "0-I*0.5"))}
    if stype.name == "CLIFFORD":
        out |= {k: scalar(spark, v, stype) for k, v in (("1/2", "(1/2)*{1}"), ("-1/2", "-(1/2)*{1}"), ("i", "{1}*I"), ("-i", "-{1}*I"), ("i/2", "(1/2)*{1}*I"), ("-i/2", "-(1/2)*{1}*I"))}
    out |= {"I1": identity(spark, 1, stype), "NOT": not_gate(spark, stype)}
    return out | ({"HH1": hadamard(spark, 1, stype)} if signed else {})


def from_quadrants(a: Matrix, b: Matrix, c: Matrix, d: Matrix) -> Matrix:
    """[a b; c d]."""
    return a.join(b).stack(c.join(d))


def root_of_unity(k, n: int):
    """e^(2 pi i k / n) as a complex column; k is a column or a number."""
    angle = F.lit(2 * math.pi / n) * (k if not isinstance(k, int) else F.lit(k % n))
    return COMPLEX.pair(F.cos(angle), F.sin(angle))


def roots_of_unity(spark: SparkSession, power: int) -> DataFrame:
    """k and the k-th power of the principal 2^power-th root of one."""
    return spark.range(1 << power).select(F.col("id").alias("k"), root_of_unity(F.col("id"), 1 << power).alias("val"))


def inverse_shuffle(spark: SparkSession, m: int, stype: ScalarType = INTEGER) -> Matrix:
    """The permutation that parts even from odd places."""
    n = 1 << m
    col = (2 * F.col("id")) % n + F.when(F.col("id") >= n // 2, F.lit(1)).otherwise(F.lit(0))
    return Matrix(spark.range(n).select(F.col("id").alias("row"), col.cast("long").alias("col"), stype.one().alias("val")), m, m, stype)


def fft_diagonal(spark: SparkSession, m: int) -> Matrix:
    """diag(1, w, w^2, ...) for the 2^(m+1)-th root w."""
    return Matrix(spark.range(1 << m).select(F.col("id").alias("row"), F.col("id").alias("col"), root_of_unity(F.col("id"), 2 << m).alias("val")), m, m, COMPLEX)


def fft_combine(spark: SparkSession, m: int) -> Matrix:
    """[I D; I -D] of level m."""
    if m < 1:
        raise ValueError("level must be at least 1")
    eye, d = identity(spark, m - 1, COMPLEX), fft_diagonal(spark, m - 1)
    return from_quadrants(eye, d, eye, -d)


def fft_matrix(spark: SparkSession, m: int) -> Matrix:
    """e^(2 pi i jk / 2^m), not normalised."""
    n = 1 << m
    df = cells(spark, m, m).withColumn("val", root_of_unity((F.col("row") * F.col("col")) % n, n))
    return Matrix(df, m, m, COMPLEX)


def _least(df: DataFrame, h: str, k: int, ties: list[str], enough: int = 1 << 16) -> DataFrame:
    """The k rows of df whose (h, ties) are least; h is a hash of 60 bits and not negative. Twelve bits a pass are counted,
    until few rows share what has been seen of the k-th; nothing is sorted but those."""
    if k <= 0:
        return df.limit(0)
    done, prefix, taken = 0, 0, 0
    while True:
        here = df.where(F.shiftright(h, 60 - done) == prefix) if done else df
        counts = sorted(here.groupBy(F.shiftright(h, 48 - done).alias("p")).count().collect())  # at most 4096
        for p, n in counts:
            if taken + n >= k:
                break
            taken += n
        done, prefix = done + 12, p
        if n <= enough or done == 60:
            break
    at = F.shiftright(h, 60 - done)
    last = df.where(at == prefix).select(h, *ties).orderBy(h, *ties).limit(k - taken).collect()[-1]
    key = lambda x: F.struct(*x)
    return df.where((at < prefix) | ((at == prefix) & (key([F.col(c) for c in (h, *ties)]) <= key([F.lit(v).cast("long") for v in last]))))


def random_ones(spark: SparkSession, r: int, c: int, ones: int, seed: int = 0, stype: ScalarType = INTEGER) -> Matrix:
    """Exactly ``ones`` entries of 1, any set of cells alike. Numbers are hashed to cells until enough different ones have
    been met, and those met first are taken; where most cells are ones it is the others that are drawn. Up to level sums of 62."""
    cells_ = 1 << (r + c)
    if not 0 <= ones <= cells_:
        raise ValueError("more ones than cells")
    if r + c > 62:
        raise ValueError("at most 2^62 cells")
    few = min(ones, cells_ - ones)
    draws = few + few // 2 + 64
    while True:
        met = spark.range(draws).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(cells_)).alias("cell"), "id")
        met = met.groupBy("cell").agg(F.min("id").alias("h"))
        if not few or met.count() >= few:
            break
        draws *= 2
    drawn = _least(met, "h", few, [])
    if few < ones:
        drawn = spark.range(cells_).withColumnRenamed("id", "cell").join(drawn, "cell", "left_anti")
    df = drawn.select(F.shiftright("cell", c).alias("row"), F.col("cell").bitwiseAND(F.lit((1 << c) - 1).cast("long")).alias("col"), stype.one().alias("val"))
    return Matrix(df, r, c, stype)


def random_entries(spark: SparkSession, r: int, c: int, low: int, high: int, sparsity: float = 0.0, seed: int = 0, stype: ScalarType = INTEGER) -> Matrix:
    """Nonzero whole numbers in [low, high) but for exactly round(sparsity * cells) zeros. Where zeros fall and what the
    others are follows from hashes of the cell, so partitioning doesn't matter."""
    zeros = round(sparsity * (1 << (r + c)))
    cell = cells(spark, r, c).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "row", "col"), 4))
    if zeros:
        cell = cell.join(_least(cell, "h", zeros, ["row", "col"]).select("row", "col"), ["row", "col"], "left_anti")
    value = F.pmod(F.xxhash64(F.lit(seed + 1), "row", "col"), F.lit(high - low)) + F.lit(low)
    value = F.when(value == 0, F.lit(high - 1 if high != 1 else low)).otherwise(value)
    return Matrix(cell.select("row", "col", stype.parse(value.cast("string")).alias("val")), r, c, stype)


def from_numpy(spark: SparkSession, a, stype: ScalarType = INTEGER) -> Matrix:
    """A dense array, padded with zeros to powers of two below and to the right. Numbers go to Spark as Arrow columns."""
    import numpy as np
    import pyarrow as pa

    a = np.atleast_2d(a)
    up = lambda n: max(0, (n - 1).bit_length())
    i, j = np.nonzero(a)
    v = a[i, j]
    cols = {"row": i.astype(np.int64), "col": j.astype(np.int64)}
    if stype is COMPLEX:
        cols |= {"re": v.real.astype(float), "im": v.imag.astype(float)}
        value = COMPLEX.pair(F.col("re"), F.col("im"))
    elif v.dtype.kind in "iuf" and stype.dtype in ("bigint", "double"):
        cols |= {"v": v.astype(np.int64 if v.dtype.kind != "f" else float)}
        value = F.col("v").cast(stype.dtype)
    else:
        cols |= {"v": [str(x.item() if hasattr(x, "item") else x) for x in v]}
        value = stype.parse(F.col("v"))
    if not len(i):
        return zero(spark, up(a.shape[0]), up(a.shape[1]), stype)
    return Matrix(spark.createDataFrame(pa.table(cols)).select("row", "col", value.alias("val")), up(a.shape[0]), up(a.shape[1]), stype)


def from_list(spark: SparkSession, values: list, r: int, c: int, stype: ScalarType = INTEGER) -> Matrix:
    """Row-major values, given as strings or numbers."""
    if len(values) != 1 << (r + c):
        raise ValueError(f"{len(values)} values for {1 << (r + c)} cells")
    df = spark.createDataFrame([(k, str(v)) for k, v in enumerate(values)], "id bigint, s string")
    out = df.select(F.shiftright("id", c).alias("row"), F.col("id").bitwiseAND(F.lit((1 << c) - 1).cast("long")).alias("col"), stype.parse(F.col("s")).alias("val"))
    return Matrix(out.where(stype.nonzero(F.col("val"))), r, c, stype)


def _parts(df: DataFrame) -> int:
    """A part for every PART_BYTES of what df reads, so that a task's share does not grow with the table; 0 where Spark can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return -(-size // PART_BYTES) if 0 < size < 1 << 45 else 0


def from_table(df: DataFrame, row, col, val, r: int, c: int, stype: ScalarType = INTEGER) -> Matrix:
    """Cells from the rows of a table: indexes modulo the dimensions, values summed. Rows with a null in any are left out."""
    cut = df.select(F.pmod(row.cast("long"), F.lit(1 << r)).alias("row"), F.pmod(col.cast("long"), F.lit(1 << c)).alias("col"), val.cast(stype.dtype).alias("val"))
    cut = cut.where("row IS NOT NULL AND col IS NOT NULL AND val IS NOT NULL")
    if r + c > SPARSE:
        # rows of a table seldom share a cell here: partial sums would hold every row of a file's part and combine next to none.
        # Dealt out by row, cells are summed where products and sums by row find them.
        parts = _parts(df)
        cut = cut.repartition(parts, "row") if parts else cut.repartition("row")
    return Matrix(stype.sum_by(cut, ["row", "col"]), r, c, stype)

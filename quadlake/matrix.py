"""A matrix of 2^row_level by 2^col_level as a lazy DataFrame of its nonzero entries: row, col, val.

Levels and scalar type are known on the driver, so shapes are checked before any plan is built. Every operator is a plan
of joins, partial aggregates and projections; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import INTEGER, ScalarType

MAX_LEVEL = 32
SPARSE = 40  # levels of rows and columns together, beyond which terms are not summed where they arise: they seldom share a cell


def morton(row: Column, col: Column, row_level: int, col_level: int) -> Column:
    """The place of an entry in the order of quadrants: bits of row and column in turn, both aligned at the top. At level 32
    all 64 bits are used, and the highest is turned over, so that the order of signed integers is that of places."""
    top = max(row_level, col_level)
    row, col = F.shiftleft(row, top - row_level), F.shiftleft(col, top - col_level)
    bit = lambda x, k, to: F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)).cast("long"), to)
    out = F.lit(0).cast("long")
    for k in range(top):
        out = out.bitwiseOR(bit(row, k, 2 * k + 1)).bitwiseOR(bit(col, k, 2 * k))
    return out.bitwiseXOR(F.lit(-(1 << 63))) if top == MAX_LEVEL else out


def reduced(t: ScalarType, terms: DataFrame) -> DataFrame:
    """One row with the sum of val; zero for no terms."""
    if type(t).__name__ == "Exact":
        return t.sum_by(terms, []).agg(F.first("val").alias("val")).select(F.coalesce("val", t.zero()).alias("val"))
    total = terms.agg(t.total(F.col("val")).alias("val"))
    if t.name == "COMPLEX":
        return total.select(t.pair(F.coalesce("val.re", F.lit(0.0)), F.coalesce("val.im", F.lit(0.0))).alias("val"))
    return total.select(F.coalesce("val", t.zero()).alias("val"))


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    row_level: int
    col_level: int
    stype: ScalarType = INTEGER
    info: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not (0 <= self.row_level <= MAX_LEVEL and 0 <= self.col_level <= MAX_LEVEL):
            raise ValueError(f"levels must lie between 0 and {MAX_LEVEL}")

    # -- shape -------------------------------------------------------------------------------------------------------

    @property
    def kind(self) -> str:
        if self.row_level == self.col_level == 0:
            return "SCALAR"
        return "ROW_VECTOR" if self.row_level == 0 else "COL_VECTOR" if self.col_level == 0 else "MATRIX"

    @property
    def shape(self) -> tuple[int, int]:
        return 1 << self.row_level, 1 << self.col_level

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def _with(self, df: DataFrame, row_level: int | None = None, col_level: int | None = None) -> Matrix:
        return Matrix(df, self.row_level if row_level is None else row_level, self.col_level if col_level is None else col_level, self.stype)

    def _same_type(self, other: Matrix) -> None:
        if self.stype is not other.stype:
            raise ValueError(f"{self.stype.name} and {other.stype.name} don't mix")

    def _same_shape(self, other: Matrix) -> None:
        self._same_type(other)
        if (self.row_level, self.col_level) != (other.row_level, other.col_level):
            raise ValueError(f"levels {self.row_level, self.col_level} and {other.row_level, other.col_level} differ")

    def _square(self) -> None:
        if self.row_level != self.col_level:
            raise ValueError("the matrix must be square")

    def _nz(self, df: DataFrame) -> DataFrame:
        return df.where(self.stype.nonzero(F.col("val")))

    def describe(self) -> dict:
        """Levels, type and number of nonzero entries."""
        return {"row_level": self.row_level, "col_level": self.col_level, "type": self.stype.name, "nnz": self.df.count(), **self.info}

    # -- element-wise ------------------------------------------------------------------------------------------------

    def map(self, f: Callable[[Column], Column], stype: ScalarType | None = None) -> Matrix:
        """f on every stored value; f(0) must be 0. See ``apply`` for other functions."""
        stype = stype or self.stype
        out = self.df.select("row", "col", f(F.col("val")).alias("val"))
        return Matrix(out.where(stype.nonzero(F.col("val"))), self.row_level, self.col_level, stype)

    def apply(self, f: Callable[[Column], Column], keeps_zero: bool = False) -> Matrix:
        """f on every value, zeros included: unless f keeps zero, the grid of all cells is filled in first."""
        return self.map(f) if keeps_zero else self._with(self._nz(self.dense().select("row", "col", f(F.col("val")).alias("val"))))

    def dense(self) -> DataFrame:
        """row, col, val for all cells."""
        grid = cells(self.spark, self.row_level, self.col_level)
        return grid.join(self.df, ["row", "col"], "left").select("row", "col", F.coalesce("val", self.stype.zero()).alias("val"))

    def __add__(self, other: Matrix) -> Matrix:
        self._same_shape(other)
        return self._with(self.stype.sum_by(self.df.unionByName(other.df), ["row", "col"]))

    def __sub__(self, other: Matrix) -> Matrix:
        return self + (-other)

    def __neg__(self) -> Matrix:
        return self.map(self.stype.minus)

    def scale(self, a) -> Matrix:
        """a times every entry; a is a Python value, a string or a scalar matrix."""
        if isinstance(a, Matrix):
            self._same_type(a)
            if a.kind != "SCALAR":
                raise ValueError("the factor must be a scalar")
            # one row at most, so broadcasting it is safe at any size
            one = F.broadcast(a.df.select(F.col("val").alias("_a")))
            return self._with(self._nz(self.df.crossJoin(one).select("row", "col", self.stype.times(F.col("_a"), F.col("val")).alias("val"))))
        return self.map(lambda v: self.stype.times(self.stype.lit(a), v))

    def saxpy(self, other: Matrix, a, b) -> Matrix:
        """a self + b other, in one shuffle."""
        self._same_shape(other)
        return self._with(self.stype.sum_by(self.scale(a).df.unionByName(other.scale(b).df), ["row", "col"]))

    def divide(self, b) -> Matrix:
        if not isinstance(b, str) and not b:
            raise ZeroDivisionError("division by zero")
        return self.map(lambda v: self.stype.over(v, self.stype.lit(b)))

    def entry_squared(self, scale=1) -> Matrix:
        """scale |a|^2 of every entry of a square matrix."""
        self._square()
        return self.map(lambda v: self.stype.times(self.stype.lit(scale), self.stype.squared(v)))

    def adjoint(self) -> Matrix:
        return self._with(self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), self.stype.conj(F.col("val")).alias("val")), self.col_level, self.row_level)

    def zeroed_below(self, threshold: float) -> Matrix:
        """Entries smaller than the threshold become zero."""
        return self._with(self.df.where(self.stype.size(F.col("val")) >= threshold))

    def flattened(self, threshold: float, value) -> Matrix:
        """Entries smaller than the threshold become value."""
        small = self.stype.size(F.col("val")) < threshold
        return self.map(lambda v: F.when(small, self.stype.lit(value)).otherwise(v))

    # -- products ----------------------------------------------------------------------------------------------------

    def __matmul__(self, other: Matrix) -> Matrix:
        self._same_type(other)
        if self.kind == "SCALAR":
            return other.scale(self)
        if other.kind == "SCALAR":
            return self.scale(other)
        if self.col_level != other.row_level:
            raise ValueError(f"a product needs equal inner levels, not {self.col_level} and {other.row_level}")
        if self.col_level == 0:
            return self.kron(other)
        a = self.df.select(F.col("row").alias("i"), F.col("col").alias("k"), F.col("val").alias("x"))
        b = other.df.select(F.col("row").alias("k"), F.col("col").alias("j"), F.col("val").alias("y"))
        terms = a.join(b, "k").select(F.col("i").alias("row"), F.col("j").alias("col"), self.stype.times(F.col("x"), F.col("y")).alias("val"))
        if self.row_level + other.col_level > SPARSE:
            # partial sums would hold, and spill, nearly all terms of a join's task without making them much fewer
            terms = terms.repartition("row", "col")
        return Matrix(self.stype.sum_by(terms, ["row", "col"]), self.row_level, other.col_level, self.stype)

    def product(self, other: Matrix, keep_rows: int | None = None) -> Matrix:
        """self @ other. Where the product has more than keep_rows entries it is written out once and read back, so that
        what it was made of need not be kept; the result does not depend on that."""
        out = self @ other
        if keep_rows is None or out.df.limit(keep_rows + 1).count() <= keep_rows:
            return out
        from .plans.staging import cut

        return Matrix(cut(out.df), out.row_level, out.col_level, out.stype)

    def dot(self, other: Matrix) -> DataFrame:
        """val: the product of two vectors. A row by a column conjugates nothing, two rows conjugate the second, two columns the first."""
        self._same_type(other)
        kinds = (self.kind, other.kind)
        if not set(kinds) <= {"ROW_VECTOR", "COL_VECTOR"} or kinds == ("COL_VECTOR", "ROW_VECTOR") or max(self.row_level, self.col_level) != max(other.row_level, other.col_level):
            raise ValueError("two vectors of one length, and not a column by a row")
        t = self.stype
        index = lambda m: (F.col("col") if m.kind == "ROW_VECTOR" else F.col("row")).alias("k")
        x = self.df.select(index(self), (t.conj(F.col("val")) if kinds[0] == "COL_VECTOR" else F.col("val")).alias("x"))
        y = other.df.select(index(other), (t.conj(F.col("val")) if kinds[1] == "ROW_VECTOR" and kinds[0] == "ROW_VECTOR" else F.col("val")).alias("y"))
        return reduced(self.stype, x.join(y, "k").select(t.times(F.col("x"), F.col("y")).alias("val")))

    def kron(self, other: Matrix) -> Matrix:
        """The Kronecker product; it has an entry for every pair of entries, so a cross join is what it is. Spark broadcasts a
        side that is known to be small, and else pairs the partitions of both. ``quadtree.kron`` works on distinct blocks."""
        self._same_type(other)
        r, c = self.row_level + other.row_level, self.col_level + other.col_level
        b = other.df.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("val").alias("v2"))
        out = self.df.crossJoin(b).select((F.shiftleft("row", other.row_level) + F.col("r2")).alias("row"), (F.shiftleft("col", other.col_level) + F.col("c2")).alias("col"), self.stype.times(F.col("val"), F.col("v2")).alias("val"))
        return Matrix(self._nz(out), r, c, self.stype)

    def identity_kron(self, level: int) -> Matrix:
        """I (of a level) by this matrix: a copy of each entry in every diagonal block, made in place."""
        blocks = self.df.select("row", "col", "val", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << level) - 1).cast("long"))).alias("_b"))
        out = blocks.select((F.shiftleft("_b", self.row_level) + F.col("row")).alias("row"), (F.shiftleft("_b", self.col_level) + F.col("col")).alias("col"), "val")
        return self._with(out, self.row_level + level, self.col_level + level)

    def basis_change(self, b: Matrix) -> Matrix:
        """b self b^H."""
        self._square()
        return b @ self @ b.adjoint()

    # -- concatenation -----------------------------------------------------------------------------------------------

    def join(self, other: Matrix) -> Matrix:
        """other to the right of self."""
        self._same_shape(other)
        return self._with(self.df.unionByName(other.df.withColumn("col", F.col("col") + F.lit(1 << self.col_level))), col_level=self.col_level + 1)

    def stack(self, other: Matrix) -> Matrix:
        """other below self."""
        self._same_shape(other)
        return self._with(self.df.unionByName(other.df.withColumn("row", F.col("row") + F.lit(1 << self.row_level))), row_level=self.row_level + 1)

    # -- access ------------------------------------------------------------------------------------------------------

    def quadrant(self, q: int) -> Matrix:
        """A quarter of a matrix, or half of a vector, by its number in [0 1; 2 3]."""
        if self.kind == "SCALAR" or not 0 <= q <= 3 or (self.row_level == 0 and q > 1) or (self.col_level == 0 and q % 2):
            raise ValueError(f"a {self.kind} has no quadrant {q}")
        r, c = max(self.row_level - 1, 0), max(self.col_level - 1, 0)
        lo_r, lo_c = (q >> 1) << r if self.row_level else 0, (q & 1) << c if self.col_level else 0
        part = self.df.where((F.col("row") >= lo_r) & (F.col("row") < lo_r + (1 << r)) & (F.col("col") >= lo_c) & (F.col("col") < lo_c + (1 << c)))
        return self._with(part.select((F.col("row") - lo_r).alias("row"), (F.col("col") - lo_c).alias("col"), "val"), r, c)

    def _inside(self, i: int, j: int) -> None:
        if not (0 <= i < 1 << self.row_level and 0 <= j < 1 << self.col_level):
            raise IndexError(f"no entry {i, j}")

    def at(self, i: int, j: int) -> DataFrame:
        """val: one entry, zero where none is stored."""
        self._inside(i, j)
        found = self.df.where((F.col("row") == i) & (F.col("col") == j)).agg(F.first("val").alias("val"))
        return found.select(F.coalesce("val", self.stype.zero()).alias("val"))

    def at_text(self, i: int, j: int) -> str:
        return self.at(i, j).select(self.stype.text(F.col("val")).alias("t")).first()["t"]

    def replaced(self, i: int, j: int, value) -> Matrix:
        """The matrix with another value in one place."""
        self._inside(i, j)
        one = self.spark.range(1).select(F.lit(i).cast("long").alias("row"), F.lit(j).cast("long").alias("col"), self.stype.lit(value).alias("val"))
        return self._with(self.df.where(~((F.col("row") == i) & (F.col("col") == j))).unionByName(self._nz(one)))

    def value_text(self) -> str:
        """The value of a scalar; empty for all other shapes."""
        return self.at_text(0, 0) if self.kind == "SCALAR" else ""

    def is_invalid(self) -> bool:
        """Whether any entry lies outside, occurs twice, is null or is a zero that should not be stored."""
        inside = F.col("row").between(0, (1 << self.row_level) - 1) & F.col("col").between(0, (1 << self.col_level) - 1)
        odd = self.df.where(~F.coalesce(inside & F.col("val").isNotNull() & self.stype.nonzero(F.col("val")), F.lit(False)))
        return not odd.isEmpty() or not self.df.groupBy("row", "col").count().where("count > 1").isEmpty()

    def is_zero(self) -> bool:
        return self.df.isEmpty()

    def is_identity(self) -> bool:
        self._square()
        n, odd = self.df.agg(F.count(F.lit(1)), F.count_if((F.col("row") != F.col("col")) | ~self.stype.same(F.col("val"), self.stype.one()))).first()
        return n == 1 << self.row_level and not odd

    def equals(self, other: Matrix) -> bool:
        """Whether all entries are equal; one shuffle, and no pair is compared twice."""
        if (self.row_level, self.col_level, self.stype) != (other.row_level, other.col_level, other.stype):
            return False
        both = self.df.withColumn("s", F.lit(1)).unionByName(other.df.withColumn("s", F.lit(-1)))
        return both.groupBy("row", "col", "val").agg(F.sum("s").alias("s")).where("s <> 0").isEmpty()

    def locate(self, value, most: int | None = None) -> DataFrame:
        """row, col of the entries that equal value, in the order of quadrants. More than ``most`` are an error."""
        t = self.stype
        nonzero = self._is_nonzero(value)
        if most is not None and self.count(value).first()[0] > most:
            raise ValueError(f"more than {most} entries")
        # zeros that are not too many leave a grid that is no larger than they and the entries together
        hit = (self.df if nonzero else self.dense()).where(t.same(F.col("val"), t.lit(value)))
        return hit.orderBy(morton(F.col("row"), F.col("col"), self.row_level, self.col_level)).select("row", "col")

    def _is_nonzero(self, value) -> bool:
        return self.spark.range(1).select(self.stype.nonzero(self.stype.lit(value))).first()[0]

    def scalars(self) -> DataFrame:
        """The different values, zero included where an entry is zero."""
        kinds = self.df.select("val").distinct()
        cells_ = 1 << (self.row_level + self.col_level)
        zero = self.df.agg((F.count(F.lit(1)).cast("decimal(38,0)") < F.lit(str(cells_)).cast("decimal(38,0)")).alias("_z")).where("_z").select(self.stype.zero().alias("val"))
        return kinds.unionByName(zero)

    # -- reductions --------------------------------------------------------------------------------------------------

    def trace(self) -> DataFrame:
        self._square()
        return reduced(self.stype, self.df.where("row = col").select("val"))

    def trace_norm(self, scale=1) -> DataFrame:
        """scale tr(A^H A), which is the sum of |a|^2: no product is formed."""
        t = self.stype
        return reduced(self.stype, self.df.select(t.times(t.lit(scale), t.squared(F.col("val"))).alias("val")))

    def norm(self, which: int = 0) -> DataFrame:
        """Entry by entry: 0 the largest |a|, 1 the sum of |a|, 2 the root of the sum of |a|^2; val is the type's norm."""
        t = self.stype
        if which == 1:
            return self.df.agg(F.coalesce(F.sum(t.size(F.col("val"))), F.lit(0)).alias("val"))
        if which == 2:
            x = t.size(F.col("val")).cast("double")
            return self.df.agg(F.sqrt(F.coalesce(F.sum(x * x), F.lit(0.0))).alias("val"))
        return self.df.agg(F.coalesce(F.max(t.size(F.col("val"))), F.lit(0)).alias("val"))

    def max_element(self) -> DataFrame:
        """row, col, val of the largest |a|, the first of equals in the order of quadrants."""
        place = F.struct(self.stype.size(F.col("val")).alias("n"), F.bitwise_not(morton(F.col("row"), F.col("col"), self.row_level, self.col_level)).alias("m"))
        return self.df.agg(F.max_by(F.struct("row", "col", "val"), place).alias("x")).select("x.*")

    def count(self, value) -> DataFrame:
        """val: how many entries equal value, as a decimal. Zeros are counted without being made."""
        t = self.stype
        if self._is_nonzero(value):
            return self.df.agg(F.count_if(t.same(F.col("val"), t.lit(value))).cast("decimal(38,0)").alias("val"))
        n = F.lit(str(1 << (self.row_level + self.col_level))).cast("decimal(38,0)")
        return self.df.agg((n - F.count(F.lit(1)).cast("decimal(38,0)")).cast("decimal(38,0)").alias("val"))

    def block_sums(self, k: int) -> Matrix:
        """The sums of blocks of 2^k by 2^k."""
        r, c = min(k, self.row_level), min(k, self.col_level)
        cut = self.df.select(F.shiftright("row", r).alias("row"), F.shiftright("col", c).alias("col"), "val")
        return self._with(self.stype.sum_by(cut, ["row", "col"]), self.row_level - r, self.col_level - c)


def cells(spark: SparkSession, row_level: int, col_level: int) -> DataFrame:
    """row and col of every cell, from one range: no join."""
    if row_level + col_level > 62:
        raise ValueError("too many cells to be made one by one; matrices of that size stay in compressed form (plans/quadtree.py)")
    ids = spark.range(1 << (row_level + col_level))
    return ids.select(F.shiftright("id", col_level).alias("row"), F.col("id").bitwiseAND(F.lit((1 << col_level) - 1).cast("long")).alias("col"))


def quad_at(i: int, j: int, level: int) -> int:
    """The quadrant, of a submatrix of this level, that holds entry (i, j)."""
    return 2 * (i >> (level - 1) & 1) + (j >> (level - 1) & 1)

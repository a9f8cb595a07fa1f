"""Scalar regions: values that lie close together count as one, the first of them in a fixed order.

Order is preloaded constants, then entries in the order of quadrants. Snapping is asked for, never implied.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix, morton
from ..plans.staging import cut
from .scalars import COMPLEX, REAL, ScalarType

# Constants that come before any entry.
PRELOADED = (0.0, 1.0, -1.0, 0.5, -0.5)
DEFAULT_BITS = 45


def region_key(x: Column, bits: int = DEFAULT_BITS, zero_bits: int | None = None) -> Column:
    """The centre of the region of x in units of 2^-bits: halves go away from zero. With fewer zero_bits, the region
    of zero is wider. Where doubles are further apart than regions, x is its own region."""
    scaled = F.abs(x) * F.lit(2.0**bits)
    key = F.signum(x) * F.when(scaled < 2.0**52, F.floor(F.least(scaled, F.lit(2.0**52)) + F.lit(0.5)).cast("double")).otherwise(scaled)
    if zero_bits is not None and zero_bits < bits:
        edge = 2.0 ** (-zero_bits - 1) - 2.0 ** (-bits - 1) if zero_bits < bits - 1 else 2.0 ** (-bits - 1)
        key = F.when(F.abs(key) < F.lit(edge * 2.0**bits), F.lit(0.0)).otherwise(key)
    return key + F.lit(0.0)


def region_center(x: Column, bits: int = DEFAULT_BITS, zero_bits: int | None = None) -> Column:
    return region_key(x, bits, zero_bits) / F.lit(2.0**bits)


def _numbered(m: Matrix):
    return m.df.withColumn("_o", morton(F.col("row"), F.col("col"), m.row_level, m.col_level))


def snap_single(m: Matrix, bits: int = DEFAULT_BITS, zero_bits: int | None = None) -> Matrix:
    """Every value becomes the first of its region."""
    if m.stype not in (REAL, COMPLEX):
        return m
    parts = ("val",) if m.stype is REAL else ("val.re", "val.im")
    df = _numbered(m).select("row", "col", "val", "_o", F.array(*(region_key(F.col(p), bits, zero_bits) for p in parts)).alias("_k"))
    pre = m.spark.createDataFrame([(k, x) for k, x in enumerate(PRELOADED)], "o int, x double")
    pre = pre.select((F.col("x") if m.stype is REAL else COMPLEX.pair(F.col("x"), F.lit(0.0))).alias("val"), (F.col("o") - len(PRELOADED)).cast("long").alias("_o"))
    pre = pre.withColumn("_k", F.array(*(region_key(F.col(p), bits, zero_bits) for p in parts)))
    first = df.select("val", "_o", "_k").unionByName(pre).groupBy("_k").agg(F.min_by("val", "_o").alias("_v"))
    out = df.join(first, "_k").select("row", "col", F.col("_v").alias("val"))
    return Matrix(out.where(m.stype.nonzero(F.col("val"))), m.row_level, m.col_level, m.stype)


def claims(tiles: pd.DataFrame) -> pd.DataFrame:
    """Owners of tiles that lie side by side: in order of arrival a value takes its tile, if no other has, and the free
    neighbours on the side of the half, or the quarter, it lies in."""
    owner: dict[tuple, object] = {}
    places = [tuple(t) for t in tiles["tile"]]
    for at in tiles["o"].argsort(kind="stable").tolist():
        tile, x = places[at], tiles["x"].iat[at]
        if tile in owner:
            continue
        owner[tile] = x
        ahead = [t + d for t, d in zip(tile, tiles["side"].iat[at])]
        for other in itertools.product(*zip(tile, ahead)):
            owner.setdefault(other, x)
    return pd.DataFrame({"tile": tiles["tile"], "v": [owner[t] for t in places]})


def _islands(tiles: DataFrame) -> DataFrame:
    """tile, at: occupied tiles and a name that those share which touch, directly or through others. Names go to neighbours,
    and pointers are doubled, until nothing changes; rounds grow with the logarithm of an island's width."""
    one = tiles.select("tile", F.to_json(F.struct("tile")).alias("id"))
    wide = len(tiles.select("tile").first()["tile"]) if not tiles.isEmpty() else 1
    steps = [(1.0,)] if wide == 1 else [(1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, -1.0)]
    ahead = F.explode(F.array(*(F.array(*(F.col("tile")[k] + d for k, d in enumerate(s))) for s in steps)))
    edges = one.select(F.col("id").alias("a"), ahead.alias("tile")).join(one.withColumnRenamed("id", "b"), "tile").select("a", "b").where("a <> b")
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    names = cut(one.select("id", F.col("id").alias("at")))
    while True:
        near = edges.join(names, edges["b"] == names["id"]).groupBy(F.col("a").alias("id")).agg(F.min("at").alias("least"))
        low = cut(names.join(near, "id", "left").select("id", F.least("at", F.coalesce("least", "at")).alias("at"), F.col("at").alias("was")))
        over = low.select(F.col("id").alias("at"), F.col("at").alias("further"))
        new = cut(low.join(over, "at").select("id", "was", F.least("at", "further").alias("at")))
        names = new.select("id", "at")
        if new.where("at <> was").isEmpty():
            return one.join(names, "id").select("tile", "at")


def snap_adjacent(m: Matrix, bits: int = DEFAULT_BITS) -> Matrix:
    """Real or complex values become the owners of their tiles. Only the first value of a tile matters, and only occupied
    tiles that touch act on each other, so islands of them are solved side by side, each in one task: their rule is
    sequential. Other types have no tiles, and stay."""
    if m.stype not in (REAL, COMPLEX):
        return m
    parts = ("val",) if m.stype is REAL else ("val.re", "val.im")

    def tiled(df: DataFrame) -> DataFrame:
        def tile(p: str) -> Column:
            scaled = F.col(p) * F.lit(2.0**bits)
            small = F.abs(scaled) < 2.0**52
            return F.when(small, F.floor(F.when(small, scaled).otherwise(F.lit(0.0))).cast("double")).otherwise(scaled) + F.lit(0.0)

        return df.withColumn("tile", F.array(*(tile(p) for p in parts)))

    df = tiled(_numbered(m))
    pre = m.spark.createDataFrame([(x, k - len(PRELOADED)) for k, x in enumerate(PRELOADED)], "x double, _o bigint")
    pre = tiled(pre.select((F.col("x") if m.stype is REAL else COMPLEX.pair(F.col("x"), F.lit(0.0))).alias("val"), "_o"))
    first = df.select("val", "_o", "tile").unionByName(pre).groupBy("tile").agg(F.min_by("val", "_o").alias("val"), F.min("_o").alias("o"))
    side = F.array(*(F.when(F.col(p) * F.lit(2.0**bits) - F.col("tile")[k] < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0)) for k, p in enumerate(parts)))
    first = cut(first.select("tile", F.array(*(F.col(p) for p in parts)).alias("x"), "o", side.alias("side")))
    placed = cut(first.join(_islands(first), "tile"))
    alone = placed.groupBy("at").count().where("count = 1").select("at")
    single = placed.join(alone, "at", "left_semi").select("tile", F.col("x").alias("v"))
    several = placed.join(alone, "at", "left_anti").select("at", "tile", "x", "o", "side")
    owners = several.groupBy("at").applyInPandas(claims, "tile array<double>, v array<double>").unionByName(single)
    value = F.col("v")[0] if m.stype is REAL else COMPLEX.pair(F.col("v")[0], F.col("v")[1])
    out = df.drop("val").join(owners, "tile").select("row", "col", value.alias("val"))
    return Matrix(out.where(m.stype.nonzero(F.col("val"))), m.row_level, m.col_level, m.stype)


def regional(op: Callable[..., Matrix], snap: Callable[[Matrix], Matrix] = snap_single) -> Callable[..., Matrix]:
    """An operator whose results are snapped, as if every scalar ever made went through regions."""
    return lambda *a, **k: snap(op(*a, **k))


class RegionStore:
    """Representatives that outlive a matrix: the first value of a region that was ever stored stands for all later ones."""

    def __init__(self, spark: SparkSession, stype: ScalarType = REAL, bits: int = DEFAULT_BITS, zero_bits: int | None = None):
        if stype not in (REAL, COMPLEX):
            raise ValueError("only real and complex scalars have regions")
        self.stype, self.bits, self.zero_bits, self.stored = stype, bits, zero_bits, 0
        pre = spark.createDataFrame([(x, k) for k, x in enumerate(PRELOADED)], "x double, born bigint")
        pre = pre.select((F.col("x") if stype is REAL else COMPLEX.pair(F.col("x"), F.lit(0.0))).alias("val"), (F.col("born") - len(PRELOADED)).alias("born"))
        self.table = cut(self._keyed(pre).groupBy("key").agg(F.min_by("val", "born").alias("val"), F.min("born").alias("born")))

    def _keyed(self, df: DataFrame) -> DataFrame:
        parts = ("val",) if self.stype is REAL else ("val.re", "val.im")
        return df.withColumn("key", F.array(*(region_key(F.col(p), self.bits, self.zero_bits) for p in parts)))

    def snap(self, m: Matrix) -> Matrix:
        """m with its values' representatives; regions that were free are taken by m's first values in the order of quadrants."""
        if m.stype is not self.stype:
            raise ValueError(f"the store holds {self.stype.name}")
        mine = self._keyed(_numbered(m))
        new = mine.groupBy("key").agg(F.min_by("val", "_o").alias("val")).join(self.table, "key", "left_anti")
        self.stored += 1
        self.table = cut(self.table.unionByName(new.select("key", "val", F.lit(self.stored).cast("bigint").alias("born"))))
        out = mine.drop("val").join(self.table, "key").select("row", "col", "val")
        return Matrix(out.where(m.stype.nonzero(F.col("val"))), m.row_level, m.col_level, m.stype)

    def clean(self, *kept: Matrix) -> int:
        """Drops representatives that no kept matrix has, preloaded ones excepted; gives their number."""
        before = self.table.count()
        used = self.table.where("born < 0").select("key")
        for m in kept:
            used = used.unionByName(self._keyed(m.df.select("val").distinct()).select("key"))
        self.table = cut(self.table.join(used.distinct(), "key", "left_semi"))
        return before - self.table.count()

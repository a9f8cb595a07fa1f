"""Matrices as tables of shared quadrants: a row a distinct block, named by a hash of its contents.

``compress`` merges bottom-up, three levels to an aggregation; ``expand`` goes down from the root, one join a level. Equal
blocks have equal names everywhere, so two matrices are equal when their roots are, and work on a block is done once however
often the block occurs. Algebra stays in this form: what it costs follows the number of distinct blocks, not of entries, so
that a matrix of 2^32 by 2^32 equal entries is a table of 33 rows that can be mapped, multiplied and counted.

Blocks of zeros have names of their own (``z`` and their levels) and stand in the table where something refers to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import INTEGER, ScalarType
from ..matrix import Matrix, reduced
from .staging import cut, drop

QUADS = ("q0", "q1", "q2", "q3")
EVERY = 4  # levels between cuts of the lineage, where levels are only gone through
PASS = 3  # levels that one aggregation of ``compress`` merges: up to 64 names meet in a row
FEW = 20_000  # a table of up to so many blocks, once that is known, is renamed and counted on the driver
NODES = "id string, row_level int, col_level int, q0 string, q1 string, q2 string, q3 string, scalar string"


def path(row_level: int, col_level: int) -> list[tuple[int, int]]:
    """Levels from the scalar up to the matrix: vectors merge along their own side first, then both sides do."""
    return [(max(0, row_level - k), max(0, col_level - k)) for k in range(max(row_level, col_level), -1, -1)]


def zero_id(r: int, c: int) -> str:
    return f"z{r}.{c}"


def node_id(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("-")) for p in parts)))


def named(*parts: str | None) -> str:
    """``node_id`` of values that the driver has."""
    return hashlib.md5("|".join("-" if p is None else p for p in parts).encode()).hexdigest()


def is_zero(name: Column) -> Column:
    return F.startswith(name, F.lit("z"))


def _block(r: int, c: int, r0: int, c0: int, quads: list[Column]) -> Column:
    """The name of a block of levels (r, c) by those of its quadrants, of levels (r0, c0)."""
    zero = fold(lambda a, b: a & b, (F.coalesce(q == zero_id(r0, c0), F.lit(True)) for q in quads))
    return F.when(zero, F.lit(zero_id(r, c))).otherwise(node_id(F.lit(f"{r},{c}"), *quads))


def _leaf(t: ScalarType, v: Column) -> Column:
    return F.when(t.nonzero(v), node_id(F.lit("s"), t.text(v))).otherwise(F.lit(zero_id(0, 0)))


@dataclass(frozen=True)
class NodeTable:
    """nodes: id, row_level, col_level, q0 to q3 (null where a vector has none), scalar (text, null above level 0).
    canonical: names are those that ``compress`` gives; files have others."""

    nodes: DataFrame
    root: str
    row_level: int
    col_level: int
    stype: ScalarType
    canonical: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @cached_property
    def few(self) -> dict[str, Row] | None:
        """All blocks by name, if they are no more than FEW: names and numbers of a level after level then need no jobs."""
        got = self.nodes.select("id", "row_level", "col_level", *QUADS, "scalar").limit(FEW + 1).collect()
        return {x["id"]: x for x in got} if len(got) <= FEW else None

    def levelled(self) -> dict[tuple[int, int], list[Row]]:
        """The few blocks by their levels."""
        out: dict[tuple[int, int], list[Row]] = {}
        for x in self.few.values():
            out.setdefault((x["row_level"], x["col_level"]), []).append(x)
        return out

    @property
    def steps(self) -> list[tuple[int, int]]:
        return path(self.row_level, self.col_level)

    def at(self, r: int, c: int) -> DataFrame:
        return self.nodes.where((F.col("row_level") == r) & (F.col("col_level") == c))

    def kids(self, r: int, c: int, which: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
        """up, q, id: the quadrants of the blocks of a level."""
        return self.at(r, c).select(F.col("id").alias("up"), F.posexplode(F.array(*QUADS)).alias("q", "id")).where("id IS NOT NULL").where(F.col("q").isin(*which))

    def leaves(self) -> DataFrame:
        """id and val of the distinct scalars."""
        return self.at(0, 0).select("id", self.stype.parse(F.col("scalar")).alias("val"))

    def size(self) -> int:
        """Distinct blocks, scalars included."""
        return self.nodes.count()

    def unique_scalars(self) -> DataFrame:
        return self.nodes.where("scalar IS NOT NULL").select("scalar")

    def histogram(self) -> DataFrame:
        return self.nodes.groupBy("row_level", "col_level").count()

    def describe(self) -> dict:
        """Levels, type, distinct blocks and distinct scalars."""
        n, s = self.nodes.agg(F.count(F.lit(1)), F.count("scalar")).first()
        return {"row_level": self.row_level, "col_level": self.col_level, "type": self.stype.name, "blocks": n, "scalars": s}

    def same(self, other: NodeTable) -> bool:
        x, y = canonical(self), canonical(other)
        return (x.root, x.row_level, x.col_level, x.stype) == (y.root, y.row_level, y.col_level, y.stype)

    def find(self, quads: DataFrame) -> DataFrame:
        """The nodes whose quadrants are these: quads has q0 to q3."""
        on = [self.nodes[q].eqNullSafe(quads[q]) for q in QUADS]
        return self.nodes.where("scalar IS NULL").join(quads, on, "left_semi")

    # -- going down --------------------------------------------------------------------------------------------------

    def multiplicities(self, diagonal: bool = False) -> DataFrame:
        """val and n: the nonzero scalars, and how many entries (on the diagonal) have them. No entry is made."""
        x = canonical(self)
        if x.few is not None:
            many = {} if x.root.startswith("z") else {x.root: 1}
            for _ in x.steps[:0:-1]:
                below: dict[str, int] = {}
                for name, n in many.items():
                    for q in QUADS[::3] if diagonal else QUADS:
                        kid = x.few[name][q]
                        if kid and not kid.startswith("z"):
                            below[kid] = below.get(kid, 0) + n
                many = below
            front = x.spark.createDataFrame([(k, Decimal(n)) for k, n in many.items()], "id string, n decimal(38,0)")
            return front.join(x.leaves(), "id").select("val", "n")
        front = x.spark.createDataFrame([(x.root, 1)], "id string, n int").select("id", F.col("n").cast("decimal(38,0)").alias("n")).where(~is_zero(F.col("id")))
        for k, (r, c) in enumerate(x.steps[:0:-1]):
            kids = x.kids(r, c, (0, 3) if diagonal else (0, 1, 2, 3)).where(~is_zero(F.col("id"))).withColumnRenamed("id", "kid")
            front = front.join(kids, F.col("id") == F.col("up")).groupBy(F.col("kid").alias("id")).agg(F.sum("n").cast("decimal(38,0)").alias("n"))
            if k % EVERY == EVERY - 1:
                front = cut(front)
        return front.join(x.leaves(), "id").select("val", "n")

    def count(self, value) -> DataFrame:
        """val: entries equal to value, from counts of blocks: nothing is expanded."""
        t = self.stype
        many = self.multiplicities()
        zero, hit = self.spark.range(1).select(~t.nonzero(t.lit(value))).first()[0], t.same(F.col("val"), t.lit(value))
        if zero:
            all_ = F.lit(str(1 << (self.row_level + self.col_level))).cast("decimal(38,0)")
            return many.agg((all_ - F.coalesce(F.sum("n"), F.lit(0))).cast("decimal(38,0)").alias("val"))
        return many.where(hit).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)").alias("val"))

    def _times(self, many: DataFrame, value: Column) -> DataFrame:
        return many.select(self.stype.times(self.stype.parse(F.col("n").cast("string")), value).alias("val"))

    def trace(self) -> DataFrame:
        """val: blocks on the diagonal are counted, and their scalars summed."""
        if self.row_level != self.col_level:
            raise ValueError("the matrix must be square")
        return reduced(self.stype, self._times(self.multiplicities(diagonal=True), F.col("val")))

    def total(self) -> DataFrame:
        """val: the sum of all entries."""
        return reduced(self.stype, self._times(self.multiplicities(), F.col("val")))

    def trace_norm(self, scale=1) -> DataFrame:
        t = self.stype
        return reduced(t, self._times(self.multiplicities(), t.times(t.lit(scale), t.squared(F.col("val")))))

    def norm(self, which: int = 0) -> DataFrame:
        """As ``Matrix.norm``: 0 the largest |a|, 1 the sum of |a|, 2 the root of the sum of |a|^2."""
        many = self.multiplicities().select(self.stype.size(F.col("val")).alias("s"), "n")
        if which == 0:
            return many.agg(F.coalesce(F.max("s"), F.lit(0)).alias("val"))
        if which == 1:
            real = many.schema["s"].dataType.typeName() == "double"
            return many.agg(F.coalesce(F.sum(F.col("s") * F.col("n").cast("double") if real else (F.col("s") * F.col("n")).cast("decimal(38,0)")), F.lit(0)).alias("val"))
        s = F.col("s").cast("double")
        return many.agg(F.sqrt(F.coalesce(F.sum(s * s * F.col("n").cast("double")), F.lit(0.0))).alias("val"))

    def _holding(self, leaves: DataFrame) -> DataFrame:
        """Names of the blocks that hold one of these leaves (id), from the bottom up."""
        if self.few is not None:
            held, levels = {x["id"] for x in leaves.select("id").collect()}, self.levelled()
            for at in self.steps[1:]:
                held |= {x["id"] for x in levels.get(at, ()) if any(x[q] in held for q in QUADS)}
            return self.spark.createDataFrame([(x,) for x in held], "id string")
        good = cut(leaves.select("id").distinct())
        every = good
        for r, c in self.steps[1:]:
            good = cut(self.kids(r, c).join(good, "id", "left_semi").select(F.col("up").alias("id")).distinct())
            every = every.unionByName(good)
        return cut(every)

    def _down(self, good: DataFrame) -> DataFrame:
        """id, row, col of the scalars under the root, by way of good blocks alone."""
        kids = self.nodes.where("scalar IS NULL").select(F.col("id").alias("up"), "row_level", "col_level", F.posexplode(F.array(*QUADS)).alias("q", "id")).where("id IS NOT NULL")
        kids = cut(kids.join(good, "id", "left_semi"))
        front = self.spark.createDataFrame([(self.root, 0, 0)], "id string, row bigint, col bigint").join(good, "id", "left_semi")
        down = self.steps[::-1]
        for k, ((r, c), (r2, c2)) in enumerate(zip(down, down[1:])):
            here = kids.where((F.col("row_level") == r) & (F.col("col_level") == c)).select("up", "q", F.col("id").alias("kid"))
            row = F.shiftleft("row", r - r2) + (F.shiftright("q", 1) if r > r2 else F.lit(0))
            col = F.shiftleft("col", c - c2) + (F.col("q").bitwiseAND(F.lit(1)) if c > c2 else F.lit(0))
            front = front.join(here, F.col("id") == F.col("up")).select(F.col("kid").alias("id"), row.cast("long").alias("row"), col.cast("long").alias("col"))
            if k % EVERY == EVERY - 1:
                front = cut(front)
        return front

    def locate(self, value, most: int = 1000) -> DataFrame:
        """row, col of the entries equal to value. They are counted first: more than ``most`` are an error. Only blocks
        that hold the value are gone through."""
        t = self.stype
        if self.count(value).first()[0] > most:
            raise ValueError(f"more than {most} entries")
        return self._down(self._holding(self.leaves().where(t.same(F.col("val"), t.lit(value))))).select("row", "col")

    def max_element(self) -> DataFrame:
        """row, col, val of the largest |a|, the first of equals in the order of quadrants: one block a level is looked at."""
        t = self.stype
        leaves = cut(self.leaves().withColumn("s", t.size(F.col("val"))))
        best = leaves.agg(F.max("s").alias("s"))
        good = self._holding(leaves.join(best, "s", "left_semi"))  # one row
        name, row, col, down = self.root, 0, 0, self.steps[::-1]
        held = {x["id"] for x in good.collect()} if self.few is not None else None
        for (r, c), (r2, c2) in zip(down, down[1:]):
            if held is not None:
                q, name = next((k, self.few[name][f"q{k}"]) for k in range(4) if self.few[name][f"q{k}"] in held)
            else:
                q, name = self.kids(r, c).where(F.col("up") == name).join(good, "id", "left_semi").select("q", "id").orderBy("q").first()
            row, col = (row << (r - r2)) + (q >> 1 if r > r2 else 0), (col << (c - c2)) + (q & 1 if c > c2 else 0)
        return leaves.where(F.col("id") == name).select(F.lit(row).cast("long").alias("row"), F.lit(col).cast("long").alias("col"), "val")

    def entry(self, i: int, j: int) -> DataFrame:
        """val: one entry; one block a level is looked at."""
        if not (0 <= i < 1 << self.row_level and 0 <= j < 1 << self.col_level):
            raise IndexError(f"no entry {i, j}")
        name = self.root
        for r, c in self.steps[:0:-1]:
            q = (2 * (i >> (r - 1) & 1) if r else 0) + (j >> (c - 1) & 1 if c else 0)
            name = (self.few[name] if self.few is not None else self.at(r, c).where(F.col("id") == name).first())[f"q{q}"]
        return self.leaves().where(F.col("id") == name).select("val")

    def quadrant(self, q: int) -> NodeTable:
        """A quarter of a matrix, or half of a vector, by its number in [0 1; 2 3]."""
        if not self.row_level and not self.col_level:
            raise ValueError("a scalar has no quadrants")
        name = self.at(self.row_level, self.col_level).where(F.col("id") == self.root).first()[f"q{q}"]
        if name is None:
            raise ValueError(f"a vector has no quadrant {q}")
        return NodeTable(self.nodes, name, *self.steps[-2], self.stype, self.canonical)


# -- making tables -------------------------------------------------------------------------------------------------------


def _chain(spark: SparkSession, t: ScalarType, top: int, steps: list[tuple[int, int]]) -> DataFrame:
    """The blocks of zeros up to a step."""
    rows = []
    for k, (r, c) in enumerate(steps[: top + 1]):
        r0, c0 = steps[k - 1] if k else (0, 0)
        rows.append((zero_id(r, c), r, c, *(zero_id(r0, c0) if k and (r > r0 or i < 2) and (c > c0 or i % 2 == 0) else None for i in range(4)), None))
    made = spark.createDataFrame(rows, NODES)
    return made.withColumn("scalar", F.when((F.col("row_level") == 0) & (F.col("col_level") == 0), t.text(t.zero())))


def _table(spark: SparkSession, nodes: DataFrame, root: str, r: int, c: int, t: ScalarType, written: bool = False) -> NodeTable:
    """A table with just those blocks of zeros that others refer to. written: the parts repeat no block and are tables already."""
    steps = path(r, c)
    nodes = nodes.where(~is_zero(F.col("id"))).select("id", "row_level", "col_level", *QUADS, "scalar")
    got = nodes.limit(4 * FEW + 1).collect()  # the parts of the table may repeat a block
    few = {x["id"]: x for x in got}
    if len(got) <= 4 * FEW and len(few) <= FEW:
        held = {x[q] for x in few.values() for q in QUADS if x[q] and x[q].startswith("z")}
    else:
        nodes = nodes if written else cut(nodes.dropDuplicates(["id"]))
        below = {up: zero_id(*at) for at, up in zip(steps, steps[1:])}
        with_zeros = nodes.where(fold(lambda x, y: x | y, (F.coalesce(is_zero(F.col(q)), F.lit(False)) for q in QUADS)))
        few, held = None, {below[x["row_level"], x["col_level"]] for x in with_zeros.select("row_level", "col_level").distinct().collect()}  # at most one a level
    zeros, chain = held | ({root} if root.startswith("z") else set()), None
    if zeros:
        chain = _chain(spark, t, max(steps.index(tuple(map(int, z[1:].split(".")))) for z in zeros), steps)
    if few is None:
        return NodeTable(nodes.unionByName(chain) if zeros else nodes, root, r, c, t)
    few |= {x["id"]: x for x in chain.collect()} if zeros else {}
    out = NodeTable(spark.createDataFrame(list(few.values()), NODES), root, r, c, t)
    out.__dict__["few"] = few
    return out


def _first(df: DataFrame, zero: str) -> str:
    got = df.first()
    return got[0] if got else zero


def _merged(held: DataFrame, part: list[tuple[int, int]]) -> DataFrame:
    """held with m0, m1, ...: the blocks of each level of a pass that are not all zeros, by the entries (k, id) of held, where
    k is the place in the block and id the name in 16 bytes. Nothing is made of places that hold nothing, and an entry that is
    alone, as most of a sparse matrix are, is named in generated code."""
    entries = "held"
    for s, ((r0, c0), (r, c)) in enumerate(zip(part, part[1:])):
        dr, dc = r > r0, c > c0
        bits = dr + dc
        there = [q for q in range(4) if (dr or q < 2) and (dc or q % 2 == 0)]
        alone, hexed = F.size(entries) == 1, lambda x: F.lower(F.hex(x))

        def block(k: Column, quads: list[Column]) -> Column:  # these are called at once, within the loop
            return F.struct(k.alias("k"), F.unhex(node_id(F.lit(f"{r},{c}"), *quads)).alias("id"), *(x.alias(q) for x, q in zip(quads, QUADS)))

        def quads(name: Callable[[int], Column]) -> list[Column]:
            return [name(there.index(i)) if i in there else F.lit(None).cast("string") for i in range(4)]

        def gathered(k: Column) -> Column:
            q = quads(lambda j: F.coalesce(F.try_element_at("_at", F.shiftleft(k, bits) + j), F.lit(zero_id(r0, c0))))
            return F.struct(k.alias("k"), *(x.alias(n) for x, n in zip(q, QUADS)))

        one = F.col(entries)[0]
        single = block(F.shiftright(one["k"], bits), quads(lambda j: F.when(one["k"].bitwiseAND(F.lit((1 << bits) - 1)) == j, hexed(one["id"])).otherwise(F.lit(zero_id(r0, c0)))))
        held = held.withColumn("_at", F.when(~alone, F.map_from_entries(F.transform(entries, lambda x: F.struct(x["k"], hexed(x["id"]))))))
        held = held.withColumn("_q", F.when(~alone, F.transform(F.array_distinct(F.transform(entries, lambda x: F.shiftright(x["k"], bits))), gathered)))
        held = held.withColumn(f"m{s}", F.when(alone, F.array(single)).otherwise(F.transform("_q", lambda x: block(x["k"], [x[q] for q in QUADS]))))
        entries = f"m{s}"
    return held.drop("_at", "_q")


def _levelled(blocks: str, r: int, c: int) -> Column:
    return F.transform(blocks, lambda x: F.struct(F.lit(r).alias("row_level"), F.lit(c).alias("col_level"), x["id"].alias("id"), *(x[q].alias(q) for q in QUADS)))


def compress(m: Matrix) -> NodeTable:
    """What is written and shuffled follows the nonzero entries and the distinct blocks: PASS levels are gathered as lists of
    what is there, equal lists are merged once, and the blocks of a pass are written when they are known."""
    t = m.stype
    leaf = cut(m.df.select("row", "col", t.text(F.col("val")).alias("scalar")), "zstd")
    name, none = node_id(F.lit("s"), F.col("scalar")), F.lit(None).cast("string")
    tables = [cut(leaf.select("scalar").distinct().select(name.alias("id"), F.lit(0).alias("row_level"), F.lit(0).alias("col_level"), *(none.alias(q) for q in QUADS), "scalar"))]
    cur, before = leaf.select("row", "col", F.unhex(name).alias("id")), leaf
    steps = path(m.row_level, m.col_level)
    for low in range(0, len(steps) - 1, PASS):
        part = steps[low : low + PASS + 1]
        # the place of a cell among those that the pass merges: a digit a level, the highest first
        place, fan, rows, cols = F.lit(0), 1, 0, 0
        for (r0, c0), (r, c) in zip(part, part[1:]):
            for side, used, grows in (("col", cols, c > c0), ("row", rows, r > r0)):
                if grows:
                    place = place + F.shiftright(side, used).bitwiseAND(F.lit(1)) * fan
                    fan *= 2
            rows, cols = rows + r - r0, cols + c - c0
        held = cur.groupBy(F.shiftright("row", rows).alias("row"), F.shiftright("col", cols).alias("col")).agg(F.sort_array(F.collect_list(F.struct(place.cast("int").alias("k"), "id"))).alias("held"))
        held, last = cut(held, "zstd"), len(part) - 2
        drop(before)
        every = _merged(held.select("held").distinct(), part).select(F.explode(F.concat(*(_levelled(f"m{s}", *at) for s, at in enumerate(part[1:])))).alias("x"))
        tables.append(cut(every.select("x.*").distinct().select(F.lower(F.hex("id")).alias("id"), "row_level", "col_level", *QUADS, none.alias("scalar")), "zstd"))
        cur, before = _merged(held, part).select("row", "col", F.col(f"m{last}")[0]["id"].alias("id")), held
    root = _first(cur.select(F.lower(F.hex("id"))), zero_id(m.row_level, m.col_level))
    drop(before)
    return _table(m.spark, fold(DataFrame.unionByName, tables), root, m.row_level, m.col_level, t, written=True)


def constant(spark: SparkSession, value, r: int, c: int, stype: ScalarType = INTEGER) -> NodeTable:
    """All entries alike: a block a level."""
    text, zero = spark.range(1).select(stype.text(stype.lit(value)), ~stype.nonzero(stype.lit(value))).first()
    steps = path(r, c)
    if zero:
        return _table(spark, spark.createDataFrame([], NODES), zero_id(r, c), r, c, stype)
    rows = [(named("s", text), 0, 0, None, None, None, None, text)]
    for (r0, c0), (r1, c1) in zip(steps, steps[1:]):
        q = [rows[-1][0] if (r1 > r0 or i < 2) and (c1 > c0 or i % 2 == 0) else None for i in range(4)]
        rows.append((named(f"{r1},{c1}", *q), r1, c1, *q, None))
    return NodeTable(spark.createDataFrame(rows, NODES), rows[-1][0], r, c, stype)


def _doubling(spark: SparkSession, level: int, t: ScalarType, first: dict[str, Column], grow: dict[str, tuple[str, str, str, str]], root: str) -> NodeTable:
    """Square blocks that are made, level by level, of those of the level below; "z" stands for zeros."""
    texts = spark.range(1).select(*(t.text(v).alias(k) for k, v in first.items())).first()
    ids = {k: named("s", texts[k]) for k in first} | {"z": zero_id(0, 0)}
    rows = [(ids[k], 0, 0, None, None, None, None, texts[k]) for k in first]
    for lv in range(1, level + 1):
        up = {"z": zero_id(lv, lv)}
        for k, quads in grow.items():
            q = [ids[x] for x in quads]
            up[k] = named(f"{lv},{lv}", *q)
            rows.append((up[k], lv, lv, *q, None))
        ids = up
    return _table(spark, spark.createDataFrame(rows, NODES), ids[root], level, level, t)


def identity(spark: SparkSession, level: int, stype: ScalarType = INTEGER) -> NodeTable:
    return _doubling(spark, level, stype, {"i": stype.one()}, {"i": ("i", "z", "z", "i")}, "i")


def hadamard(spark: SparkSession, level: int, stype: ScalarType = INTEGER) -> NodeTable:
    """Two blocks a level, the one the negative of the other."""
    return _doubling(spark, level, stype, {"h": stype.one(), "n": stype.minus(stype.one())}, {"h": ("h", "h", "h", "n"), "n": ("n", "n", "n", "h")}, "h")


# -- naming from the bottom up -------------------------------------------------------------------------------------------


def _up(x: NodeTable, ids: DataFrame, *, by: tuple[str, ...] = (), shift: tuple[int, int] = (0, 0), flip: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """Names all blocks of x anew, given names of its scalars: ids has ``by``, old and id. Levels are moved up by ``shift``,
    or swapped. Gives the names of the roots, and the tables of new blocks."""
    turned = (0, 2, 1, 3) if flip else (0, 1, 2, 3)
    if x.few is not None:
        got = ids.select(*by, "old", "id").limit(FEW + 1).collect()
        if len(got) <= FEW and len({g[:-2] for g in got}) * len(x.few) <= 10 * FEW:
            return _up_few(x, got, by, shift, flip, turned)
    made, none = [], F.lit(None).cast("string")
    for (r0, c0), (r, c) in zip(x.steps, x.steps[1:]):
        kids = x.kids(r, c).withColumnRenamed("id", "old")
        up = kids.join(ids, "old").groupBy(*by, "up").agg(*(F.max(F.when(F.col("q") == turned[k], F.col("id"))).alias(f"q{k}") for k in range(4)))
        lower, here = ((c0, r0), (c, r)) if flip else ((r0 + shift[0], c0 + shift[1]), (r + shift[0], c + shift[1]))
        up = cut(up.select(*by, F.col("up").alias("old"), _block(*here, *lower, [F.col(q) for q in QUADS]).alias("id"), *QUADS))
        made.append(up.select("id", F.lit(here[0]).alias("row_level"), F.lit(here[1]).alias("col_level"), *QUADS, none.alias("scalar")).distinct())
        ids = up.select(*by, "old", "id")
    return ids, made


def _name(here: tuple[int, int], lower: tuple[int, int], quads: list[str | None]) -> str:
    """``_block`` of values that the driver has."""
    return zero_id(*here) if all(q in (None, zero_id(*lower)) for q in quads) else named(f"{here[0]},{here[1]}", *quads)


def _up_few(x: NodeTable, ids: list[Row], by: tuple[str, ...], shift: tuple[int, int], flip: bool, turned: tuple[int, ...]) -> tuple[DataFrame, list[DataFrame]]:
    now = {(tuple(g[:-2]), g[-2]): g[-1] for g in ids}
    keys, levels, rows = {k for k, _ in now}, x.levelled(), {}
    for (r0, c0), (r, c) in zip(x.steps, x.steps[1:]):
        lower, here = ((c0, r0), (c, r)) if flip else ((r0 + shift[0], c0 + shift[1]), (r + shift[0], c + shift[1]))
        up = {}
        for k in keys:
            for b in levels.get((r, c), ()):
                quads = [now[k, b[f"q{t}"]] if b[f"q{t}"] else None for t in turned]
                up[k, b["id"]] = _name(here, lower, quads)
                rows[up[k, b["id"]]] = (up[k, b["id"]], *here, *quads, None)
        now = up
    kinds = "".join(f"{b} string, " for b in by)
    return x.spark.createDataFrame([(*k, old, new) for (k, old), new in now.items()], f"{kinds}old string, id string"), [x.spark.createDataFrame(list(rows.values()), NODES)] if rows else []


def _scalars(df: DataFrame, t: ScalarType) -> DataFrame:
    """Nodes of values val whose names are id."""
    none = F.lit(None).cast("string")
    return df.select("id", F.lit(0).alias("row_level"), F.lit(0).alias("col_level"), *(none.alias(q) for q in QUADS), t.text(F.col("val")).alias("scalar")).distinct()


def _joined(tables: list[DataFrame]) -> DataFrame:
    return fold(DataFrame.unionByName, tables)


def _renamed(x: NodeTable, leaves: DataFrame, t: ScalarType, flip: bool = False) -> NodeTable:
    """x with other scalars: leaves has old and val."""
    leaves = cut(leaves.select("old", "val", _leaf(t, F.col("val")).alias("id")))
    ids, made = _up(x, leaves.select("old", "id"), flip=flip)
    levels = (x.col_level, x.row_level) if flip else (x.row_level, x.col_level)
    root = _first(ids.where(F.col("old") == x.root).select("id"), zero_id(*levels))
    return _table(x.spark, _joined([_scalars(leaves, t), *made]), root, *levels, t)


def canonical(x: NodeTable) -> NodeTable:
    """x by the names that compress would give, whatever its own are."""
    return x if x.canonical else _renamed(x, x.leaves().withColumnRenamed("id", "old"), x.stype)


def apply(x: NodeTable, f: Callable[[Column], Column], stype: ScalarType | None = None) -> NodeTable:
    """f of every entry, zeros included, whatever f makes of them: each distinct scalar is mapped once."""
    t = stype or x.stype
    return _renamed(x, x.leaves().select(F.col("id").alias("old"), f(F.col("val")).alias("val")), t)


def scale(x: NodeTable, a) -> NodeTable:
    return apply(x, lambda v: x.stype.times(x.stype.lit(a), v))


def divide(x: NodeTable, b) -> NodeTable:
    if not isinstance(b, str) and not b:
        raise ZeroDivisionError("division by zero")
    return apply(x, lambda v: x.stype.over(v, x.stype.lit(b)))


def entry_squared(x: NodeTable, by=1) -> NodeTable:
    """by |a|^2 of every entry."""
    return apply(x, lambda v: x.stype.times(x.stype.lit(by), x.stype.squared(v)))


def adjoint(x: NodeTable) -> NodeTable:
    return _renamed(x, x.leaves().select(F.col("id").alias("old"), x.stype.conj(F.col("val")).alias("val")), x.stype, flip=True)


def from_quadrants(a: NodeTable, b: NodeTable, c: NodeTable, d: NodeTable) -> NodeTable:
    """[a b; c d], for four square matrices of one level."""
    if len({(x.row_level, x.col_level, x.stype.name) for x in (a, b, c, d)}) > 1 or a.row_level != a.col_level:
        raise ValueError("four square matrices of one level and type are needed")
    four = [canonical(x) for x in (a, b, c, d)]
    lv, q = a.row_level + 1, [x.root for x in four]
    if all(x.startswith("z") for x in q):
        return _table(a.spark, a.spark.createDataFrame([], NODES), zero_id(lv, lv), lv, lv, a.stype)
    top = a.spark.createDataFrame([(named(f"{lv},{lv}", *q), lv, lv, *q, None)], NODES)
    return _table(a.spark, _joined([top, *(x.nodes for x in four)]), named(f"{lv},{lv}", *q), lv, lv, a.stype)


def add(a: NodeTable, b: NodeTable) -> NodeTable:
    """a + b block by block: each distinct pair of blocks is added once, however often it occurs."""
    if (a.row_level, a.col_level, a.stype) != (b.row_level, b.col_level, b.stype):
        raise ValueError("levels or types differ")
    a, b, t = canonical(a), canonical(b), a.stype
    if a.few is not None and b.few is not None:
        out = _add_few(a, b)
        if out is not None:
            return out
    down = a.steps[::-1]
    pairs = [a.spark.createDataFrame([(a.root, b.root)], "a string, b string")]
    zipped = lambda r, c: (a.at(r, c).select(F.col("id").alias("a"), F.array(*QUADS).alias("x")), b.at(r, c).select(F.col("id").alias("b"), F.array(*QUADS).alias("y")))
    for r, c in down[:-1]:
        x, y = zipped(r, c)
        both = pairs[-1].join(x, "a").join(y, "b").select(F.explode(F.arrays_zip("x", "y")).alias("p"))
        pairs.append(cut(both.select(F.col("p.x").alias("a"), F.col("p.y").alias("b")).where("a IS NOT NULL").distinct()))
    x, y = a.leaves().toDF("a", "x"), b.leaves().toDF("b", "y")
    leaf = cut(pairs[-1].join(x, "a").join(y, "b").select("a", "b", t.plus(F.col("x"), F.col("y")).alias("val")).select("a", "b", "val", _leaf(t, F.col("val")).alias("id")))
    tables, done, none = [_scalars(leaf, t)], leaf.select("a", "b", "id"), F.lit(None).cast("string")
    for (r, c), front, kid in zip(down[:-1][::-1], pairs[:-1][::-1], down[1:][::-1]):
        x, y = zipped(r, c)
        kids = front.join(x, "a").join(y, "b").select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.posexplode(F.arrays_zip("x", "y")).alias("k", "p"))
        met = kids.select("ua", "ub", "k", F.col("p.x").alias("a"), F.col("p.y").alias("b")).where("a IS NOT NULL").join(done, ["a", "b"])
        up = met.groupBy("ua", "ub").agg(*(F.max(F.when(F.col("k") == i, F.col("id"))).alias(f"q{i}") for i in range(4)))
        up = cut(up.select(F.col("ua").alias("a"), F.col("ub").alias("b"), _block(r, c, *kid, [F.col(q) for q in QUADS]).alias("id"), *QUADS))
        tables.append(up.select("id", F.lit(r).alias("row_level"), F.lit(c).alias("col_level"), *QUADS, none.alias("scalar")).distinct())
        done = up.select("a", "b", "id")
    return _table(a.spark, _joined(tables), _first(done.select("id"), zero_id(a.row_level, a.col_level)), a.row_level, a.col_level, t)


def _add_few(a: NodeTable, b: NodeTable) -> NodeTable | None:
    """``add`` with pairs met and named on the driver, and scalars added by Spark; None where a level has over 10 FEW pairs."""
    t, spark, down = a.stype, a.spark, a.steps[::-1]
    level, parted = [(a.root, b.root)], []
    for _ in down[1:]:
        quads = [[(a.few[x][q], b.few[y][q]) if a.few[x][q] else None for q in QUADS] for x, y in level]
        parted.append((level, quads))
        level = list(dict.fromkeys(p for four in quads for p in four if p))
        if len(level) > 10 * FEW:
            return None
    pairs = spark.createDataFrame(level, "a string, b string").join(a.leaves().toDF("a", "x"), "a").join(b.leaves().toDF("b", "y"), "b")
    leaf = pairs.select("a", "b", t.plus(F.col("x"), F.col("y")).alias("val"))
    leaf = cut(leaf.select("a", "b", "val", _leaf(t, F.col("val")).alias("id")))
    now, made = {(x["a"], x["b"]): x["id"] for x in leaf.select("a", "b", "id").collect()}, {}
    for here, lower, (sums, quads) in zip(down[-2::-1], down[:0:-1], parted[::-1]):
        up = {}
        for pair, four in zip(sums, quads):
            names = [now[p] if p else None for p in four]
            up[pair] = _name(here, lower, names)
            made[up[pair]] = (up[pair], *here, *names, None)
        now = up
    tables = [_scalars(leaf, t)] + ([spark.createDataFrame(list(made.values()), NODES)] if made else [])
    return _table(spark, _joined(tables), now[a.root, b.root], a.row_level, a.col_level, t)


def saxpy(a: NodeTable, b: NodeTable, x, y) -> NodeTable:
    """x a + y b."""
    return add(scale(a, x), scale(b, y))


def product(a: NodeTable, b: NodeTable, keep_rows: int | None = None) -> NodeTable:
    """a b. With keep_rows, tables of sums with more rows than that are deleted once the result is named, not at exit.

    A block of the result is a sum of products of blocks, written as the products' names with how often each occurs. Equal
    sums are one: on the way down each distinct sum is parted into its quadrants once, pairs with a block of zeros left out,
    and on the way up each gets its name once. Sums are added up where scalars meet, and nowhere before.
    """
    if a.stype is not b.stype:
        raise ValueError(f"{a.stype.name} and {b.stype.name} don't mix")
    if a.col_level != b.row_level:
        raise ValueError(f"a product needs equal inner levels, not {a.col_level} and {b.row_level}")
    a, b, t = canonical(a), canonical(b), a.stype
    r, inner, c = a.row_level, a.col_level, b.col_level
    height, spark, none = max(r, inner, c), a.spark, F.lit(None).cast("string")
    at = lambda n, k: max(0, n - k)  # noqa: E731  the level of a side after k steps down
    # the last steps may split one factor alone; a scalar of the other then stands for itself
    quads = lambda x, k, rows, cols, name: (x.at(at(rows, k), at(cols, k)).select(F.col("id").alias(name), (F.array(*QUADS) if rows > k or cols > k else F.array("id", "id", "id", "id")).alias(f"{name}q")))
    terms = "array<struct<a:string,b:string,n:decimal(38,0)>>"
    zero = a.root.startswith("z") or b.root.startswith("z")
    if zero:
        return _table(spark, spark.createDataFrame([], NODES), zero_id(r, c), r, c, t)
    if a.few is not None and b.few is not None:
        out = _product_few(a, b, height)
        if out is not None:
            return out
    level = spark.createDataFrame([("root", [(a.root, b.root, 1)])], "key string, terms array<struct<a:string,b:string,n:bigint>>").withColumn("terms", F.col("terms").cast(terms))
    edges = []
    for k in range(height):
        rows, mids, cols = r > k, inner > k, c > k
        part = level.select("key", F.explode("terms").alias("x")).select("key", "x.*")
        part = part.join(quads(a, k, r, inner, "a"), "a").join(quads(b, k, inner, c, "b"), "b")
        cells = [(i, j, m) for i in range(1 + rows) for j in range(1 + cols) for m in range(1 + mids)]
        split = part.select("key", "n", F.explode(F.array(*(F.struct(F.lit(2 * i + j).alias("q"), F.col("aq")[2 * i + m].alias("a"), F.col("bq")[2 * m + j].alias("b")) for i, j, m in cells))).alias("x"))
        split = split.select("key", "n", "x.*").where(~is_zero(F.col("a")) & ~is_zero(F.col("b")))
        split = split.groupBy("key", "q", "a", "b").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
        sums = split.groupBy("key", "q").agg(F.sort_array(F.collect_list(F.struct("a", "b", "n"))).alias("terms"))
        name = F.md5(F.array_join(F.transform("terms", lambda x: F.concat_ws(":", x["a"], x["b"], x["n"].cast("string"))), ","))
        sums = cut(sums.select("key", "q", name.alias("kid"), "terms"))
        edges.append(sums)
        level = sums.groupBy(F.col("kid").alias("key")).agg(F.first("terms").alias("terms"))
    part = level.select("key", F.explode("terms").alias("x")).select("key", "x.*")
    part = part.join(a.leaves().toDF("a", "x"), "a").join(b.leaves().toDF("b", "y"), "b")
    got = part.select("key", t.times(t.parse(F.col("n").cast("string")), t.times(F.col("x"), F.col("y"))).alias("val"))
    got = t.sum_by(got, ["key"])
    got = cut(got.select("key", "val", _leaf(t, F.col("val")).alias("id")))
    tables, ids = [_scalars(got, t)], got.select(F.col("key").alias("kid"), "id")
    for k, sums in reversed(list(enumerate(edges))):
        here, lower = (at(r, k), at(c, k)), (at(r, k + 1), at(c, k + 1))
        there = [2 * i + j for i in range(1 + (r > k)) for j in range(1 + (c > k))]
        up = sums.join(ids, "kid").groupBy("key").agg(*(F.max(F.when(F.col("q") == q, F.col("id"))).alias(f"q{q}") for q in range(4)))
        filled = [F.coalesce(F.col(f"q{q}"), F.lit(zero_id(*lower))) if q in there else none for q in range(4)]
        if here == lower:  # only the inner side was split
            up = cut(up.select(F.col("key").alias("kid"), filled[0].alias("id")))
        else:
            up = cut(up.select(F.col("key").alias("kid"), _block(*here, *lower, filled).alias("id"), *(x.alias(q) for x, q in zip(filled, QUADS))))
            tables.append(up.select("id", F.lit(here[0]).alias("row_level"), F.lit(here[1]).alias("col_level"), *QUADS, none.alias("scalar")).distinct())
        ids = up.select("kid", "id")
    out = _table(spark, _joined(tables), _first(ids.where("kid = 'root'").select("id"), zero_id(r, c)), r, c, t)
    if keep_rows is not None:
        for sums in edges:
            if sums.count() > keep_rows:
                drop(sums)
    return out


def _product_few(a: NodeTable, b: NodeTable, height: int) -> NodeTable | None:
    """``product`` with sums parted and named on the driver, scalars multiplied and added up by Spark as ever; None where the
    sums of a level have more than 10 FEW terms."""
    t, r, inner, c, spark = a.stype, a.row_level, a.col_level, b.col_level, a.spark
    level, edges = [frozenset({(a.root, b.root): 1}.items())], []
    kid = lambda x, name, q, split: x.few[name][f"q{q}"] if split else name
    for k in range(height):
        rows, mids, cols = r > k, inner > k, c > k
        below, parted = {}, []
        for terms in level:
            quads = {}
            for i in range(1 + rows):
                for j in range(1 + cols):
                    many: dict[tuple[str, str], int] = {}
                    for (x, y), n in terms:
                        for m in range(1 + mids):
                            pair = kid(a, x, 2 * i + m, rows or mids), kid(b, y, 2 * m + j, mids or cols)
                            if not pair[0].startswith("z") and not pair[1].startswith("z"):
                                many[pair] = many.get(pair, 0) + n
                    if many:
                        quads[2 * i + j] = frozenset(many.items())
                        below[quads[2 * i + j]] = None
            parted.append(quads)
        edges.append((level, parted))
        level = list(below)
        if sum(map(len, level)) > 10 * FEW:
            return None
    flat = [(k, x, y, str(n)) for k, terms in enumerate(level) for (x, y), n in terms]
    part = spark.createDataFrame(flat, "key int, a string, b string, n string").join(a.leaves().toDF("a", "x"), "a").join(b.leaves().toDF("b", "y"), "b")
    got = t.sum_by(part.select("key", t.times(t.parse(F.col("n")), t.times(F.col("x"), F.col("y"))).alias("val")), ["key"])
    got = cut(got.select("key", "val", _leaf(t, F.col("val")).alias("id")))
    now, made = {level[g["key"]]: g["id"] for g in got.select("key", "id").collect()}, {}
    for k, (sums, parted) in reversed(list(enumerate(edges))):
        here, lower = (max(0, r - k), max(0, c - k)), (max(0, r - k - 1), max(0, c - k - 1))
        there = [2 * i + j for i in range(1 + (r > k)) for j in range(1 + (c > k))]
        up = {}
        for terms, quads in zip(sums, parted):
            names = [(now.get(quads.get(q)) or zero_id(*lower)) if q in there else None for q in range(4)]
            up[terms] = names[0] if here == lower else _name(here, lower, names)
            if here != lower:
                made[up[terms]] = (up[terms], *here, *names, None)
        now = up
    tables = [_scalars(got, t)] + ([spark.createDataFrame(list(made.values()), NODES)] if made else [])
    return _table(spark, _joined(tables), next(iter(now.values()), zero_id(r, c)), r, c, t)


def kron(a: NodeTable, b: NodeTable) -> NodeTable:
    """a ⊗ b: b is scaled by each distinct scalar of a, and a's blocks are named anew on top of that. Where a's and b's
    shapes do not split like the result's (a vector by a matrix), the product is formed of entries and compressed."""
    if a.stype is not b.stype:
        raise ValueError(f"{a.stype.name} and {b.stype.name} don't mix")
    a, b, t = canonical(a), canonical(b), a.stype
    r, c = a.row_level + b.row_level, a.col_level + b.col_level
    if path(r, c) != b.steps[:-1] + [(x + b.row_level, y + b.col_level) for x, y in a.steps]:
        return compress(expand(a).kron(expand(b)))
    factors = a.leaves().toDF("s", "x")
    # one row for each pair of distinct scalars: a named result, however it is made
    pairs = factors.crossJoin(b.leaves().toDF("old", "y")).select("s", "old", t.times(F.col("x"), F.col("y")).alias("val"))
    leaves = cut(pairs.select("s", "old", "val", _leaf(t, F.col("val")).alias("id")))
    ids, made = _up(b, leaves.select("s", "old", "id"), by=("s",))
    tops = ids.where(F.col("old") == b.root).select(F.col("s").alias("old"), "id")
    ids, above = _up(a, tops, shift=(b.row_level, b.col_level))
    root = _first(ids.where(F.col("old") == a.root).select("id"), zero_id(r, c))
    return _table(a.spark, _joined([_scalars(leaves, t), *made, *above]), root, r, c, t)


def expand(nt: NodeTable) -> Matrix:
    """The entries of a node table. Blocks of zeros are left out, so rows never outnumber nonzero entries."""
    t = nt.stype
    if nt.canonical:
        good = nt.nodes.where(~is_zero(F.col("id"))).select("id")
    else:
        good = nt._holding(nt.leaves().where(t.nonzero(F.col("val"))))
    df = (nt._down(good).join(nt.leaves(), "id") if nt.few is not None else _met(nt, good)).select("row", "col", "val")
    return Matrix(df.where(t.nonzero(F.col("val"))), nt.row_level, nt.col_level, t)


def _met(nt: NodeTable, good: DataFrame) -> DataFrame:
    """row, col, val of all entries under good blocks. From above come the places of blocks, from below the entries within
    distinct blocks; of the two the one with fewer rows takes the next level, until they meet. Neither outnumbers the entries."""
    t, steps = nt.stype, nt.steps
    short = F.unhex if nt.canonical else F.col  # names that compress gives are 16 bytes
    if nt.canonical:
        kids = lambda r, c: nt.kids(r, c).where(~is_zero(F.col("id"))).select(short("up").alias("up"), "q", short("id").alias("id"))
    else:
        every = cut(nt.nodes.where("scalar IS NULL").select(F.col("id").alias("up"), "row_level", "col_level", F.posexplode(F.array(*QUADS)).alias("q", "id")).where("id IS NOT NULL").join(good, "id", "left_semi"))
        kids = lambda r, c: every.where((F.col("row_level") == r) & (F.col("col_level") == c)).select("up", "q", "id")
    root = nt.spark.createDataFrame([(nt.root, 0, 0)], "id string, row bigint, col bigint").join(good.where(F.col("id") == nt.root), "id", "left_semi")
    above = cut(root.select(short("id").alias("id"), "row", "col"))
    zero = F.lit(0).cast("long")
    within = cut(nt.leaves().where(t.nonzero(F.col("val"))).select(short("id").alias("id"), zero.alias("r"), zero.alias("c"), "val"))
    lo, hi, n_above, n_within = 0, len(steps) - 1, above.count(), within.count()
    while lo < hi:
        down = n_above <= n_within
        (r0, c0), (r, c) = (steps[hi - 1], steps[hi]) if down else (steps[lo], steps[lo + 1])
        here = kids(r, c)
        dr, dc = F.shiftright("q", 1).cast("long") if r > r0 else zero, F.col("q").bitwiseAND(F.lit(1)).cast("long") if c > c0 else zero
        if down:
            moved = above.withColumnRenamed("id", "up").join(here, "up").select("id", (F.shiftleft("row", r - r0) + dr).alias("row"), (F.shiftleft("col", c - c0) + dc).alias("col"))
        else:
            moved = within.join(here, "id").select(F.col("up").alias("id"), (F.col("r") + F.shiftleft(dr, r0)).alias("r"), (F.col("c") + F.shiftleft(dc, c0)).alias("c"), "val")
        lo, hi, last = (lo, hi - 1, hi - 1 == lo) if down else (lo + 1, hi, lo + 1 == hi)
        if not last:  # the last step is part of the result's own plan
            moved = cut(moved, "zstd")
            drop(above if down else within)
            n_above, n_within = (moved.count(), n_within) if down else (n_above, moved.count())
        above, within = (moved, within) if down else (above, moved)
    row_level, col_level = steps[lo]
    return above.join(within, "id").select((F.shiftleft("row", row_level) + F.col("r")).alias("row"), (F.shiftleft("col", col_level) + F.col("c")).alias("col"), "val")

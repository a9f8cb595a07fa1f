"""The matrix operators over ordinary tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import regions
from .functions import scalars as S
from .matrix import Matrix, quad_at
from .operators import transforms as T
from .plans import quadtree as Q
from .plans.staging import new_path
from .sources import build as B
from .sources import files


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# -- matrices of the tables, and the SQL of the same ------------------------------------------------------------------


def qty(spark: SparkSession, d: str) -> Matrix:
    return B.from_table(read(spark, d, "lineitem"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_quantity"), 6, 6)


def lines(spark: SparkSession, d: str) -> Matrix:
    return B.from_table(read(spark, d, "lineitem"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber"), 6, 6)


def evt(spark: SparkSession, d: str) -> Matrix:
    code = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 3).otherwise(4)
    return B.from_table(read(spark, d, "events"), F.col("user_id"), code, F.lit(1), 7, 3)


def emb(spark: SparkSession, d: str) -> Matrix:
    cells = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return B.from_table(cells, F.col("vec_id"), F.col("pos"), F.floor(F.col("x").cast("double") * 1024 + 0.5), 9, 6)


def nation_region(spark: SparkSession, d: str) -> Matrix:
    return B.from_table(read(spark, d, "nation"), F.col("n_nationkey"), F.col("n_regionkey"), F.lit(1), 5, 3)


def customers(spark: SparkSession, d: str) -> Matrix:
    return B.from_table(read(spark, d, "customer"), F.col("c_custkey"), F.col("c_nationkey"), F.lit(True), 10, 5, S.BOOLEAN)


def orders(spark: SparkSession, d: str) -> Matrix:
    return B.from_table(read(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderkey"), F.lit(1), 8, 8)


def bought(spark: SparkSession, d: str) -> Matrix:
    """Orders by parts, at levels that hold every key of a table 100 times as large: a sparse matrix that grows with the tables."""
    return B.from_table(read(spark, d, "lineitem"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity"), 24, 22)


def numbers(spark: SparkSession, d: str) -> Matrix:
    """As ``bought``, with line numbers."""
    return B.from_table(read(spark, d, "lineitem"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), 24, 22)


def parity(spark: SparkSession, d: str) -> Matrix:
    return B.from_table(read(spark, d, "customer"), F.col("c_custkey"), F.col("c_custkey"), F.lit(True), 10, 5, S.BOOLEAN)


WITH = """WITH
a AS (SELECT "row", "col", val FROM (SELECT CAST(l_suppkey % 64 AS BIGINT) AS "row", CAST(l_partkey % 64 AS BIGINT) AS "col", CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2) WHERE val <> 0),
b AS (SELECT "row", "col", val FROM (SELECT CAST(l_partkey % 64 AS BIGINT) AS "row", CAST(l_orderkey % 64 AS BIGINT) AS "col", CAST(sum(l_linenumber) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2) WHERE val <> 0),
e AS (SELECT CAST(user_id % 128 AS BIGINT) AS "row", CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS BIGINT) AS "col", count(*) AS val FROM events GROUP BY 1, 2),
v AS (SELECT "row", "col", val FROM (SELECT CAST(vec_id % 512 AS BIGINT) AS "row", CAST(pos - 1 AS BIGINT) AS "col", CAST(sum(CAST(floor(CAST(embedding[pos] AS DOUBLE) * 1024 + 0.5) AS BIGINT)) AS BIGINT) AS val FROM embeddings, range(1, 65) t(pos) GROUP BY 1, 2) WHERE val <> 0),
n AS (SELECT CAST(n_nationkey AS BIGINT) AS "row", CAST(n_regionkey AS BIGINT) AS "col", count(*) AS val FROM nation GROUP BY 1, 2),
c AS (SELECT DISTINCT CAST(c_custkey % 1024 AS BIGINT) AS "row", CAST(c_nationkey % 32 AS BIGINT) AS "col", true AS val FROM customer),
o AS (SELECT CAST(o_custkey % 256 AS BIGINT) AS "row", CAST(o_orderkey % 256 AS BIGINT) AS "col", count(*) AS val FROM orders GROUP BY 1, 2)
"""
BIG = """WITH
p AS (SELECT "row", "col", val FROM (SELECT CAST(l_orderkey % 16777216 AS BIGINT) AS "row", CAST(l_partkey % 4194304 AS BIGINT) AS "col", CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2) WHERE val <> 0),
k AS (SELECT "row", "col", val FROM (SELECT CAST(l_orderkey % 16777216 AS BIGINT) AS "row", CAST(l_partkey % 4194304 AS BIGINT) AS "col", CAST(sum(l_linenumber) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2) WHERE val <> 0)
"""


def _product(x: str, y: str) -> str:
    return f'SELECT x."row", y."col", CAST(sum(x.val * y.val) AS BIGINT) AS val FROM {x} x JOIN {y} y ON x."col" = y."row" GROUP BY 1, 2 HAVING sum(x.val * y.val) <> 0'


def _sum(*terms: str) -> str:
    return 'SELECT "row", "col", CAST(sum(val) AS BIGINT) AS val FROM (' + " UNION ALL ".join(terms) + ') GROUP BY 1, 2 HAVING sum(val) <> 0'


def _times(x: str, f: str) -> str:
    return f'SELECT "row", "col", {f} AS val FROM {x}'


def _norm_columns(m: Matrix) -> DataFrame:
    both = m.norm(0).select(F.col("val").cast("bigint").alias("max_norm")).crossJoin(m.norm(1).select(F.col("val").cast("bigint").alias("l1_norm")))
    return both.crossJoin(m.norm(2).select(F.round("val", 3).alias("l2_norm")))  # one row each


def _long(df: DataFrame) -> DataFrame:
    return df.select(F.col("val").cast("bigint").alias("val"))


def _complex(m: Matrix) -> Matrix:
    """val + i (row - col) val, to have imaginary parts too."""
    re_, im = F.col("val").cast("double"), ((F.col("row") - F.col("col")) * F.col("val")).cast("double")
    return Matrix(m.df.select("row", "col", S.COMPLEX.pair(re_, im).alias("val")), m.row_level, m.col_level, S.COMPLEX)


def _parts(m: Matrix) -> DataFrame:
    return m.df.select("row", "col", F.col("val.re").cast("bigint").alias("re"), F.col("val.im").cast("bigint").alias("im"))


def _micro(m: Matrix) -> DataFrame:
    """Complex entries in millionths, as integers: none of them lies near a tie."""
    v = lambda p: F.round(F.col(f"val.{p}") * 1e6).cast("bigint").alias(p)
    return m.df.select("row", "col", v("re"), v("im")).where("re <> 0 OR im <> 0")


def _price(spark: SparkSession, d: str) -> Matrix:
    """Prices modulo 16 in eighths: sums are exact in doubles."""
    eighth = F.pmod(F.floor(F.col("l_extendedprice") * 8).cast("bigint"), F.lit(128)) / F.lit(8.0)
    return B.from_table(read(spark, d, "lineitem"), F.col("l_suppkey"), F.col("l_partkey"), eighth, 6, 6, S.REAL)


PRICE = """r AS (SELECT * FROM (SELECT CAST(l_suppkey % 64 AS BIGINT) AS "row", CAST(l_partkey % 64 AS BIGINT) AS "col", sum((CAST(floor(l_extendedprice * 8) AS BIGINT) % 128) / 8.0) AS val FROM lineitem GROUP BY 1, 2) WHERE val <> 0)"""
COMPLEX_SQL = 'z AS (SELECT "row", "col", val AS re, ("row" - "col") * val AS im FROM n)'
H = "CASE WHEN bit_count(CAST({} & {} AS BIGINT)) % 2 = 1 THEN -1 ELSE 1 END"


def _morton(level: int, row_level: int, col_level: int) -> str:
    side = lambda name, low, to: "+".join(f'((("{name}" >> {k}) & 1) << {2 * (k + level - low) + to})' for k in range(low))
    return side("row", row_level, 1) + "+" + side("col", col_level, 0)


MORTON = _morton(6, 6, 6)

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]

QUERIES: dict[str, Query] = {
    "matmul": (lambda s, d: (qty(s, d) @ lines(s, d)).df, WITH + _product("a", "b")),
    "matmul_square": (lambda s, d: (qty(s, d) @ qty(s, d)).df, WITH + _product("a", "a")),
    "matmul_adjoint": (lambda s, d: (evt(s, d).adjoint() @ evt(s, d)).df, WITH + ", t AS (SELECT \"col\" AS \"row\", \"row\" AS \"col\", val FROM e) " + _product("t", "e")),
    "gram": (lambda s, d: (emb(s, d).adjoint() @ emb(s, d)).df, WITH + ", t AS (SELECT \"col\" AS \"row\", \"row\" AS \"col\", val FROM v) " + _product("t", "v")),
    "basis_change": (lambda s, d: lines(s, d).basis_change(qty(s, d)).df, WITH + f', t AS (SELECT "col" AS "row", "row" AS "col", val FROM a), ab AS ({_product("a", "b")}) ' + _product("ab", "t")),
    "add": (lambda s, d: (qty(s, d) + lines(s, d)).df, WITH + _sum("SELECT * FROM a", "SELECT * FROM b")),
    "diff": (lambda s, d: (qty(s, d) - lines(s, d)).df, WITH + _sum("SELECT * FROM a", _times("b", "-val"))),
    "saxpy": (lambda s, d: qty(s, d).saxpy(lines(s, d), 3, -2).df, WITH + _sum(_times("a", "3 * val"), _times("b", "-2 * val"))),
    "scalar_mult": (lambda s, d: orders(s, d).scale(7).df, WITH + _times("o", "7 * val")),
    "scalar_matrix_mult": (lambda s, d: (B.scalar(s, -4) @ orders(s, d)).df, WITH + _times("o", "-4 * val")),
    "scalar_divide": (lambda s, d: qty(s, d).divide(7).df, WITH + 'SELECT "row", "col", CAST(val // 7 AS BIGINT) AS val FROM a WHERE val // 7 <> 0'),
    "entry_squared": (lambda s, d: qty(s, d).entry_squared(2).df, WITH + _times("a", "2 * val * val")),
    "adjoint": (lambda s, d: evt(s, d).adjoint().df, WITH + 'SELECT "col" AS "row", "row" AS "col", val FROM e'),
    "apply_plus_one": (lambda s, d: nation_region(s, d).apply(lambda x: x + 1).df, WITH + 'SELECT CAST(i AS BIGINT) AS "row", CAST(j AS BIGINT) AS "col", coalesce(val, 0) + 1 AS val FROM range(32) x(i) CROSS JOIN range(8) y(j) LEFT JOIN n ON n."row" = i AND n."col" = j'),
    "apply_cube": (lambda s, d: orders(s, d).apply(lambda x: x * x * x, keeps_zero=True).df, WITH + _times("o", "val * val * val")),
    "kron": (lambda s, d: nation_region(s, d).kron(evt(s, d)).df, WITH + 'SELECT n."row" * 128 + e."row" AS "row", n."col" * 8 + e."col" AS "col", n.val * e.val AS val FROM n CROSS JOIN e'),
    "identity_kron": (lambda s, d: evt(s, d).identity_kron(2).df, WITH + 'SELECT k * 128 + "row" AS "row", k * 8 + "col" AS "col", val FROM e CROSS JOIN range(4) t(k)'),
    "outer_product": (lambda s, d: (_vector(s, d) @ _vector(s, d).adjoint()).df, WITH + ', x AS (SELECT "row", sum(val)::BIGINT AS val FROM a GROUP BY 1) SELECT x."row", y."row" AS "col", x.val * y.val AS val FROM x CROSS JOIN x y'),
    "dot": (lambda s, d: _long(_vector(s, d).dot(_vector(s, d, lines))), WITH + ', x AS (SELECT "row", sum(val)::BIGINT AS val FROM a GROUP BY 1), y AS (SELECT "row", sum(val)::BIGINT AS val FROM b GROUP BY 1) SELECT CAST(sum(x.val * y.val) AS BIGINT) AS val FROM x JOIN y ON x."row" = y."row"'),
    "join_side_by_side": (lambda s, d: qty(s, d).join(lines(s, d)).df, WITH + 'SELECT * FROM a UNION ALL SELECT "row", "col" + 64, val FROM b'),
    "stack": (lambda s, d: qty(s, d).stack(lines(s, d)).df, WITH + 'SELECT * FROM a UNION ALL SELECT "row" + 64, "col", val FROM b'),
    "from_quadrants": (lambda s, d: B.from_quadrants(qty(s, d), lines(s, d), lines(s, d), qty(s, d)).df, WITH + 'SELECT * FROM a UNION ALL SELECT "row", "col" + 64, val FROM b UNION ALL SELECT "row" + 64, "col", val FROM b UNION ALL SELECT "row" + 64, "col" + 64, val FROM a'),
    "quadrant": (lambda s, d: orders(s, d).quadrant(2).df, WITH + 'SELECT "row" - 128 AS "row", "col", val FROM o WHERE "row" >= 128 AND "col" < 128'),
    "entry_at": (lambda s, d: qty(s, d).at(5, 9), WITH + 'SELECT CAST(coalesce(max(val), 0) AS BIGINT) AS val FROM a WHERE "row" = 5 AND "col" = 9'),
    "replace_entry": (lambda s, d: qty(s, d).replaced(5, 9, -1).df, WITH + 'SELECT * FROM a WHERE NOT ("row" = 5 AND "col" = 9) UNION ALL SELECT 5, 9, -1'),
    "trace": (lambda s, d: _long(qty(s, d).trace()), WITH + 'SELECT CAST(sum(val) AS BIGINT) AS val FROM a WHERE "row" = "col"'),
    "trace_norm": (lambda s, d: _long(qty(s, d).trace_norm(2)), WITH + "SELECT CAST(2 * sum(val * val) AS BIGINT) AS val FROM a"),
    "norms": (lambda s, d: _norm_columns(emb(s, d)), WITH + "SELECT CAST(max(abs(val)) AS BIGINT) AS max_norm, CAST(sum(abs(val)) AS BIGINT) AS l1_norm, round(sqrt(CAST(sum(val * val) AS DOUBLE)), 3) AS l2_norm FROM v"),
    "max_element": (lambda s, d: qty(s, d).max_element(), WITH + f'SELECT "row", "col", val FROM a ORDER BY abs(val) DESC, {MORTON} LIMIT 1'),
    "count_value": (lambda s, d: _long(orders(s, d).count(1)), WITH + "SELECT count(*) AS val FROM o WHERE val = 1"),
    "count_zero": (lambda s, d: _long(evt(s, d).count(0)), WITH + "SELECT 1024 - count(*) AS val FROM e"),
    "locate_value": (lambda s, d: orders(s, d).locate(2), WITH + 'SELECT "row", "col" FROM o WHERE val = 2'),
    "locate_zero": (lambda s, d: nation_region(s, d).locate(0), WITH + 'SELECT CAST(i AS BIGINT) AS "row", CAST(j AS BIGINT) AS "col" FROM range(32) x(i) CROSS JOIN range(8) y(j) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n."row" = i AND n."col" = j)'),
    "unique_scalars": (lambda s, d: orders(s, d).scalars(), WITH + "SELECT DISTINCT val FROM o UNION SELECT 0 FROM (SELECT count(*) AS k FROM o) WHERE k < 65536"),
    "block_sums": (lambda s, d: orders(s, d).block_sums(3).df, WITH + 'SELECT "row" >> 3 AS "row", "col" >> 3 AS "col", CAST(sum(val) AS BIGINT) AS val FROM o GROUP BY 1, 2'),
    "equality": (lambda s, d: _said(s, commuted=(qty(s, d) + lines(s, d)).equals(lines(s, d) + qty(s, d)), distinct=qty(s, d).equals(lines(s, d)), turned=qty(s, d).equals(qty(s, d).adjoint())), WITH + ', t AS (SELECT "col" AS "row", "row" AS "col", val FROM a) SELECT true AS commuted, NOT EXISTS ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) AS "distinct", NOT EXISTS ((SELECT * FROM a EXCEPT SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT SELECT * FROM a)) AS turned'),
    "zero_small": (lambda s, d: qty(s, d).zeroed_below(100).df, WITH + "SELECT * FROM a WHERE abs(val) >= 100"),
    "flatten_small": (lambda s, d: qty(s, d).flattened(100, 1).df, WITH + _times("a", "CASE WHEN abs(val) < 100 THEN 1 ELSE val END")),
    "identity": (lambda s, d: B.identity(s, 8).df, 'SELECT CAST(i AS BIGINT) AS "row", CAST(i AS BIGINT) AS "col", CAST(1 AS BIGINT) AS val FROM range(256) t(i)'),
    "constant": (lambda s, d: B.constant(s, 3, 3, 2).df, 'SELECT CAST(i AS BIGINT) AS "row", CAST(j AS BIGINT) AS "col", CAST(3 AS BIGINT) AS val FROM range(8) x(i) CROSS JOIN range(4) y(j)'),
    "hadamard": (lambda s, d: B.hadamard(s, 5).df, f'SELECT CAST(i AS BIGINT) AS "row", CAST(j AS BIGINT) AS "col", CAST({H.format("i", "j")} AS BIGINT) AS val FROM range(32) x(i) CROSS JOIN range(32) y(j)'),
    "one_hot": (lambda s, d: B.one_hot(s, 4, 3, 11, 5).df, 'SELECT CAST(3 AS BIGINT) AS "row", CAST(11 AS BIGINT) AS "col", CAST(5 AS BIGINT) AS val'),
    "inverse_shuffle": (lambda s, d: B.inverse_shuffle(s, 6).df, 'SELECT CAST(i AS BIGINT) AS "row", CAST((2 * i) % 64 + CASE WHEN i >= 32 THEN 1 ELSE 0 END AS BIGINT) AS "col", CAST(1 AS BIGINT) AS val FROM range(64) t(i)'),
    "hadamard_times": (lambda s, d: T.hadamard_times(qty(s, d)).df, WITH + f', h AS (SELECT i AS "row", j AS "col", {H.format("i", "j")} AS val FROM range(64) x(i) CROSS JOIN range(64) y(j)) ' + _product("h", "a")),
    "times_hadamard": (lambda s, d: T.times_hadamard(evt(s, d)).df, WITH + f', h AS (SELECT i AS "row", j AS "col", {H.format("i", "j")} AS val FROM range(8) x(i) CROSS JOIN range(8) y(j)) ' + _product("e", "h")),
    "fourier": (lambda s, d: _micro(T.fourier(Matrix(_complex(evt(s, d)).df, 7, 3, S.COMPLEX))), WITH + """, z AS (SELECT "row", "col", val AS re, ("row" - "col") * val AS im FROM e), w AS (SELECT j AS "row", "col", sum(re * cos(2 * pi() * ((j * z."row") % 128) / 128) - im * sin(2 * pi() * ((j * z."row") % 128) / 128)) AS re, sum(re * sin(2 * pi() * ((j * z."row") % 128) / 128) + im * cos(2 * pi() * ((j * z."row") % 128) / 128)) AS im FROM z CROSS JOIN range(128) t(j) GROUP BY 1, 2)
SELECT * FROM (SELECT "row", "col", CAST(round(re * 1e6) AS BIGINT) AS re, CAST(round(im * 1e6) AS BIGINT) AS im FROM w) WHERE re <> 0 OR im <> 0"""),
    "fft_matrix": (lambda s, d: _micro(B.fft_matrix(s, 4)), 'SELECT CAST(i AS BIGINT) AS "row", CAST(j AS BIGINT) AS "col", CAST(round(cos(2 * pi() * ((i * j) % 16) / 16) * 1e6) AS BIGINT) AS re, CAST(round(sin(2 * pi() * ((i * j) % 16) / 16) * 1e6) AS BIGINT) AS im FROM range(16) x(i) CROSS JOIN range(16) y(j)'),
    "roots_of_unity": (lambda s, d: B.roots_of_unity(s, 5).select("k", F.round(F.col("val.re") * 1e6).cast("bigint").alias("re"), F.round(F.col("val.im") * 1e6).cast("bigint").alias("im")), "SELECT CAST(k AS BIGINT) AS k, CAST(round(cos(2 * pi() * k / 32) * 1e6) AS BIGINT) AS re, CAST(round(sin(2 * pi() * k / 32) * 1e6) AS BIGINT) AS im FROM range(32) t(k)"),
    "complex_product": (lambda s, d: _parts(_complex(nation_region(s, d)) @ _complex(nation_region(s, d)).adjoint()), WITH + f', {COMPLEX_SQL} SELECT x."row", y."row" AS "col", CAST(sum(x.re * y.re + x.im * y.im) AS BIGINT) AS re, CAST(sum(x.im * y.re - x.re * y.im) AS BIGINT) AS im FROM z x JOIN z y ON x."col" = y."col" GROUP BY 1, 2'),
    "complex_adjoint": (lambda s, d: _parts(_complex(nation_region(s, d)).adjoint()), WITH + f', {COMPLEX_SQL} SELECT "col" AS "row", "row" AS "col", CAST(re AS BIGINT) AS re, CAST(-im AS BIGINT) AS im FROM z'),
    "boolean_product": (lambda s, d: (customers(s, d).adjoint() @ customers(s, d)).df, WITH + 'SELECT DISTINCT x."col" AS "row", y."col" AS "col", true AS val FROM c x JOIN c y ON x."row" = y."row"'),
    "boolean_or": (lambda s, d: (customers(s, d) + parity(s, d)).df, WITH + 'SELECT * FROM c UNION SELECT CAST(c_custkey % 1024 AS BIGINT), CAST(c_custkey % 32 AS BIGINT), true FROM customer'),
    "real_sum": (lambda s, d: (_price(s, d) + _price(s, d)).df, WITH + f", {PRICE} " + _times("r", "val + val")),
    "decimal_product": (lambda s, d: _bigint(qty(s, d), S.MPINTEGER), WITH + _product("a", "a")),
    "rational_trace": (lambda s, d: _thirds(s, d).trace().select("val"), WITH + """, t AS (SELECT CAST(sum(val) AS BIGINT) AS n FROM a WHERE "row" = "col") SELECT CASE WHEN n % 3 = 0 THEN CAST(n // 3 AS VARCHAR) ELSE CAST(n AS VARCHAR) || '/3' END AS val FROM t"""),
    "regions_single": (lambda s, d: regions.snap_single(_price(s, d), 0).df.select("row", "col", F.floor(F.abs("val") + 0.5).cast("bigint").alias("region")), WITH + f', {PRICE} SELECT "row", "col", CAST(floor(abs(val) + 0.5) AS BIGINT) AS region FROM r WHERE floor(abs(val) + 0.5) <> 0'),
    "compress_expand": (lambda s, d: Q.expand(Q.compress(orders(s, d))).df, WITH + "SELECT * FROM o"),
    "compressed_add": (lambda s, d: Q.expand(Q.add(Q.compress(evt(s, d)), Q.compress(evt(s, d)))).df, WITH + _times("e", "2 * val")),
    "compressed_count": (lambda s, d: _long(Q.compress(orders(s, d)).count(0)), WITH + "SELECT 65536 - count(*) AS val FROM o"),
    "compressed_histogram": (lambda s, d: Q.compress(B.hadamard(s, 6)).histogram(), "SELECT CAST(k AS INTEGER) AS row_level, CAST(k AS INTEGER) AS col_level, CAST(2 AS BIGINT) AS count FROM range(6) t(k) UNION ALL SELECT 6, 6, 1"),
    "dense_cells": (lambda s, d: nation_region(s, d).dense(), WITH + 'SELECT CAST(i AS BIGINT) AS "row", CAST(j AS BIGINT) AS "col", CAST(coalesce(val, 0) AS BIGINT) AS val FROM range(32) x(i) CROSS JOIN range(8) y(j) LEFT JOIN n ON n."row" = i AND n."col" = j'),
    "random_entries": (lambda s, d: B.random_entries(s, 5, 5, -100, 100, 0.3, seed=1).df, None),
    "random_entries_counts": (lambda s, d: B.random_entries(s, 5, 5, -100, 100, 0.3, seed=1).df.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("row", "col").alias("cells"), (F.min("val") >= -100).alias("low"), (F.max("val") < 100).alias("high")), "SELECT CAST(717 AS BIGINT) AS entries, CAST(717 AS BIGINT) AS cells, true AS low, true AS high"),
    "random_ones_counts": (lambda s, d: B.random_ones(s, 20, 20, 5000, seed=3).df.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("row", "col").alias("cells"), F.sum("val").alias("total"), (F.max("row") < 1 << 20).alias("inside")), "SELECT CAST(5000 AS BIGINT) AS entries, CAST(5000 AS BIGINT) AS cells, CAST(5000 AS BIGINT) AS total, true AS inside"),
    "regions_adjacent": (lambda s, d: regions.snap_adjacent(_price(s, d), 0).df, None),
    # -- at levels of 22 and more, on matrices that grow with the tables
    "sparse_product": (lambda s, d: (bought(s, d).adjoint() @ numbers(s, d)).df, BIG + ', t AS (SELECT "col" AS "row", "row" AS "col", val FROM p) ' + _product("t", "k")),
    "sparse_saxpy": (lambda s, d: bought(s, d).saxpy(numbers(s, d), 2, -1).df, BIG + _sum(_times("p", "2 * val"), _times("k", "-val"))),
    "sparse_max_element": (lambda s, d: bought(s, d).max_element(), BIG + f'SELECT "row", "col", val FROM p ORDER BY abs(val) DESC, {_morton(24, 24, 22)} LIMIT 1'),
    "sparse_locate": (lambda s, d: bought(s, d).locate(50), BIG + 'SELECT "row", "col" FROM p WHERE val = 50'),
    "sparse_counts": (lambda s, d: _long(bought(s, d).count(0)), BIG + "SELECT CAST(70368744177664 - count(*) AS BIGINT) AS val FROM p"),
    "sparse_block_sums": (lambda s, d: bought(s, d).block_sums(12).df, BIG + 'SELECT "row" >> 12 AS "row", "col" >> 12 AS "col", CAST(sum(val) AS BIGINT) AS val FROM p GROUP BY 1, 2'),
    "sparse_compress_expand": (lambda s, d: Q.expand(Q.compress(bought(s, d))).df, BIG + "SELECT * FROM p"),
    # -- algebra on shared blocks
    "compressed_scale": (lambda s, d: Q.expand(Q.scale(Q.compress(evt(s, d)), 3)).df, WITH + _times("e", "3 * val")),
    "compressed_saxpy": (lambda s, d: Q.expand(Q.saxpy(Q.compress(qty(s, d)), Q.compress(lines(s, d)), 3, -2)).df, WITH + _sum(_times("a", "3 * val"), _times("b", "-2 * val"))),
    "compressed_adjoint": (lambda s, d: Q.expand(Q.adjoint(Q.compress(evt(s, d)))).df, WITH + 'SELECT "col" AS "row", "row" AS "col", val FROM e'),
    "compressed_apply": (lambda s, d: Q.expand(Q.apply(Q.compress(nation_region(s, d)), lambda x: x + 1)).df, WITH + 'SELECT CAST(i AS BIGINT) AS "row", CAST(j AS BIGINT) AS "col", coalesce(val, 0) + 1 AS val FROM range(32) x(i) CROSS JOIN range(8) y(j) LEFT JOIN n ON n."row" = i AND n."col" = j'),
    "compressed_square": (lambda s, d: Q.expand(Q.entry_squared(Q.compress(qty(s, d)), 2)).df, WITH + _times("a", "2 * val * val")),
    "compressed_divide": (lambda s, d: Q.expand(Q.divide(Q.compress(qty(s, d)), 7)).df, WITH + 'SELECT "row", "col", CAST(val // 7 AS BIGINT) AS val FROM a WHERE val // 7 <> 0'),
    "compressed_product": (lambda s, d: _product_of(Q.compress(evt(s, d))), WITH + ', t AS (SELECT "col" AS "row", "row" AS "col", val FROM e) ' + _product("t", "e")),
    "compressed_kron": (lambda s, d: Q.expand(Q.kron(Q.hadamard(s, 2), Q.compress(orders(s, d).block_sums(3)))).df, WITH + f', g AS (SELECT "row" >> 3 AS "row", "col" >> 3 AS "col", CAST(sum(val) AS BIGINT) AS val FROM o GROUP BY 1, 2) SELECT i * 32 + "row" AS "row", j * 32 + "col" AS "col", CAST({H.format("i", "j")} * val AS BIGINT) AS val FROM g CROSS JOIN range(4) x(i) CROSS JOIN range(4) y(j)'),
    "compressed_reductions": (lambda s, d: _reductions(Q.compress(qty(s, d))), WITH + 'SELECT CAST(sum(CASE WHEN "row" = "col" THEN val ELSE 0 END) AS BIGINT) AS trace, CAST(sum(val) AS BIGINT) AS total, CAST(2 * sum(val * val) AS BIGINT) AS trace_norm, CAST(max(abs(val)) AS BIGINT) AS max_norm, CAST(sum(abs(val)) AS BIGINT) AS l1_norm, round(sqrt(CAST(sum(val * val) AS DOUBLE)), 3) AS l2_norm FROM a'),
    "compressed_locate": (lambda s, d: Q.compress(orders(s, d)).locate(3, most=100_000), WITH + 'SELECT "row", "col" FROM o WHERE val = 3'),
    "compressed_max_element": (lambda s, d: Q.compress(qty(s, d)).max_element(), WITH + f'SELECT "row", "col", val FROM a ORDER BY abs(val) DESC, {MORTON} LIMIT 1'),
    "compressed_equality": (lambda s, d: _said(s, commuted=Q.compress(qty(s, d) + lines(s, d)).same(Q.add(Q.compress(lines(s, d)), Q.compress(qty(s, d)))), distinct=Q.compress(qty(s, d)).same(Q.compress(lines(s, d)))), WITH + 'SELECT true AS commuted, NOT EXISTS ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) AS "distinct"'),
    "compressed_size": (lambda s, d: s.createDataFrame([(x["blocks"], x["scalars"]) for x in (Q.identity(s, 20).describe(), Q.hadamard(s, 20).describe(), Q.constant(s, 7, 20, 20).describe())], "blocks bigint, scalars bigint"), "SELECT CAST(b AS BIGINT) AS blocks, CAST(s AS BIGINT) AS scalars FROM (VALUES (41, 2), (42, 2), (21, 1)) t(b, s)"),
    "compressed_apply_level_32": (lambda s, d: _plus_one(Q.apply(Q.identity(s, 32), lambda x: x + 1)), "SELECT CAST(8589934592 AS BIGINT) AS trace, '18446744069414584320' AS ones, '4294967296' AS twos, '0' AS zeros"),
    "compressed_product_level_16": (lambda s, d: Q.product(Q.hadamard(s, 16), Q.hadamard(s, 16)).multiplicities().select("val", F.col("n").cast("bigint").alias("n")), "SELECT CAST(65536 AS BIGINT) AS val, CAST(65536 AS BIGINT) AS n"),
    # -- files, written and read back within the query
    "file_json": (lambda s, d: _back(s, orders(s, d), files.write_json, files.read_json), WITH + "SELECT * FROM o"),
    "file_json_parts": (lambda s, d: _back(s, orders(s, d), lambda m, p: files.write_json(m, p, parts=True), files.read_json), WITH + "SELECT * FROM o"),
    "file_json_top_left": (lambda s, d: _back(s, evt(s, d), lambda m, p: files.write_json(m, p, top_left=True), files.read_json), WITH + "SELECT * FROM e"),
    "file_row_major": (lambda s, d: _back(s, evt(s, d), files.write_row_major, files.read_row_major), WITH + "SELECT * FROM e"),
    "file_coordinates": (lambda s, d: _back(s, evt(s, d), files.write_coordinates, files.read_coordinates), WITH + "SELECT * FROM e"),
    "file_levels": (lambda s, d: _levels(s, evt(s, d)), "SELECT 7 AS row_level, 3 AS col_level, 'INTEGER' AS type"),
    "file_equality": (lambda s, d: _files_equal(s, qty(s, d), lines(s, d)), WITH + 'SELECT true AS itself, NOT EXISTS ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) AS other'),
    "text_dense": (lambda s, d: files.dense_text(nation_region(s, d)), WITH + """SELECT CAST(i AS BIGINT) AS "row", string_agg(CAST(coalesce(val, 0) AS VARCHAR), ' ' ORDER BY j) AS line FROM range(32) x(i) CROSS JOIN range(8) y(j) LEFT JOIN n ON n."row" = i AND n."col" = j GROUP BY i"""),
    "text_nonzeros": (lambda s, d: _lines(s, evt(s, d), files.write_nonzeros), WITH + """SELECT CAST(val AS VARCHAR) || chr(9) || '(' || "row" || ',' || "col" || ')' AS line FROM e"""),
    "text_scalars": (lambda s, d: _lines(s, orders(s, d), files.write_scalars), WITH + "SELECT DISTINCT CAST(val AS VARCHAR) AS line FROM o UNION SELECT '0' FROM (SELECT count(*) AS k FROM o) WHERE k < 65536"),
    # -- constructors, tests and functions of scalars
    "zero": (lambda s, d: B.zero(s, 4, 3).df, 'SELECT CAST(0 AS BIGINT) AS "row", CAST(0 AS BIGINT) AS "col", CAST(0 AS BIGINT) AS val WHERE false'),
    "fft_diagonal": (lambda s, d: _micro(B.fft_diagonal(s, 5)), 'SELECT CAST(k AS BIGINT) AS "row", CAST(k AS BIGINT) AS "col", CAST(round(cos(2 * pi() * k / 64) * 1e6) AS BIGINT) AS re, CAST(round(sin(2 * pi() * k / 64) * 1e6) AS BIGINT) AS im FROM range(32) t(k)'),
    "fft_combine": (lambda s, d: _micro(B.fft_combine(s, 5)), """WITH w AS (SELECT k, CAST(round(cos(2 * pi() * k / 32) * 1e6) AS BIGINT) AS re, CAST(round(sin(2 * pi() * k / 32) * 1e6) AS BIGINT) AS im FROM range(16) t(k))
SELECT CAST(k + 16 * h AS BIGINT) AS "row", CAST(k AS BIGINT) AS "col", CAST(1000000 AS BIGINT) AS re, CAST(0 AS BIGINT) AS im FROM w CROSS JOIN range(2) u(h) UNION ALL SELECT CAST(k + 16 * h AS BIGINT), CAST(k + 16 AS BIGINT), CASE WHEN h = 0 THEN re ELSE -re END, CASE WHEN h = 0 THEN im ELSE -im END FROM w CROSS JOIN range(2) u(h)"""),
    "fft_product": (lambda s, d: _micro(B.fft_combine(s, 4) @ B.identity(s, 1, S.COMPLEX).kron(B.fft_matrix(s, 3)) @ B.inverse_shuffle(s, 4, S.COMPLEX)), 'SELECT CAST(i AS BIGINT) AS "row", CAST(j AS BIGINT) AS "col", CAST(round(cos(2 * pi() * ((i * j) % 16) / 16) * 1e6) AS BIGINT) AS re, CAST(round(sin(2 * pi() * ((i * j) % 16) / 16) * 1e6) AS BIGINT) AS im FROM range(16) x(i) CROSS JOIN range(16) y(j)'),
    "from_values": (lambda s, d: B.from_list(s, ["1", "0", "4", "2", "4", "-3", "1", "0"], 1, 2).df, 'SELECT CAST(i AS BIGINT) AS "row", CAST(j AS BIGINT) AS "col", CAST(v AS BIGINT) AS val FROM (VALUES (0, 0, 1), (0, 2, 4), (0, 3, 2), (1, 0, 4), (1, 1, -3), (1, 2, 1)) t(i, j, v)'),
    "from_array": (lambda s, d: B.from_numpy(s, [[1.5, 0, 2], [0, -3.25, 0], [4, 0, 0]], S.REAL).df, 'SELECT CAST(i AS BIGINT) AS "row", CAST(j AS BIGINT) AS "col", CAST(v AS DOUBLE) AS val FROM (VALUES (0, 0, 1.5), (0, 2, 2), (1, 1, -3.25), (2, 0, 4)) t(i, j, v)'),
    "global_constants": (lambda s, d: _globals(s), "SELECT * FROM (VALUES ('-1', '-1.0+I*0.0'), ('-1/2', '-0.5+I*0.0'), ('-i', '0.0-I*1.0'), ('-i/2', '0.0-I*0.5'), ('0', '0.0+I*0.0'), ('1', '1.0+I*0.0'), ('1/2', '0.5+I*0.0'), ('i', '0.0+I*1.0'), ('i/2', '0.0+I*0.5'), ('I1', '2.0+I*0.0'), ('NOT', '0.0+I*0.0'), ('HH1', '0.0+I*0.0')) t(name, trace)"),
    "named_constants": (lambda s, d: s.range(1).select(F.explode(F.create_map(*(x for k, v in S.constants(S.REAL).items() for x in (F.lit(k), v)))).alias("name", "v")).select("name", F.round(F.col("v") * 1e9).cast("bigint").alias("nano")), "SELECT name, CAST(round(v * 1e9) AS BIGINT) AS nano FROM (VALUES ('SQRT2', sqrt(2)), ('INV_SQRT2', sqrt(0.5)), ('SQRT3', sqrt(3)), ('INV_SQRT3', 1 / sqrt(3)), ('SQRT6', sqrt(6)), ('INV_SQRT6', 1 / sqrt(6)), ('CBRT2', cbrt(2)), ('INV_CBRT2', 1 / cbrt(2)), ('CBRT4', cbrt(4)), ('INV_CBRT4', 1 / cbrt(4))) t(name, v)"),
    "predicates": (lambda s, d: _said(s, none=(qty(s, d) - qty(s, d)).is_zero(), some=qty(s, d).is_zero(), eye=(B.inverse_shuffle(s, 5) @ B.inverse_shuffle(s, 5).adjoint()).is_identity(), shuffled=B.inverse_shuffle(s, 5).is_identity(), bad=qty(s, d).is_invalid()), "SELECT true AS none, (SELECT sum(l_quantity) = 0 FROM lineitem) AS some, true AS eye, false AS shuffled, false AS bad"),
    "entry_texts": (lambda s, d: s.createDataFrame([(str(i), qty(s, d).at_text(i, i)) for i in (0, 9)] + [("scalar", B.scalar(s, -7).value_text())], "at string, text string"), WITH + """SELECT CAST(i AS VARCHAR) AS "at", CAST(coalesce((SELECT val FROM a WHERE "row" = i AND "col" = i), 0) AS VARCHAR) AS "text" FROM (VALUES (0), (9)) t(i) UNION ALL SELECT 'scalar', '-7'"""),
    "quadrant_places": (lambda s, d: s.createDataFrame([(i, j, quad_at(i, j, 3)) for i in range(8) for j in range(8)], "i bigint, j bigint, quad bigint"), "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(2 * (i >> 2) + (j >> 2) AS BIGINT) AS quad FROM range(8) x(i) CROSS JOIN range(8) y(j)"),
    "scalar_functions": (lambda s, d: _scalar_functions(s, d), """SELECT l_orderkey, l_linenumber, CAST(sign(l_discount - l_tax) AS INTEGER) AS compared, l_tax <> 0 AS regular, round(sqrt(l_extendedprice), 6) AS root, l_extendedprice - l_tax AS size, isnan(l_tax) AS nan, isinf(l_tax) AS infinite,
CAST(floor(sqrt(l_partkey)) AS BIGINT) AS whole_root, l_partkey // (l_linenumber + 1) AS quotient FROM lineitem"""),
    "complex_functions": (lambda s, d: _complex_functions(s, d), WITH + f""", {COMPLEX_SQL} SELECT "row", "col", CAST(sign(re - 1) AS INTEGER) AS first, CAST(CASE sign(re - 1) WHEN -1 THEN 2 ELSE sign(re - 1) END + 4 * CASE sign(im) WHEN -1 THEN 2 ELSE sign(im) END AS INTEGER) AS parts, im = 0 AS "real", re = 0 AS imaginary, round(sqrt(re * re + im * im), 6) AS norm, re <> 0 AND im <> 0 AS regular,
CAST(re AS DOUBLE) AS conj_re, CAST(-im AS DOUBLE) AS conj_im FROM z"""),
    "exact_functions": (lambda s, d: _exact_functions(s, d), """SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN '0' WHEN r_regionkey % 3 = 0 THEN CAST(r_regionkey // 3 AS VARCHAR) ELSE CAST(r_regionkey AS VARCHAR) || '/3' END AS third, CAST(sign(r_regionkey - 3) AS INTEGER) AS compared, CASE WHEN r_regionkey = 0 THEN '0' ELSE '(' || CAST(2 * r_regionkey * r_regionkey AS VARCHAR) || ')*{1}' END AS squared, r_regionkey = 0 AS "real" FROM region"""),
    "clifford_product": (lambda s, d: (_times_root(s, d) @ _times_root(s, d)).df, WITH + """, m AS (SELECT * FROM n WHERE "row" < 8) SELECT x."row", y."col", '(' || CAST(CAST(2 * sum(x.val * y.val) AS BIGINT) AS VARCHAR) || ')*{1}' AS val FROM m x JOIN m y ON x."col" = y."row" GROUP BY 1, 2"""),
}


def _said(s: SparkSession, **truths: bool) -> DataFrame:
    return s.createDataFrame([tuple(truths.values())], ", ".join(f"`{k}` boolean" for k in truths))


def _product_of(x: Q.NodeTable) -> DataFrame:
    return Q.expand(Q.product(Q.adjoint(x), x)).df


def _reductions(x: Q.NodeTable) -> DataFrame:
    one = lambda df, name: df.select(F.col("val").cast("bigint").alias(name))
    out = one(x.trace(), "trace").crossJoin(one(x.total(), "total")).crossJoin(one(x.trace_norm(2), "trace_norm"))
    return out.crossJoin(one(x.norm(0), "max_norm")).crossJoin(one(x.norm(1), "l1_norm")).crossJoin(x.norm(2).select(F.round("val", 3).alias("l2_norm")))  # one row each


def _plus_one(x: Q.NodeTable) -> DataFrame:
    many = lambda v, name: x.count(v).select(F.col("val").cast("string").alias(name))
    return x.trace().select(F.col("val").cast("bigint").alias("trace")).crossJoin(many(1, "ones")).crossJoin(many(2, "twos")).crossJoin(many(0, "zeros"))  # one row each


def _back(s: SparkSession, m: Matrix, write: Callable, load: Callable) -> DataFrame:
    path = new_path(s, "file")
    write(m, path)
    return load(s, path).df


def _levels(s: SparkSession, m: Matrix) -> DataFrame:
    path = new_path(s, "file")
    files.write_json(m, path)
    return s.createDataFrame([(*files.levels(s, path), files.scalar_type(s, path))], "row_level int, col_level int, type string")


def _files_equal(s: SparkSession, a: Matrix, b: Matrix) -> DataFrame:
    paths = [new_path(s, "file") for _ in range(3)]
    files.write_json(a, paths[0])
    files.write_json(a, paths[1], parts=True)
    files.write_json(b, paths[2])
    return _said(s, itself=files.equal_files(s, *paths[:2]), other=files.equal_files(s, paths[0], paths[2]))


def _lines(s: SparkSession, m: Matrix, write: Callable) -> DataFrame:
    path = new_path(s, "file")
    write(m, path)
    return s.read.text(path).select(F.col("value").alias("line"))


def _globals(s: SparkSession) -> DataFrame:
    t, out = S.COMPLEX, None
    for name, m in B.globals_of(s, t).items():
        one = m.trace().select(F.lit(name).alias("name"), t.text(F.col("val")).alias("trace"))
        out = one if out is None else out.unionByName(one)
    return out


def _scalar_functions(s: SparkSession, d: str) -> DataFrame:
    t, x, y = S.REAL, F.col("l_tax"), F.col("l_discount")
    price, whole = F.col("l_extendedprice"), S.INTEGER
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", t.compare(y, x).alias("compared"), t.is_regular(x).alias("regular"), F.round(t.root(price), 6).alias("root"), t.size(t.plus(price, t.minus(x))).alias("size"), t.is_nan(x).alias("nan"), t.is_infinite(x).alias("infinite"), whole.root(F.col("l_partkey")).alias("whole_root"), whole.over(F.col("l_partkey"), F.col("l_linenumber").cast("bigint") + 1).alias("quotient"))


def _complex_functions(s: SparkSession, d: str) -> DataFrame:
    t, v, one = S.COMPLEX, F.col("val"), S.COMPLEX.one()
    return _complex(nation_region(s, d)).df.select("row", "col", F.when(t.compare(v, one) == t.compare(one, v), 0).otherwise(S.REAL.compare(v["re"], F.lit(1.0))).alias("first"), t.compare_parts(v, one).alias("parts"), t.is_real(v).alias("real"), t.is_imaginary(v).alias("imaginary"), F.round(t.norm(v), 6).alias("norm"), t.is_regular(v).alias("regular"), t.conj(v)["re"].alias("conj_re"), (t.conj(v)["im"] + 0.0).alias("conj_im"))


def _exact_functions(s: SparkSession, d: str) -> DataFrame:
    q, z, key = S.MPRATIONAL, S.CLIFFORD, F.col("r_regionkey")
    third = q.over(q.parse(key.cast("string")), q.lit("3"))
    root = z.times(z.parse(key.cast("string")), z.lit("{S2}"))
    return read(s, d, "region").select("r_regionkey", third.alias("third"), q.compare(third, q.one()).alias("compared"), z.times(root, root).alias("squared"), z.is_real(z.times(root, z.lit("{1}*I"))).alias("real"))


def _times_root(s: SparkSession, d: str) -> Matrix:
    """The nations' rows under 8, times the root of 2."""
    m = nation_region(s, d)
    return Matrix(m.df.where("row < 8"), 3, 3, S.INTEGER).map(lambda v: F.concat(F.lit("("), v.cast("string"), F.lit(")*{S2}")), S.CLIFFORD)


def _vector(s: SparkSession, d: str, of: Callable = qty) -> Matrix:
    """The row sums of a matrix, as a column."""
    return Matrix(S.INTEGER.sum_by(of(s, d).df.select("row", F.lit(0).cast("long").alias("col"), "val"), ["row", "col"]), 6, 0)


def _bigint(m: Matrix, stype) -> DataFrame:
    big = m.map(lambda v: v.cast(stype.dtype), stype)
    return (big @ big).df.select("row", "col", F.col("val").cast("bigint").alias("val"))


def _thirds(s: SparkSession, d: str) -> Matrix:
    return qty(s, d).map(lambda v: F.concat(v.cast("string"), F.lit("/3")), S.MPRATIONAL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}

"""What matrix queries make on the way follows their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlake.functions import scalars as S
from quadlake.matrix import Matrix
from quadlake.plans import quadtree as Q
from quadlake.sources import build as B


def sparse(spark, n, r, c):
    cells = spark.range(n).select((F.col("id") * 2654435761 % (1 << r)).alias("row"), (F.col("id") * 40503 % (1 << c)).alias("col"), (F.col("id") % 50 + 1).alias("val"))
    return Matrix(cells, r, c)


@pytest.fixture
def tables(monkeypatch):
    """All tables that are written on the way."""
    made, cut = [], Q.cut

    def spy(df, *args):
        out = cut(df, *args)
        made.append((out.count(), sum(out.select(*(F.coalesce(F.sum(F.size(k)), F.lit(0)) for k, t in out.dtypes if t.startswith("array")) or [F.lit(0)]).first())))
        return out

    monkeypatch.setattr(Q, "cut", spy)
    return made


def test_compress_and_expand_make_nothing_of_zeros(spark, tables, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 5)
    m = sparse(spark, 30, 12, 10)
    nt = Q.compress(m)
    assert max(held for _, held in tables) <= 30  # lists of 16 and 4 for an entry that is alone would be 600
    tables.clear()
    assert Q.expand(nt).equals(m)
    assert max(n for n, _ in tables) <= 30


@pytest.mark.parametrize("shape", [(5, 4), (3, 1), (0, 0)])
def test_many_blocks_and_few_agree(spark, monkeypatch, shape):
    a = np.random.default_rng(3).integers(-2, 3, (1 << shape[0], 1 << shape[1]))
    m = B.from_numpy(spark, a)
    few = Q.compress(m)
    monkeypatch.setattr(Q, "FEW", 0)
    many = Q.compress(m)
    assert many.few is None and many.root == few.root
    assert sorted(map(tuple, many.nodes.collect()), key=str) == sorted(map(tuple, few.nodes.collect()), key=str)
    assert Q.expand(many).equals(m)
    other = Q.NodeTable(many.nodes.select(*(F.concat(F.lit("n"), k).alias(k) if k in ("id", *Q.QUADS) else F.col(k) for k in many.nodes.columns)), "n" + many.root, *shape, S.INTEGER, False)
    assert Q.expand(other).equals(m)


def _plan(spark, name):
    from quadlake import queries

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return queries.QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_sparse_cells_are_not_held_by_the_tasks_that_read_them(spark):
    for part in _plan(spark, "sparse_saxpy").split("Exchange ")[1:]:
        assert "HashAggregate" not in part.split("FileScan")[0].split("Union")[0].split("REPARTITION_BY_COL")[-1]


def test_sparse_products_shuffle_operands_once(spark):
    plan = _plan(spark, "sparse_product")
    assert plan.count("Exchange ") == 3  # both operands and the terms; five when cells were summed by row and column first
    assert "ENSURE_REQUIREMENTS" not in plan


def test_sparse_cells_of_repeated_keys(spark):
    rows = spark.createDataFrame([(7, 9, 2)] * 40 + [(7, 8, 1), (None, 8, 1), (6, 9, 5), (6, 9, -5)], "r long, c long, v long")
    m = B.from_table(rows, F.col("r"), F.col("c"), F.col("v"), 24, 22)
    assert sorted(map(tuple, m.df.collect())) == [(7, 8, 1), (7, 9, 80)]
    assert sorted(map(tuple, (m.adjoint() @ m).df.collect())) == [(8, 8, 1), (8, 9, 80), (9, 8, 80), (9, 9, 6400)]

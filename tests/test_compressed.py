"""Algebra on shared blocks against the same on entries, and on matrices far too large for entries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlake.functions import scalars as S
from quadlake.matrix import Matrix
from quadlake.plans import quadtree as Q
from quadlake.sources import build as B

from test_matrix import array, dense

SHAPES = [(0, 0), (0, 3), (3, 1), (4, 4)]


@pytest.fixture(params=[20_000, 0], ids=["few", "many"])
def few(request, monkeypatch):
    """Blocks that the driver names, and blocks that Spark names."""
    monkeypatch.setattr(Q, "FEW", request.param)
    return request.param


def made(spark, a, r, c):
    m = B.from_numpy(spark, a)
    return Matrix(m.df, r, c, S.INTEGER)


@pytest.mark.parametrize("shape", SHAPES)
def test_unary(spark, shape):
    unary(spark, shape)


def test_unary_of_many(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 0)
    unary(spark, (2, 1))


def unary(spark, shape):
    a = array(sum(shape), *shape)
    A = made(spark, a, *shape)
    x = Q.compress(A)
    plus = Q.apply(x, lambda v: v + 1)
    assert (dense(Q.expand(plus)) == a + 1).all() and plus.root == Q.compress(A.apply(lambda v: v + 1)).root
    merged = Q.entry_squared(x, 3)  # different scalars become one
    assert merged.root == Q.compress(A.map(lambda v: 3 * v * v)).root
    assert Q.scale(x, 0).root == Q.zero_id(*shape) and Q.divide(x, 2).root == Q.compress(A.divide(2)).root
    t = Q.adjoint(x)
    assert (t.row_level, t.col_level) == shape[::-1] and t.root == Q.compress(A.adjoint()).root and (dense(Q.expand(t)) == a.T).all()
    assert [int(x.norm(k).first()[0]) for k in (0, 1)] == [abs(a).max(), abs(a).sum()] and abs(x.norm(2).first()[0] - np.sqrt((a * a).sum())) < 1e-9
    assert x.total().first()[0] == a.sum() and x.trace_norm(2).first()[0] == 2 * (a * a).sum()
    for v in (0, 1, 7):
        assert int(x.count(v).first()[0]) == (a == v).sum()
        assert {tuple(p) for p in x.locate(v).collect()} == set(zip(*map(list, np.nonzero(a == v))))
    assert tuple(x.max_element().first()) == tuple(A.max_element().first() or (0, 0, 0))
    i, j = a.shape[0] - 1, a.shape[1] // 2
    assert x.entry(i, j).first()[0] == a[i, j]
    if shape[0] == shape[1]:
        assert x.trace().first()[0] == np.trace(a)
    with pytest.raises(ValueError):
        Q.constant(spark, 1, *shape).locate(1, most=a.size - 1)


@pytest.mark.parametrize("shapes", [((0, 2), (2, 0)), ((2, 0), (0, 2)), ((1, 3), (3, 2)), ((2, 2), (2, 2))])
def test_products(spark, few, shapes):
    (r, k), (k2, c) = shapes
    a, b = array(1, r, k), array(2, k2, c)
    A, C = made(spark, a, r, k), made(spark, b, k2, c)
    x, y = Q.compress(A), Q.compress(C)
    p = Q.product(x, y, keep_rows=0)
    assert (dense(Q.expand(p)) == a @ b).all()
    assert p.root == Q.compress(Matrix(B.from_numpy(spark, a @ b).df, r, c, S.INTEGER)).root
    k = Q.kron(x, y)
    assert (dense(Q.expand(k)) == np.kron(a, b)).all() and k.root == Q.compress(A.kron(C)).root


def test_types(spark):
    z = [1 + 2j, 0, 0.5, -1j]
    A = B.from_list(spark, [f"{v.real}+I*{v.imag}" if v.imag >= 0 else f"{v.real}-I*{-v.imag}" for v in map(complex, z)], 1, 1, S.COMPLEX)
    a = np.array(z).reshape(2, 2)
    x = Q.compress(A)
    assert np.allclose(dense(Q.expand(Q.product(x, Q.adjoint(x)))), a @ a.conj().T)
    q = B.from_list(spark, ["1/2", "0", "1/3", "-1/6"], 1, 1, S.MPRATIONAL)
    y = Q.compress(q)
    assert Q.product(y, y).same(Q.compress(q @ q)) and Q.kron(y, y).same(Q.compress(q.kron(q))) and y.trace().first()[0] == "1/3"
    o = B.from_list(spark, ["1", "1", "0", "1"], 1, 1, S.BOOLEAN)
    w = Q.compress(o)
    assert Q.product(w, w).same(Q.compress(o @ o)) and Q.add(w, w).same(w)


def test_large_levels(spark):
    """2^64 cells: tables of some tens of blocks."""
    eye, ones = Q.identity(spark, 32), Q.constant(spark, 3, 32, 32)
    assert ones.size() == 33 and int(ones.count(3).first()[0]) == 1 << 64
    two = Q.apply(eye, lambda v: v + 1)  # f(0) is not 0
    assert int(two.count(2).first()[0]) == 1 << 32 and int(two.count(1).first()[0]) == (1 << 64) - (1 << 32) and two.trace().first()[0] == 1 << 33
    assert Q.product(eye, ones).same(ones)
    assert Q.product(eye, Q.adjoint(eye)).same(eye)
    assert [tuple(p) for p in Q.adjoint(two).max_element().collect()] == [(0, 0, 2)]
    far = Q.compress(B.one_hot(spark, 32, (1 << 32) - 1, 5, 9))
    assert [tuple(p) for p in far.locate(9).collect()] == [((1 << 32) - 1, 5)] and far.entry((1 << 32) - 1, 5).first()[0] == 9
    h = Q.hadamard(spark, 12)
    assert Q.product(h, h).same(Q.scale(Q.identity(spark, 12), 1 << 12))
    assert Q.hadamard(spark, 4).same(Q.compress(B.hadamard(spark, 4))) and Q.identity(spark, 4).same(Q.compress(B.identity(spark, 4)))
    assert Q.constant(spark, 5, 1, 4).same(Q.compress(B.constant(spark, 5, 1, 4))) and Q.constant(spark, 0, 2, 2).same(Q.compress(B.zero(spark, 2, 2)))


def test_quadrants(spark):
    a = array(9, 2, 2)
    x = Q.compress(B.from_numpy(spark, a))
    four = [x.quadrant(q) for q in range(4)]
    assert (dense(Q.expand(four[1])) == a[:2, 2:]).all() and Q.from_quadrants(*four).same(x)
    assert x.describe()["scalars"] == len(np.unique(a)) and x.find(x.nodes.where("row_level = 2")).count() == 1


@pytest.mark.parametrize("level", [31, 32])
def test_order_at_the_highest_levels(spark, level):
    top = 1 << (level - 1)
    df = spark.createDataFrame([(0, 5, 1), (top, 3, 1), (top - 1, top, 1), (top, top, 1)], "row bigint, col bigint, val bigint")
    m = Matrix(df, level, level)
    assert tuple(m.max_element().first()) == (0, 5, 1)
    assert [tuple(x) for x in m.locate(1).collect()] == [(0, 5), (top - 1, top), (top, 3), (top, top)]
    if level == 32:
        with pytest.raises(ValueError):
            m.dense()
    assert not m.is_invalid() and Matrix(df.unionByName(df), level, level).is_invalid()
    assert int(m.count(0).first()[0]) == (1 << 2 * level) - 4 and m.product(m.adjoint(), keep_rows=1).df.select(F.max("row")).first()[0] == top

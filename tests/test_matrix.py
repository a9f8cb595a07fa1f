"""Matrix operators against numpy, for all orientations; files, compressed form and regions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlake.functions import regions
from quadlake.functions import scalars as S
from quadlake.matrix import Matrix
from quadlake.operators import transforms as T
from quadlake.plans import quadtree as Q
from quadlake.sources import build as B
from quadlake.sources import files


def dense(m):
    out = np.zeros(m.shape, complex if m.stype is S.COMPLEX else float)
    for x in m.df.collect():
        out[x.row, x.col] = complex(x.val.re, x.val.im) if m.stype is S.COMPLEX else float(x.val)
    return out


def array(seed, r, c):
    return np.random.default_rng(seed).integers(-2, 3, (1 << r, 1 << c))


@pytest.mark.parametrize("shape", [(0, 0), (0, 2), (2, 0), (2, 1), (1, 2), (2, 2)])
def test_algebra(spark, shape, monkeypatch):
    a, b = array(1, *shape), array(2, *shape)
    A, B_ = (B.from_numpy(spark, x) if x.any() else B.zero(spark, *shape) for x in (a, b))
    A = type(A)(A.df, *shape, S.INTEGER)
    B_ = type(A)(B_.df, *shape, S.INTEGER)
    assert (dense(A + B_) == a + b).all() and (dense(A - B_) == a - b).all() and (dense(A.saxpy(B_, 2, -3)) == 2 * a - 3 * b).all()
    assert (dense(A.adjoint()) == a.T).all() and (dense(A.kron(B_)) == np.kron(a, b)).all()
    assert (dense(A.join(B_)) == np.hstack([a, b])).all() and (dense(A.stack(B_)) == np.vstack([a, b])).all()
    assert (dense(A @ B_.adjoint()) == a @ b.T).all()
    assert A.norm(1).first()[0] == abs(a).sum() and A.norm(0).first()[0] == abs(a).max()
    assert A.trace_norm(3).first()[0] == 3 * (a * a).sum() and int(A.count(0).first()[0]) == (a == 0).sum()
    assert (A - A).is_zero() and A.equals(A) and (A + B_).equals(B_ + A)
    nt = Q.compress(A)
    assert (dense(Q.expand(nt)) == a).all() and int(nt.count(0).first()[0]) == (a == 0).sum()
    both = Q.add(nt, Q.compress(B_))
    assert (dense(Q.expand(both)) == a + b).all() and both.root == Q.compress(A + B_).root
    if shape in ((2, 1), (2, 2)):
        monkeypatch.setattr(Q, "FEW", 0)  # as for tables that the driver cannot hold
        nt = Q.compress(A)
        assert (dense(Q.expand(nt)) == a).all() and Q.add(nt, Q.compress(B_)).root == both.root


def test_access(spark):
    a = array(3, 2, 2)
    A = B.from_numpy(spark, a)
    for q in range(4):
        assert (dense(A.quadrant(q)) == a[2 * (q // 2) : 2 * (q // 2) + 2, 2 * (q % 2) : 2 * (q % 2) + 2]).all()
    assert B.from_quadrants(*(A.quadrant(q) for q in range(4))).equals(A)
    assert A.at(1, 2).first()[0] == a[1, 2] and A.replaced(1, 2, 9).at(1, 2).first()[0] == 9
    with pytest.raises(IndexError):
        A.at(4, 0)
    with pytest.raises(ValueError):
        A + B.zero(spark, 1, 1)
    assert {(x.row, x.col) for x in A.locate(0).collect()} == set(zip(*map(list, np.nonzero(a == 0))))
    with pytest.raises(ValueError):
        A.locate(0, most=1)


def test_transforms(spark):
    a = array(4, 3, 1)
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)])
    A = B.from_numpy(spark, a)
    assert (dense(T.hadamard_times(A)) == h @ a).all() and (dense(T.times_hadamard(A.adjoint())) == a.T @ h).all()
    f = np.exp(2j * np.pi * np.outer(range(8), range(8)) / 8)
    v = A.map(lambda x: S.COMPLEX.pair(x, x * 0), S.COMPLEX)
    assert np.allclose(dense(T.fourier(v)), f @ a) and np.allclose(dense(B.fft_matrix(spark, 3)), f)
    eye = B.identity(spark, 1, S.COMPLEX)
    step = B.fft_combine(spark, 3) @ eye.kron(B.fft_matrix(spark, 2)) @ B.inverse_shuffle(spark, 3, S.COMPLEX)
    assert np.allclose(dense(step), f)


def test_exact_types(spark):
    for t, x, y, total, square in (
        (S.MPRATIONAL, "1/3", "1/6", "1/2", "1/9"),
        (S.CLIFFORD, "{S2}", "(1/2)*{S2}", "(3/2)*{S2}", "(2)*{1}"),
        (S.MPRATCOMPLEX, "1/2+I*1", "1/2-I*1", "1+I*0", "-3/4+I*1"),
        (S.MPREAL, "0.1", "0.2", "0.3", "0.01"),
        (S.MPCOMPLEX, "1.5+I*2", "0-I*2", "1.5+I*0", "-1.75+I*6"),
    ):
        m = B.from_list(spark, [x, "0", "0", y], 1, 1, t)
        assert m.trace().first()[0] == total
        assert (m @ m).at(0, 0).first()[0] == square
        assert (m - m).is_zero() and m.divide(x).at(0, 0).first()[0] == t._one
    n = B.from_list(spark, [str(10**30), "0", "0", "-7"], 1, 1, S.MPINTEGER)
    assert int(n.trace().first()[0]) == 10**30 - 7 and int(n.divide(2).at(1, 1).first()[0]) == -3
    b = B.from_list(spark, ["1", "1", "0", "1"], 1, 1, S.BOOLEAN)
    assert {(x.row, x.col) for x in (b @ b).df.collect()} == {(0, 0), (0, 1), (1, 1)}
    z = S.Algebraic()
    for s in ("{S2}+{S3}*I", "(1/3)*{1}-(2/5)*{S6}", "3+{S2}-{S6}*I"):
        assert z.mul(z.div(z.parse("1"), z.parse(s)), z.parse(s)) == z.parse("1")


def test_files(spark, tmp_path):
    for k, (t, values) in enumerate(((S.INTEGER, "1 0 4 2 4 -3 1 0"), (S.REAL, "1 0 .4 .2 .4 .3 1 0"), (S.COMPLEX, "1 I .4 .2+I .4 .3+I 1 I"), (S.MPRATIONAL, "1 0 4/10 2/10 4/10 3/10 1 0"))):
        p = tmp_path / f"{k}.rmm"
        p.write_text("1 2\n" + values)
        m = files.read_row_major(spark, str(p))
        assert m.stype is t and (m.row_level, m.col_level) == (1, 2)
        for top_left in (False, True):
            size = files.write_json(m, str(tmp_path / f"{k}.json"), top_left)
            if t is S.INTEGER:
                assert size == Q.compress(m).size() == 9  # worked out by hand: one root, two halves, six scalars
            back = files.read_json(spark, str(tmp_path / f"{k}.json"))
            assert back.stype is t and back.equals(m)
    assert files.levels(spark, str(tmp_path / "0.json")) == (1, 2)
    files.write_dense(m, str(tmp_path / "d.txt"))
    assert (tmp_path / "d.txt").read_text() == "1 0 2/5 1/5\n2/5 3/10 1 0\n"
    (tmp_path / "old.json").write_text('{"matrixID_max":9,"matid":4,"table":{"1":[0,0,2],"2":[0,0,0],"4":[1,1,1,2,2,1],"end":0}}')
    assert (dense(files.read_json(spark, str(tmp_path / "old.json"))) == [[2, 0], [0, 2]]).all()
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n8 8 5\n2 2 10\n6 2 250\n3 5 -1\n1 6 33\n7 4 -15\n")
    m = files.read_coordinates(spark, str(tmp_path / "m.mtx"))
    assert (m.trace().first()[0], m.norm(1).first()[0], m.norm(0).first()[0], m.trace_norm().first()[0], int(m.count(0).first()[0])) == (10, 309, 250, 63915, 59)
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 3 0\n2 1 1 -2\n")
    assert (dense(files.read_coordinates(spark, str(tmp_path / "s.mtx"))) == [[3, 1 + 2j], [1 - 2j, 0]]).all()
    (tmp_path / "bad.mtx").write_text("8 8 5\n2 2 10\n")
    with pytest.raises(ValueError):
        files.read_coordinates(spark, str(tmp_path / "bad.mtx"))


def test_files_in_many_tasks(spark, tmp_path):
    """Small splits: a file's lines meet in several tasks, and places and types come of all of them."""
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        r = random.Random(7)
        rows = [[r.randint(-99, 99) for _ in range(16)] for _ in range(256)]
        text = "\n".join("  ".join(map(str, x)) for x in rows)
        (tmp_path / "a.rmm").write_text("8\n4 " + text[: len(text) - 5] + " 1/3 ")
        assert spark.read.text(str(tmp_path / "a.rmm")).rdd.getNumPartitions() > 3
        if len((tmp_path / "a.rmm").read_text().split()) < 2 + 4096:
            (tmp_path / "a.rmm").write_text((tmp_path / "a.rmm").read_text() + " 5 5 5")
        want = (tmp_path / "a.rmm").read_text().split()[2 : 2 + 4096]
        m = files.read_row_major(spark, str(tmp_path / "a.rmm"))
        assert m.stype is S.MPRATIONAL  # the only quotient is near the end
        got = {(x.row, x.col): x.val for x in m.df.collect()}
        assert got == {(k // 16, k % 16): v for k, v in enumerate(want) if v not in ("0",)}
        n = B.from_numpy(spark, np.array(rows))
        for parts in (False, True):
            path = str(tmp_path / f"m{parts}")
            size = files.write_json(n, path, parts=parts)
            assert spark.read.text(path).rdd.getNumPartitions() > 3
            nt, info = files.read_nodes(spark, path)
            assert nt.size() == size == int(info["NODES"]) and Q.expand(nt).equals(n) and nt.same(Q.compress(n))
        assert files.equal_files(spark, str(tmp_path / "mFalse"), str(tmp_path / "mTrue"))
        files.write_coordinates(n, str(tmp_path / "m.mtx"))
        assert Matrix(files.read_coordinates(spark, str(tmp_path / "m.mtx")).df, 8, 4, S.INTEGER).equals(n)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    z = B.from_list(spark, ["1", "I", "0", "I"], 1, 1, S.COMPLEX)
    assert files.write_scalars(z, str(tmp_path / "z.txt")) == 3
    assert sorted((tmp_path / "z.txt").read_text().split("\n")[:-1]) == ["0.0 0.0", "0.0 1.0", "1.0 0.0"]
    assert "SCALARTYPE\tCOMPLEX" in (tmp_path / "z.txt.info").read_text()


def test_regions(spark):
    r = random.Random(2)
    bits = 3
    values = [r.choice([0.0, 0.05, -0.05, 0.5, 0.52, 0.4375, 1.06, -1.01, 0.2, 0.19, 0.3, 3.0]) + r.randint(0, 1) * 0.01 for _ in range(16)]
    m = B.from_list(spark, [repr(v) for v in values], 2, 2, S.REAL)
    order = sorted(itertools.product(range(4), range(4)), key=lambda p: (p[0] >> 1, p[1] >> 1, p[0] & 1, p[1] & 1))
    single, owner, want, tiles = {}, {}, np.zeros((4, 4)), np.zeros((4, 4))
    for x, at in [*((x, None) for x in regions.PRELOADED), *((values[4 * i + j], (i, j)) for i, j in order if values[4 * i + j])]:
        key = np.sign(x) * np.floor(abs(x) * 2**bits + 0.5)
        first = single.setdefault(key, x)
        tile = np.floor(x * 2**bits)
        if tile not in owner:
            owner[tile] = x
            owner.setdefault(tile + (-1 if x * 2**bits - tile < 0.5 else 1), x)
        if at:
            want[at], tiles[at] = first, owner[tile]
    assert (dense(regions.snap_single(m, bits)) == want).all()
    assert (dense(regions.snap_adjacent(m, bits)) == tiles).all()


def test_complex_regions(spark):
    """Values claim up to three neighbours; the rule one by one, in the order of quadrants."""
    r = random.Random(3)
    bits, values = 2, []
    for _ in range(64):
        values.append(complex(r.choice([0, 0.1, 0.24, 0.26, -0.1, 0.5, 0.55, 1.02]) + r.randint(0, 2) * 0.01, r.choice([0, 0.05, -0.2, 0.3])))
    m = B.from_list(spark, [f"{v.real}{'-' if v.imag < 0 else '+'}I*{abs(v.imag)}" for v in values], 3, 3, S.COMPLEX)
    order = sorted(itertools.product(range(8), range(8)), key=lambda p: [b for k in (2, 1, 0) for b in (p[0] >> k & 1, p[1] >> k & 1)])
    owner, want = {}, np.zeros((8, 8), complex)
    for x, at in [*((complex(x), None) for x in regions.PRELOADED), *((values[8 * i + j], (i, j)) for i, j in order if values[8 * i + j])]:
        tile = tuple(int(np.floor(v * 2**bits)) for v in (x.real, x.imag))
        if tile not in owner:
            owner[tile] = x
            si, sj = (-1 if v * 2**bits - t < 0.5 else 1 for v, t in zip((x.real, x.imag), tile))
            for other in ((tile[0], tile[1] + sj), (tile[0] + si, tile[1]), (tile[0] + si, tile[1] + sj)):
                owner.setdefault(other, x)
        if at:
            want[at] = owner[tile]
    assert (dense(regions.snap_adjacent(m, bits)) == want).all()


def test_region_store(spark):
    store = regions.RegionStore(spark, S.REAL, bits=3)
    a, b = (B.from_list(spark, v, 1, 1, S.REAL) for v in (["0.3", "0.29", "0.02", "7.5"], ["0.31", "0.51", "7.51", "1.01"]))
    assert dense(store.snap(a)).tolist() == [[0.3, 0.3], [0.0, 7.5]]
    assert dense(store.snap(b)).tolist() == [[0.3, 0.5], [7.5, 1.0]]  # what came first stands, in later matrices too
    assert store.clean(b) == 0 and store.clean(B.from_list(spark, ["0.3", "0", "0", "0"], 1, 1, S.REAL)) == 1
    assert dense(store.snap(b)).tolist() == [[0.3, 0.5], [7.51, 1.0]]
    added = regions.regional(lambda x, y: x + y, lambda x: regions.snap_single(x, 1))(a, b)  # 0.61, 0.8, 7.53, 8.51
    assert np.allclose(dense(added), [[0.5, 1.0], [7.53, 8.51]])


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    z = S.COMPLEX
    for a, b, code, order in (("1+I*1", "1+I*1", 0, 0), ("2+I*1", "1+I*1", 1, 1), ("0+I*1", "1+I*1", 2, -1), ("1+I*2", "1+I*1", 4, 1), ("2+I*2", "1+I*1", 5, 1), ("0+I*2", "1+I*1", 6, -1), ("1+I*0", "1+I*1", 8, -1), ("2+I*0", "1+I*1", 9, 1), ("0+I*0", "1+I*1", 10, -1)):
        for t in (S.COMPLEX, S.MPRATCOMPLEX, S.MPCOMPLEX):
            assert one(t.compare_parts(t.lit(a), t.lit(b))) == code and one(t.compare(t.lit(a), t.lit(b))) == order
    assert one(z.is_real(z.lit("2"))) and one(z.is_imaginary(z.lit("2*I"))) and not one(z.is_regular(z.lit("2*I"))) and one(z.is_regular(z.lit("1+I*2")))
    assert one(S.CLIFFORD.compare(S.CLIFFORD.lit("{S2}"), S.CLIFFORD.lit("(3/2)*{1}"))) == -1
    for t in (S.REAL, z):
        v = t.of_doubles(F.lit(float("inf")), F.lit(0.0))
        assert one(t.is_infinite(v)) and not one(t.is_regular(v)) and not one(t.is_nan(v))
        assert one(t.is_nan(t.of_doubles(F.lit(float("nan")), F.lit(0.0))))
    assert one(S.REAL.exact_text(F.lit(0.1))) == "0x1.999999999999ap-4" and one(z.exact_text(z.lit("1-I*0.5"))) == "0x1.0p0-I*0x1.0p-1"
    assert one(S.MPRATIONAL.of_doubles(F.lit(0.75), F.lit(0.0))) == "3/4" and one(S.INTEGER.of_doubles(F.lit(3.0), F.lit(0.0))) == 3 and one(S.BOOLEAN.of_doubles(F.lit(3.0), F.lit(0.0)))
    assert one(S.CLIFFORD.of_doubles(F.lit(0.5), F.lit(-2.0))) == "(1/2)*{1}-(2)*{1}*I"
    for bad in ((3.5, 0.0), (3.0, 1.0)):
        with pytest.raises(Exception):
            one(S.INTEGER.of_doubles(*map(F.lit, bad)))
    assert S.guess_type(["1", "-9223372036854775808"]) is S.MPINTEGER and S.guess_type(["1/2", "I"]) is S.MPRATCOMPLEX
    for tokens in (["1", "2"], ["1", "99999999999999999999"], ["1", ".5"], ["1/2"], ["I"], ["{S2}"], ["1/2", "i"]):
        df = spark.createDataFrame([(x,) for x in tokens], "s string")
        assert S.guess_column(df, F.col("s")) is S.guess_type(tokens)


def test_least(spark):
    """Exactly k rows with the least hashes, ties by the other columns, at any depth of counting."""
    df = spark.range(5000).select(F.shiftleft(F.col("id") % 7, 40).alias("h"), "id").unionByName(spark.range(5000, 9000).select(F.shiftrightunsigned(F.xxhash64("id"), 4).alias("h"), "id"))
    every = sorted(map(tuple, df.collect()))
    for k in (0, 1, 700, 3000, 5003, 9000):
        assert sorted(map(tuple, B._least(df, "h", k, ["id"], enough=50).collect())) == every[:k]


def test_builders(spark):
    assert (dense(B.from_numpy(spark, np.ones((3, 5)), S.REAL))[:3, :5] == 1).all()
    m = B.random_entries(spark, 3, 3, -5, 5, 0.3, seed=4)
    assert int(m.count(0).first()[0]) == round(0.3 * 64)
    for ones in (0, 7, 25, 32):
        got = B.random_ones(spark, 3, 2, ones).df.collect()
        assert len(got) == len({(x.row, x.col) for x in got}) == ones and all(x.row < 8 and x.col < 4 for x in got)
    assert B.random_ones(spark, 30, 30, 100).df.count() == 100 and not B.identity(spark, 2).is_invalid()
    assert (dense(B.not_gate(spark)) == [[0, 1], [1, 0]]).all() and B.identity(spark, 3).is_identity()

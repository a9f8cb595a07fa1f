"""Scalar types. Each gives Spark expressions for its arithmetic, so that a matrix operator is one plan for all of them.

Types that Spark has (INTEGER, REAL, BOOLEAN, COMPLEX as a struct, MPINTEGER as a decimal) stay in generated code. Exact
types (rationals, 256-bit floats, algebraic numbers) travel as canonical strings and are computed in Arrow batches.
"""

from __future__ import annotations

import re
from decimal import Context, Decimal
from fractions import Fraction
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ScalarType:
    """INTEGER: 64-bit integers. Overflow is an error; division truncates towards zero."""

    name, dtype, complex = "INTEGER", "bigint", False

    def lit(self, x) -> Column:
        return self.parse(F.lit(str(x))) if isinstance(x, str) else F.lit(x).cast(self.dtype)

    def parse(self, s: Column) -> Column:
        return F.trim(s).cast(self.dtype)

    def text(self, v: Column) -> Column:
        return v.cast("string")

    def zero(self) -> Column:
        return F.lit(0).cast(self.dtype)

    def one(self) -> Column:
        return F.lit(1).cast(self.dtype)

    def times(self, a: Column, b: Column) -> Column:
        return a * b

    def plus(self, a: Column, b: Column) -> Column:
        return a + b

    def minus(self, a: Column) -> Column:
        return -a

    def conj(self, a: Column) -> Column:
        return a

    def over(self, a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    def root(self, a: Column) -> Column:
        return F.sqrt(a.cast("double")).cast("bigint")

    def norm(self, a: Column) -> Column:
        return F.abs(a)

    def squared(self, a: Column) -> Column:
        """|a| squared, in the type's own norm."""
        return a * a

    def size(self, a: Column) -> Column:
        """What to order by the norm."""
        return self.norm(a)

    def nonzero(self, a: Column) -> Column:
        return a != self.zero()

    def same(self, a: Column, b: Column) -> Column:
        return a == b

    def total(self, v: Column) -> Column:
        return F.sum(v).cast(self.dtype)

    def compare(self, a: Column, b: Column) -> Column:
        """-1, 0 or 1."""
        return F.when(a < b, -1).when(a > b, 1).otherwise(0)

    def compare_parts(self, a: Column, b: Column) -> Column:
        """One number for how real and imaginary parts compare: that of the real parts and four times that of the imaginary
        ones, where 0 is equal, 1 greater and 2 less."""
        c = self.compare(a, b)
        return F.when(c < 0, 2).otherwise(c)

    def is_real(self, a: Column) -> Column:
        return F.lit(True)

    def is_imaginary(self, a: Column) -> Column:
        return F.lit(False)

    def is_nan(self, a: Column) -> Column:
        return F.lit(False)

    def is_infinite(self, a: Column) -> Column:
        return F.lit(False)

    def is_regular(self, a: Column) -> Column:
        """Neither zero, infinite nor no number."""
        return self.nonzero(a) & ~self.is_nan(a) & ~self.is_infinite(a)

    def of_doubles(self, re_: Column, im: Column) -> Column:
        """The scalar of a real and an imaginary part; what the type cannot hold is an error."""
        ok = (im == 0) & (re_ == F.floor(re_).cast("double"))
        return F.when(ok, re_.cast(self.dtype)).otherwise(F.raise_error(F.lit(f"no {self.name}")))

    def exact_text(self, v: Column) -> Column:
        """Text that loses nothing."""
        return self.text(v)

    def hash(self, v: Column) -> Column:
        return F.xxhash64(v)

    def sum_by(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """keys and val: the sum of val by keys, without zeros."""
        return df.groupBy(*keys).agg(self.total(F.col("val")).alias("val")).where(self.nonzero(F.col("val")))


class Real(ScalarType):
    """REAL: doubles (53 bits)."""

    name, dtype = "REAL", "double"

    def over(self, a, b):
        return a / b

    def root(self, a):
        return F.sqrt(a)

    def is_nan(self, a):
        return F.isnan(a)

    def is_infinite(self, a):
        return F.abs(a) == float("inf")

    def of_doubles(self, re_, im):
        return F.when(im == 0, re_).otherwise(F.raise_error(F.lit("no REAL")))

    def exact_text(self, v):
        """Hexadecimal, as every bit counts."""
        return _hex(v)


def _hex(v: Column) -> Column:
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("toHexString"), v)


class BigInteger(ScalarType):
    """MPINTEGER: integers of up to 38 digits; beyond them Spark reports an overflow."""

    name, dtype = "MPINTEGER", "decimal(38,0)"

    def times(self, a, b):
        return (a * b).cast(self.dtype)

    def over(self, a, b):
        return F.call_function("div", a, b).cast(self.dtype)

    def root(self, a):
        return F.floor(F.sqrt(a.cast("double"))).cast(self.dtype)

    def squared(self, a):
        return (a * a).cast(self.dtype)


class Boolean(ScalarType):
    """BOOLEAN: sum is OR, product is AND, a quotient is its numerator."""

    name, dtype = "BOOLEAN", "boolean"

    def parse(self, s):
        return F.coalesce(F.trim(s).try_cast("double") != 0, F.trim(s).try_cast("boolean"))

    def lit(self, x):
        return F.lit(bool(x)) if not isinstance(x, str) else self.parse(F.lit(x))

    def text(self, v):
        return F.when(v, F.lit("1")).otherwise(F.lit("0"))

    def zero(self):
        return F.lit(False)

    def one(self):
        return F.lit(True)

    def times(self, a, b):
        return a & b

    def plus(self, a, b):
        return a | b

    def minus(self, a):
        return a

    def over(self, a, b):
        return a

    def root(self, a):
        return a

    def norm(self, a):
        return a.cast("bigint")

    def squared(self, a):
        return a

    def nonzero(self, a):
        return a

    def total(self, v):
        return F.bool_or(v)

    def of_doubles(self, re_, im):
        return F.when(im == 0, re_ != 0).otherwise(F.raise_error(F.lit("no BOOLEAN")))


class Complex(ScalarType):
    """COMPLEX: a struct of two doubles, written a+I*b."""

    name, dtype, complex = "COMPLEX", "struct<re:double,im:double>", True

    @staticmethod
    def pair(re_: Column, im: Column) -> Column:
        return F.struct(re_.cast("double").alias("re"), im.cast("double").alias("im"))

    def lit(self, x):
        return self.parse(F.lit(x)) if isinstance(x, str) else self.pair(F.lit(complex(x).real), F.lit(complex(x).imag))

    def parse(self, s):
        t = F.regexp_replace(s, r"\s", "")
        number = r"[0-9.]+(?:[eE][+-]?[0-9]+)?"
        im = F.coalesce(F.nullif(F.regexp_extract(t, rf"([+-]?)I(?:\*({number}))?$", 0), F.lit("")), F.lit(""))
        sign = F.when(F.startswith(im, F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
        size = F.regexp_extract(im, rf"I\*({number})", 1)
        # the imaginary unit may also stand last: 2*I, 2i
        last = F.regexp_extract(t, rf"([+-]?{number})\*?[Ii]$", 1)
        real = F.regexp_extract(t, rf"^([+-]?{number})(?:$|[+-])", 1)
        none = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("double"), F.lit(0.0))
        return self.pair(none(real), F.when(im != "", sign * F.when(size == "", F.lit(1.0)).otherwise(none(size))).when(last != "", none(last)).when(F.lower(t).rlike("^[+]?i$"), F.lit(1.0)).when(F.lower(t) == "-i", F.lit(-1.0)).when(F.lower(t).rlike("[+]i$"), F.lit(1.0)).when(F.lower(t).rlike("-i$"), F.lit(-1.0)).otherwise(F.lit(0.0)))

    def text(self, v):
        return F.concat(v["re"].cast("string"), F.when(v["im"] < 0, F.lit("-I*")).otherwise(F.lit("+I*")), F.abs(v["im"]).cast("string"))

    def zero(self):
        return self.pair(F.lit(0.0), F.lit(0.0))

    def one(self):
        return self.pair(F.lit(1.0), F.lit(0.0))

    def times(self, a, b):
        return self.pair(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])

    def plus(self, a, b):
        return self.pair(a["re"] + b["re"], a["im"] + b["im"])

    def minus(self, a):
        return self.pair(-a["re"], -a["im"])

    def conj(self, a):
        return self.pair(a["re"], -a["im"])

    def over(self, a, b):
        n = b["re"] * b["re"] + b["im"] * b["im"]
        return self.pair((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n)

    def root(self, a):
        m = self.norm(a)
        return self.pair(F.sqrt((m + a["re"]) / 2), F.when(a["im"] < 0, -F.sqrt((m - a["re"]) / 2)).otherwise(F.sqrt((m - a["re"]) / 2)))

    def norm(self, a):
        return F.hypot(a["re"], a["im"])

    def squared(self, a):
        return self.pair(a["re"] * a["re"] + a["im"] * a["im"], F.lit(0.0))

    def nonzero(self, a):
        return (a["re"] != 0) | (a["im"] != 0)

    def same(self, a, b):
        return (a["re"] == b["re"]) & (a["im"] == b["im"])

    def total(self, v):
        return self.pair(F.sum(v["re"]), F.sum(v["im"]))

    def compare(self, a, b):
        """Complex numbers have no order: real parts decide, and imaginary ones between equals."""
        re_, im = (F.when(a[p] < b[p], -1).when(a[p] > b[p], 1).otherwise(0) for p in ("re", "im"))
        return F.when(re_ != 0, re_).otherwise(im)

    def compare_parts(self, a, b):
        re_, im = (F.when(a[p] < b[p], 2).when(a[p] > b[p], 1).otherwise(0) for p in ("re", "im"))
        return re_ + 4 * im

    def is_real(self, a):
        return a["im"] == 0

    def is_imaginary(self, a):
        return a["re"] == 0

    def is_nan(self, a):
        return F.isnan(a["re"]) | F.isnan(a["im"])

    def is_infinite(self, a):
        return (F.abs(a["re"]) == float("inf")) | (F.abs(a["im"]) == float("inf"))

    def is_regular(self, a):
        """Both parts are neither zero, infinite nor no number."""
        part = lambda x: (x != 0) & ~F.isnan(x) & (F.abs(x) < float("inf"))
        return part(a["re"]) & part(a["im"])

    def of_doubles(self, re_, im):
        return self.pair(re_, im)

    def exact_text(self, v):
        return F.concat(_hex(v["re"]), F.when(v["im"] < 0, F.lit("-I*")).otherwise(F.lit("+I*")), _hex(F.abs(v["im"])))


BITS = Context(prec=78)  # 256 bits


class Field:
    """Python arithmetic of an exact type: values, and their canonical text."""

    def parse(self, s: str):
        return Fraction(s.strip())

    def text(self, x) -> str:
        return str(x)

    def add(self, x, y):
        return x + y

    def mul(self, x, y):
        return x * y

    def div(self, x, y):
        return x / y

    def neg(self, x):
        return -x

    def conj(self, x):
        return x

    def norm(self, x):
        return abs(x)

    def root(self, x):
        """Exact where it is rational; else to 78 digits."""
        n, d = isqrt(x.numerator), isqrt(x.denominator)
        if n * n == x.numerator and d * d == x.denominator:
            return Fraction(n, d)
        return Fraction(BITS.sqrt(BITS.divide(Decimal(x.numerator), Decimal(x.denominator))))

    def size(self, x) -> float:
        return float(abs(x))

    def parts(self, x) -> tuple:
        """Real and imaginary part, as numbers that compare."""
        return x, 0

    def of(self, re_: float, im: float):
        if im:
            raise ValueError("no imaginary part can be held")
        return self.parse(str(Fraction(re_)))


class Float256(Field):
    def parse(self, s):
        s = s.strip()
        if "/" in s:
            p, q = s.split("/")
            return BITS.divide(Decimal(p), Decimal(q))
        return BITS.create_decimal(s)

    def text(self, x):
        return "0" if not x else str(x.normalize(BITS))

    def add(self, x, y):
        return BITS.add(x, y)

    def mul(self, x, y):
        return BITS.multiply(x, y)

    def div(self, x, y):
        return BITS.divide(x, y)

    def root(self, x):
        return BITS.sqrt(x)

    def norm(self, x):
        return BITS.abs(x)

    def of(self, re_, im):
        if im:
            raise ValueError("no imaginary part can be held")
        return BITS.create_decimal(Decimal(re_))


IMAGINARY = re.compile(r"^(?P<re>[^I]*?)?(?:(?P<sign>[+-]?)I(?:\*(?P<im>.+))?)?$")


class Pair(Field):
    """Complex numbers over another field, written a+I*b."""

    def __init__(self, part: Field):
        self.part = part

    def parse(self, s):
        m = IMAGINARY.match(s.replace(" ", ""))
        zero = self.part.parse("0")
        if not m:
            raise ValueError(f"no complex number: {s}")
        a = self.part.parse(m["re"]) if m["re"] else zero
        if m["sign"] is None:
            return a, zero
        b = self.part.parse(m["im"] or "1")
        return a, self.part.neg(b) if m["sign"] == "-" else b

    def text(self, x):
        a, b = (self.part.text(v) for v in x)
        return f"{a}-I*{b[1:]}" if b.startswith("-") else f"{a}+I*{b}"

    def add(self, x, y):
        return self.part.add(x[0], y[0]), self.part.add(x[1], y[1])

    def neg(self, x):
        return self.part.neg(x[0]), self.part.neg(x[1])

    def conj(self, x):
        return x[0], self.part.neg(x[1])

    def mul(self, x, y):
        p = self.part
        return p.add(p.mul(x[0], y[0]), p.neg(p.mul(x[1], y[1]))), p.add(p.mul(x[0], y[1]), p.mul(x[1], y[0]))

    def div(self, x, y):
        p = self.part
        n = p.add(p.mul(y[0], y[0]), p.mul(y[1], y[1]))
        a, b = self.mul(x, self.conj(y))
        return p.div(a, n), p.div(b, n)

    def norm(self, x):
        p = self.part
        return p.root(p.add(p.mul(x[0], x[0]), p.mul(x[1], x[1]))), p.parse("0")

    def root(self, x):
        p, m = self.part, self.norm(x)[0]
        two = p.parse("2")
        a, b = p.root(p.div(p.add(m, x[0]), two)), p.root(p.div(p.add(m, p.neg(x[0])), two))
        return a, p.neg(b) if x[1] < 0 else b

    def size(self, x):
        return (float(x[0]) ** 2 + float(x[1]) ** 2) ** 0.5

    def parts(self, x):
        return x

    def of(self, re_, im):
        return self.part.of(re_, 0.0), self.part.of(im, 0.0)


# Names of the square roots in algebraic numbers, by the primes under the root.
NAMES = {(0, 0): "1", (1, 0): "S2", (0, 1): "S3", (1, 1): "S6"}
PLACES = {v: k for k, v in NAMES.items()}
PART = re.compile(r"([+-]?)(?:\(?([0-9]+(?:/[0-9]+)?)\)?)?\*?(?:\{(\w+)\})?(\*?I)?")


class Algebraic(Field):
    """CLIFFORD: rational combinations of 1, the roots of 2, 3 and 6, and these times i, as {(2?, 3?, i?): rational}."""

    def parse(self, s):
        out: dict = {}
        s, at = s.replace(" ", ""), 0
        while at < len(s):
            m = PART.match(s, at)
            if not m or m.end() == at:
                raise ValueError(f"no algebraic number: {s}")
            sign, q, name, im = m.groups()
            k = (*PLACES[name or "1"], 1 if im else 0)
            out[k] = out.get(k, 0) + (-1 if sign == "-" else 1) * Fraction(q or 1)
            at = m.end()
        return {k: v for k, v in out.items() if v}

    def text(self, x):
        if not x:
            return "0"
        out = ""
        for k in sorted(x, key=lambda k: (k[2], k[1], k[0])):
            v = x[k]
            out += ("-" if v < 0 else "+" if out else "") + f"({abs(v)})*{{{NAMES[k[:2]]}}}" + ("*I" if k[2] else "")
        return out

    def add(self, x, y):
        out = dict(x)
        for k, v in y.items():
            out[k] = out.get(k, 0) + v
        return {k: v for k, v in out.items() if v}

    def mul(self, x, y):
        out: dict = {}
        for (a, b, i), v in x.items():
            for (c, d, j), w in y.items():
                k = (a ^ c, b ^ d, i ^ j)
                out[k] = out.get(k, 0) + v * w * (2 if a & c else 1) * (3 if b & d else 1) * (-1 if i & j else 1)
        return {k: v for k, v in out.items() if v}

    def neg(self, x):
        return {k: -v for k, v in x.items()}

    def conj(self, x):
        return self.turn(x, 2)

    def turn(self, x, n):
        return {k: -v if k[n] else v for k, v in x.items()}

    def div(self, x, y):
        for n in (2, 0, 1):  # each conjugate removes one of i and the roots from the denominator
            other = self.turn(y, n)
            if other != y:
                x, y = self.mul(x, other), self.mul(y, other)
        q = y[0, 0, 0]
        return {k: v / q for k, v in x.items()}

    def norm(self, x):
        return self.root(self.mul(x, self.conj(x)))

    def root(self, x):
        """Exact where the root is rational times one of the roots; else to 78 digits."""
        if set(x) <= {(0, 0, 0)}:
            v = x.get((0, 0, 0), Fraction(0))
            for name, under in (("1", 1), ("S2", 2), ("S3", 3), ("S6", 6)):
                q = v / under
                n, d = isqrt(abs(q.numerator)), isqrt(q.denominator)
                if q >= 0 and n * n == q.numerator and d * d == q.denominator:
                    return {(*PLACES[name], 0): Fraction(n, d)} if n else {}
        roots = {(0, 0): Decimal(1), (1, 0): BITS.sqrt(Decimal(2)), (0, 1): BITS.sqrt(Decimal(3)), (1, 1): BITS.sqrt(Decimal(6))}
        total = Decimal(0)
        for k, v in x.items():
            total = BITS.add(total, BITS.multiply(roots[k[:2]], BITS.divide(Decimal(v.numerator), Decimal(v.denominator))))
        return {(0, 0, 0): Fraction(BITS.sqrt(total))}

    def parts(self, x):
        """To 78 digits."""
        roots = {(0, 0): Decimal(1), (1, 0): BITS.sqrt(Decimal(2)), (0, 1): BITS.sqrt(Decimal(3)), (1, 1): BITS.sqrt(Decimal(6))}
        out = [Decimal(0), Decimal(0)]
        for k, v in x.items():
            out[k[2]] = BITS.add(out[k[2]], BITS.multiply(roots[k[:2]], BITS.divide(Decimal(v.numerator), Decimal(v.denominator))))
        return tuple(out)

    def of(self, re_, im):
        return {k: v for k, v in (((0, 0, 0), Fraction(re_)), ((0, 0, 1), Fraction(im))) if v}

    def size(self, x):
        at = {(0, 0): 1.0, (1, 0): 2**0.5, (0, 1): 3**0.5, (1, 1): 6**0.5}
        part = lambda i: sum(float(v) * at[k[:2]] for k, v in x.items() if k[2] == i)
        return (part(0) ** 2 + part(1) ** 2) ** 0.5


class Exact(ScalarType):
    """An exact type: canonical strings, computed by a Field in Arrow batches."""

    dtype = "string"

    def __init__(self, name: str, field: Field, is_complex: bool = False):
        self.name, self.field, self.complex = name, field, is_complex
        self._zero, self._one = field.text(field.parse("0")), field.text(field.parse("1"))

    def _map(self, f, *cols: Column) -> Column:
        field = self.field

        def one(a: pd.Series) -> pd.Series:
            return a.map(lambda x: None if x is None else field.text(f(field.parse(x))))

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else field.text(f(field.parse(x), field.parse(y))) for x, y in zip(a, b)], dtype=object)

        return F.pandas_udf(one if len(cols) == 1 else two, "string")(*cols)

    def parse(self, s):
        return self._map(lambda x: x, s)

    def lit(self, x):
        return F.lit(self.field.text(self.field.parse(str(x))))

    def text(self, v):
        return v

    def zero(self):
        return F.lit(self._zero)

    def one(self):
        return F.lit(self._one)

    def times(self, a, b):
        return self._map(self.field.mul, a, b)

    def plus(self, a, b):
        return self._map(self.field.add, a, b)

    def minus(self, a):
        return self._map(self.field.neg, a)

    def conj(self, a):
        return self._map(self.field.conj, a)

    def over(self, a, b):
        return self._map(self.field.div, a, b)

    def root(self, a):
        return self._map(self.field.root, a)

    def norm(self, a):
        return self._map(self.field.norm, a)

    def squared(self, a):
        return self.times(a, self.conj(a))

    def size(self, a):
        field = self.field

        def one(x: pd.Series) -> pd.Series:
            return x.map(lambda v: field.size(field.parse(v)))

        return F.pandas_udf(one, "double")(a)

    def nonzero(self, a):
        return a != self._zero

    def _ask(self, f, kind: str, *cols: Column) -> Column:
        """f of parsed values, as a number or a truth value."""
        field = self.field

        def one(a: pd.Series) -> pd.Series:
            return a.map(lambda x: f(field.parse(x)))

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(field.parse(x), field.parse(y)) for x, y in zip(a, b)])

        return F.pandas_udf(one if len(cols) == 1 else two, kind)(*cols)

    def compare(self, a, b):
        parts = self.field.parts
        return self._ask(lambda x, y: (parts(x) > parts(y)) - (parts(x) < parts(y)), "int", a, b)

    def compare_parts(self, a, b):
        parts = self.field.parts
        return self._ask(lambda x, y: sum((1 if u > v else 2 if u < v else 0) * f for u, v, f in zip(parts(x), parts(y), (1, 4))), "int", a, b)

    def is_real(self, a):
        parts = self.field.parts
        return self._ask(lambda x: not parts(x)[1], "boolean", a) if self.complex else F.lit(True)

    def is_imaginary(self, a):
        parts = self.field.parts
        return self._ask(lambda x: not parts(x)[0], "boolean", a) if self.complex else F.lit(False)

    def of_doubles(self, re_, im):
        field = self.field

        def one(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if pd.isna(u) or pd.isna(v) else field.text(field.of(float(u), float(v))) for u, v in zip(x, y)], dtype=object)

        return F.pandas_udf(one, "string")(re_, im)

    def sum_by(self, df, keys):
        """Sums within each partition first, then of what partitions found; only partial sums of a key ever meet."""
        field, zero = self.field, self._zero
        schema = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys) + "val string"

        def partial(parts):
            held: dict = {}
            for t in parts:
                for k, v in zip(zip(*(t[c].tolist() for c in keys)) if keys else [()] * len(t), t["val"].tolist()):
                    x = field.parse(v)
                    held[k] = field.add(held[k], x) if k in held else x
                if len(held) > 200_000:
                    yield frame(held)
                    held = {}
            if held:
                yield frame(held)

        def frame(held):
            out = pd.DataFrame(list(held), columns=keys, index=range(len(held)))
            out["val"] = [field.text(v) for v in held.values()]
            return out

        some = df.select(*keys, "val").mapInPandas(partial, schema)
        dealt = some.repartition(*keys) if keys else some.repartition(1)  # a row a task at most, without keys
        return dealt.mapInPandas(partial, schema).groupBy(*keys).agg(F.first("val").alias("val")).where(F.col("val") != zero) if keys else dealt.mapInPandas(partial, schema).where(F.col("val") != zero)


INTEGER, REAL, BOOLEAN, COMPLEX, MPINTEGER = ScalarType(), Real(), Boolean(), Complex(), BigInteger()
MPRATIONAL, MPREAL = Exact("MPRATIONAL", Field()), Exact("MPREAL", Float256())
MPRATCOMPLEX, MPCOMPLEX = Exact("MPRATCOMPLEX", Pair(Field()), True), Exact("MPCOMPLEX", Pair(Float256()), True)
CLIFFORD = Exact("CLIFFORD", Algebraic(), True)
TYPES = {t.name: t for t in (INTEGER, REAL, BOOLEAN, COMPLEX, MPINTEGER, MPRATIONAL, MPREAL, MPRATCOMPLEX, MPCOMPLEX, CLIFFORD)}


def constants(stype: ScalarType) -> dict[str, Column]:
    """Named constants of a type; algebraic ones are exact, others rounded."""
    if stype is CLIFFORD:
        return {"SQRT2": stype.lit("{S2}"), "INV_SQRT2": stype.lit("(1/2)*{S2}"), "SQRT3": stype.lit("{S3}"), "INV_SQRT3": stype.lit("(1/3)*{S3}"), "SQRT6": stype.lit("{S6}"), "INV_SQRT6": stype.lit("(1/6)*{S6}")}
    values = {"SQRT2": 2**0.5, "INV_SQRT2": 0.5**0.5, "SQRT3": 3**0.5, "INV_SQRT3": 3**-0.5, "SQRT6": 6**0.5, "INV_SQRT6": 6**-0.5, "CBRT2": 2 ** (1 / 3), "INV_CBRT2": 2 ** (-1 / 3), "CBRT4": 4 ** (1 / 3), "INV_CBRT4": 4 ** (-1 / 3)}
    return {k: stype.lit(v if stype in (REAL, COMPLEX) else repr(v)) for k, v in values.items()}


def guess_type(tokens: list[str]) -> ScalarType:
    """The narrowest type that reads all of these scalars."""
    s = [t.strip() for t in tokens]
    whole = all(re.fullmatch(r"[+-]?[0-9]+", t) for t in s)
    return _narrowest(any("{" in t for t in s), any(re.search(r"[Ii]", t) for t in s), any("/" in t for t in s), whole, whole and all(abs(int(t)) < 1 << 63 for t in s))


def guess_column(df: DataFrame, token: Column) -> ScalarType:
    """The narrowest type that reads all scalars of a column: a few truths over every row, and nothing collected."""
    t = F.trim(token)
    whole = F.coalesce(F.bool_and(t.rlike(r"^[+-]?[0-9]+$")), F.lit(True))
    small = F.coalesce(F.bool_and(t.try_cast("bigint").isNotNull() & (t.try_cast("bigint") != -(1 << 63))), F.lit(True))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return _narrowest(*df.agg(some(F.contains(t, F.lit("{"))), some(t.rlike("[Ii]")), some(F.contains(t, F.lit("/"))), whole, small).first())


def _narrowest(roots: bool, imaginary: bool, quotients: bool, whole: bool, small: bool) -> ScalarType:
    if roots:
        return CLIFFORD
    if imaginary:
        return MPRATCOMPLEX if quotients else COMPLEX
    if quotients:
        return MPRATIONAL
    return (INTEGER if small else MPINTEGER) if whole else REAL

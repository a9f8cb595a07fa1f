"""UPPER and LOWER: one-sided bounds on values in [0, 1], as sums of at most three powers of one half.

A bound that no longer fits is rounded up or down and from then on inexact. Past one, an upper bound is an inexact one,
while a lower bound, or an exact value, is no number. Written 0, 1, NaN, or explist[e1,e2,e3] for the sum of 2^-e; a ^ (upper)
or v (lower) stands before inexact ones. Sums depend on their order within these bounds, which stay true in any order.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from .scalars import TYPES, Exact, Field

TERMS = 3


@dataclass(frozen=True)
class Bound:
    value: Fraction | None  # None: no number
    exact: bool = True


NAN = Bound(None)


class Bounds(Field):
    def __init__(self, upper: bool):
        self.upper = upper

    def fit(self, v: Fraction, exact: bool) -> Bound:
        if v > 1:
            return Bound(Fraction(1), False) if self.upper and not exact else NAN
        if v == 1:
            return Bound(v, exact or not self.upper)
        if not v:
            return Bound(v)
        n, d = v.numerator, v.denominator
        if d & (d - 1):  # no sum of powers of one half: cut far below the last term that counts
            shift = d.bit_length() - n.bit_length() + 8
            n, d, exact = (n << shift) // d, 1 << shift, False
            n += self.upper
        spare, top, left = 0, n, TERMS
        bits = [k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
        if len(bits) > left:
            unit = 1 << bits[left - 1]
            top, spare = n - n % unit, n % unit
        if not spare:
            return Bound(Fraction(top, d), exact)
        v = Fraction(top + unit if self.upper else top, d)
        return Bound(min(v, Fraction(1)), False)

    def parse(self, s: str) -> Bound:
        s = s.strip()
        exact = not s.startswith(("^", "v"))
        s = s.lstrip("^v")
        if s.lower() == "nan":
            return NAN
        if s.startswith("explist["):
            return self.fit(sum((Fraction(1, 1 << int(e)) for e in s[8:-1].split(",") if e.strip() and int(e)), Fraction(0)), exact)
        v = Fraction(s)
        if not 0 <= v <= 1:
            return NAN
        return self.fit(v, exact)

    def text(self, x: Bound) -> str:
        if x.value is None:
            return "NaN"
        mark = "" if x.exact else "^" if self.upper else "v"
        if x.value in (0, 1):
            return mark + str(x.value)
        n, k = x.value.numerator, x.value.denominator.bit_length() - 1
        return f"{mark}explist[{','.join(str(k - b) for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1)}]"

    def add(self, x: Bound, y: Bound) -> Bound:
        if x.value is None or y.value is None:
            return NAN
        if not x.value or not y.value:
            return y if not x.value else x
        ones = [z for z in (x, y) if z.value == 1]
        if any(z.exact for z in ones):
            return NAN
        return Bound(Fraction(1), False) if ones else self.fit(x.value + y.value, x.exact and y.exact)

    def mul(self, x: Bound, y: Bound) -> Bound:
        if x.value is None or y.value is None:
            return NAN
        if not x.value or not y.value:
            return Bound(Fraction(0))
        if x.value == 1 or y.value == 1:
            return Bound(x.value * y.value, x.exact and y.exact)
        return self.fit(x.value * y.value, x.exact and y.exact)

    def parts(self, x: Bound) -> tuple:
        """Exact and inexact bounds compare alike; no number is less than all."""
        return Fraction(-1) if x.value is None else x.value, 0

    def size(self, x: Bound) -> float:
        return float("nan") if x.value is None else float(x.value)

    def _none(self, *_):
        raise NotImplementedError("bounds have no such operation")

    neg = div = root = norm = _none


UPPER, LOWER = Exact("UPPER", Bounds(True)), Exact("LOWER", Bounds(False))
TYPES.update(UPPER=UPPER, LOWER=LOWER)

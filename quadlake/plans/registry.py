"""Matrices that are kept: results by operation and operands, pinned ones, and what is known about them.

Spark recognises equal plans by a canonical hash, so a result is found again however its operands were written down.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from ..matrix import Matrix


class Registry:
    def __init__(self):
        self._memo: dict[tuple, Matrix] = {}
        self._holds: dict[int, int] = {}
        self._locked: set[int] = set()
        self._info: dict[int, dict[str, str]] = {}
        self._kept: dict[int, Matrix] = {}

    @staticmethod
    def key(m: Matrix) -> int:
        return hash((m.df.semanticHash(), m.row_level, m.col_level, m.stype.name))

    def keep(self, m: Matrix) -> Matrix:
        """m, cached when first computed."""
        k = self.key(m)
        if k not in self._kept:
            self._kept[k] = Matrix(m.df.persist(), m.row_level, m.col_level, m.stype, dict(m.info))
        return self._kept[k]

    def op(self, name: str, f: Callable[..., Matrix], *operands: Matrix) -> Matrix:
        """f of the operands, once for each name and operands; a sum is the same in any order."""
        keys = [self.key(m) for m in operands]
        at = (name, *(sorted(keys) if name == "add" else keys))
        if at not in self._memo:
            self._memo[at] = self.keep(f(*operands))
        return self._memo[at]

    def hold(self, m: Matrix) -> None:
        self._holds[self.key(self.keep(m))] = self._holds.get(self.key(m), 0) + 1

    def release(self, m: Matrix) -> None:
        k = self.key(m)
        if self._holds.get(k, 0) < 1:
            raise ValueError("the matrix isn't held")
        self._holds[k] -= 1

    def lock(self, m: Matrix) -> None:
        self._locked.add(self.key(self.keep(m)))

    def clean(self) -> int:
        """Drops everything that is neither held nor locked; gives the number of matrices dropped."""
        gone = [k for k in self._kept if not self._holds.get(k) and k not in self._locked]
        for k in gone:
            self._kept.pop(k).df.unpersist()
            self._info.pop(k, None)
        self._memo = {at: m for at, m in self._memo.items() if self.key(m) in self._kept}
        return len(gone)

    def forget_operations(self) -> None:
        self._memo.clear()

    def remove(self, m: Matrix) -> bool:
        """Drops one matrix; False, and no change, if it is held, locked or unknown."""
        k = self.key(m)
        if k not in self._kept or self._holds.get(k) or k in self._locked:
            return False
        self._kept.pop(k).df.unpersist()
        self._info.pop(k, None)
        self._memo = {at: x for at, x in self._memo.items() if self.key(x) != k}
        return True

    def listing(self) -> list[dict]:
        """What is kept: shape, type, how often held, whether locked, and its information texts."""
        return [{"key": k, "row_level": m.row_level, "col_level": m.col_level, "type": m.stype.name, "held": self._holds.get(k, 0), "locked": k in self._locked, "info": dict(self._info.get(k, {}))} for k, m in self._kept.items()]

    def set_info(self, m: Matrix, name: str, text: str) -> None:
        """Sets a text; one that takes another's place is warned of."""
        if len(text) > 256:
            raise ValueError("at most 256 characters")
        held = self._info.setdefault(self.key(m), {})
        if held.get(name, text) != text:
            warnings.warn(f"{name} was {held[name]!r}", stacklevel=2)
        held[name] = text

    def info_names(self) -> list[str]:
        """All names in use, in order."""
        return sorted({n for texts in self._info.values() for n in texts})

    def get_info(self, m: Matrix, name: str) -> str:
        return self._info.get(self.key(m), {}).get(name, "")

    def counts(self) -> dict[str, int]:
        return {"matrices": len(self._kept), "operations": len(self._memo), "held": sum(v > 0 for v in self._holds.values()), "locked": len(self._locked)}

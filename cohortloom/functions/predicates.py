"""Predicates of frame rules, as columns that are never null."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import fold, fold_value, is_number, quoted, truthy

OPS = ("in", "not_in", "==", "!=", ">", ">=", "<", "<=", "between", "is_true", "is_false")
_COMPARE = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


def as_list(values: Any) -> list:
    if values is None:
        return []
    return list(values) if isinstance(values, (list, tuple, set, frozenset, range)) else [values]


@dataclass(frozen=True)
class Predicate:
    """``column op values``, or ``expr``, a Spark SQL predicate."""

    column: str | None = None
    op: str = "in"
    values: tuple = ()
    expr: str | None = None

    @staticmethod
    def of(column: str | None = None, op: str | None = None, values: Any = None, expr: str | None = None) -> Predicate:
        if expr is not None:
            if not isinstance(expr, str) or not expr:
                raise ValueError("expr must be a single non-empty string")
            return Predicate(None, "expr", (), expr)
        if not isinstance(column, str) or not column:
            raise ValueError("filter and check need a single column, or an expr string")
        op = op or "in"
        if op not in OPS:
            raise ValueError(f"op must be one of {', '.join(OPS)}")
        got = () if op in ("is_true", "is_false") else tuple(as_list(values))
        if op == "between" and len(got) != 2:
            raise ValueError("between needs two values")
        if op in _COMPARE and len(got) != 1:
            raise ValueError(f"{op} needs one value")
        if op in ("in", "not_in") and not got:
            raise ValueError(f"{op} needs values")
        return Predicate(column, op, got)

    def detail(self) -> str:
        if self.expr:
            return self.expr
        return " ".join([self.column, self.op, ", ".join(map(str, self.values))]).strip()

    def test(self, c: Column, kind: str) -> Column:
        """The predicate on a column of type ``kind``. A null row is false, but true for ``not_in`` and ``is_false``."""
        if self.op in ("is_true", "is_false"):
            yes = truthy(c, kind)
            return yes if self.op == "is_true" else ~yes
        if self.op in ("in", "not_in"):
            listed = [v for v in self.values if v is not None]
            if kind == "string":
                inside = fold(c).isin(*[fold_value(v) if isinstance(v, str) else str(v) for v in listed])
            elif is_number(kind) and all(isinstance(v, (int, float)) for v in listed):
                inside = c.isin(*listed)
            else:
                inside = fold(c).isin(*[fold_value(str(v)) for v in listed])
            inside = F.coalesce(inside, F.lit(None in self.values)) if listed else F.coalesce(c.isNull() & F.lit(None in self.values), F.lit(False))
            return inside if self.op == "in" else ~inside
        if self.op == "between":
            return F.coalesce(c.between(*self.values), F.lit(False))
        return F.coalesce(_COMPARE[self.op](c, F.lit(self.values[0])), F.lit(False))

    def on(self, kinds: dict[str, str]) -> Column | None:
        """The predicate on the columns of a table; None where its column is absent."""
        if self.expr is not None:
            return F.coalesce(F.expr(self.expr).cast("boolean"), F.lit(False))
        if self.column not in kinds:
            return None
        return self.test(quoted(self.column), kinds[self.column])

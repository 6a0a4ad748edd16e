"""Checks of accounting identities, and the least change that restores them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import kinds, missing, quoted
from ..plans.identities import Identity, registry


def residual(identity: Identity) -> Column:
    """The identity's sum in double precision; null if any of its values is."""
    out = None
    for v, c in identity.terms:
        term = quoted(v).cast("double") * c
        out = term if out is None else out + term
    return out


def accounting_check(df: DataFrame, section=None, id: str = "EIN2", time: str = "TAX_YEAR", tol: float = 1, violations_only: bool = True,
                     identities: list[Identity] | None = None, sort: bool = True) -> DataFrame:
    """A row for each row of ``df`` and identity that it breaks (or all): keys, ``identity``, ``residual``, ``ok``.

    ``ok`` is within ``tol``, and null with the residual if a value is missing.
    The largest residuals come first, unless ``sort`` is off.
    """
    found = registry(df.columns, section, identities)
    keys = [c for c in (id, time) if c in df.columns]
    if not found:
        return df.select(*[quoted(k) for k in keys], F.lit("").alias("identity"), F.lit(0.0).alias("residual"), F.lit(True).alias("ok")).where(F.lit(False))
    each = F.array(*[F.struct(F.lit(i.name).alias("identity"), residual(i).alias("residual")) for i in found])
    out = df.select(*[quoted(k) for k in keys], F.explode(each).alias("r")).select(
        *[quoted(k) for k in keys], "r.identity", F.when(~F.isnan("r.residual"), F.col("r.residual")).alias("residual")
    )
    out = out.withColumn("ok", F.abs("residual") <= tol)
    if violations_only:
        out = out.where(~F.col("ok"))
    return out.orderBy(F.abs("residual").desc_nulls_last(), *[quoted(k) for k in keys], "identity") if sort else out


def correction(found: list[Identity], fixed=(), weights: dict[str, float] | None = None) -> tuple[list[str], list[str], np.ndarray]:
    """(variables, free variables, D): adding D times the residuals to the free variables restores all identities.

    D is -W^-1 A' (A W^-1 A')^+ over the free columns of the coefficient matrix A: the
    weighted least-squares change. It depends on no row, so it is solved once here.
    """
    variables = list(dict.fromkeys(v for i in found for v in i.variables))
    free = [v for v in variables if v not in set(fixed or ())]
    a = np.zeros((len(found), len(variables)))
    for r, i in enumerate(found):
        for v, c in i.terms:
            a[r, variables.index(v)] = c
    af = a[:, [variables.index(v) for v in free]]
    w = np.array([(weights or {}).get(v, 1.0) for v in free])
    inner = (af / w) @ af.T
    eps = max(inner.shape) * np.finfo(float).eps
    return variables, free, -(af.T / w[:, None]) @ np.linalg.pinv(inner, rcond=eps)


@dataclass(frozen=True)
class Reconciled:
    df: DataFrame
    adjusted: Column
    skipped: Column


def reconcile(df: DataFrame, section=None, fixed=None, weights: dict[str, float] | None = None, rows: Column | None = None,
              identities: list[Identity] | None = None) -> DataFrame:
    """``df`` with the free variables moved as little as possible so that every identity holds.

    ``rows`` is a condition; by default ``imputed_row`` where there is such a column,
    else all. Rows with a missing value in any of the identities' variables, and rows
    without a residual of 1e-9, stay as they are. ``fixed`` variables never move, and
    a variable of weight w moves in proportion to 1/w.
    """
    return plan_reconcile(df, section, fixed, weights, rows, identities).df


def plan_reconcile(df: DataFrame, section=None, fixed=None, weights: dict[str, float] | None = None, rows: Column | None = None,
                   identities: list[Identity] | None = None) -> Reconciled:
    """``reconcile`` with the conditions of the rows it adjusts and skips, on the columns of ``df``."""
    found = registry(df.columns, section, identities)
    if not found:
        return Reconciled(df, F.lit(False), F.lit(False))
    variables, free, d = correction(found, [fixed] if isinstance(fixed, str) else fixed, weights)
    kind = kinds(df)
    if rows is None:
        rows = F.coalesce(quoted("imputed_row").cast("boolean"), F.lit(False)) if "imputed_row" in df.columns else F.lit(True)
    whole = F.lit(True)
    for v in variables:
        whole = whole & ~missing(quoted(v), kind[v])
    broken = F.lit(False)
    for i in found:
        broken = broken | (F.abs(residual(i)) >= 1e-9)
    chosen = rows & whole & F.coalesce(broken, F.lit(False))
    new: dict[str, Column] = {}
    for j, v in enumerate(free):
        change = None
        for i, identity in enumerate(found):
            if abs(d[j, i]) > 1e-15:
                term = residual(identity) * float(d[j, i])
                change = term if change is None else change + term
        if change is not None:
            new[v] = F.when(chosen, quoted(v).cast("double") + change).otherwise(quoted(v).cast("double"))
    out = df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])
    return Reconciled(out, chosen, rows & ~whole)


def reconcile_audit(df: DataFrame, plan: Reconciled) -> dict[str, int]:
    """``rows_adjusted`` and ``rows_skipped``, counted over the rows that went in."""
    r = df.agg(F.sum(plan.adjusted.cast("long")).alias("rows_adjusted"), F.sum(plan.skipped.cast("long")).alias("rows_skipped")).first()
    return {k: r[k] or 0 for k in ("rows_adjusted", "rows_skipped")}

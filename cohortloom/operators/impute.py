"""Rows for the years that an id misses between two that it has."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.values import is_number, kinds, missing, need, present, quoted
from .membership import TYPES, classify, panel_years

METHODS = ("mean", "interpolate", "locf", "nocb")


def fill(method: str, at: Column, before: Column, after: Column, a: Column, b: Column) -> Column:
    """The value for time ``at`` between ``a`` (at ``before``) and ``b`` (at ``after``); the one that is there if the other isn't."""
    a, b = a.cast("double"), b.cast("double")
    if method == "mean":
        both = (a + b) / 2
    elif method == "interpolate":
        both = a + (b - a) * (at - before) / (after - before)
    else:
        both = a if method == "locf" else b
    return F.coalesce(both, a, b)


def impute(df: DataFrame, classification: DataFrame | None = None, types=("persistent",), method: str = "mean", max_gap_size: float | None = None,
           max_gap_count: float | None = None, vars: list[str] | None = None, time: str = "TAX_YEAR", id: str = "EIN2", as_integers: bool = False, years: list | None = None) -> DataFrame:
    """``df`` and, for segmented ids of ``types`` within the gap limits, a row for each panel year missing inside their span.

    ``vars`` (default: all numbers but the time and ``panel_`` columns) are filled
    from the observed rows around the gap; other columns are null. ``imputed_row``
    tells the new rows, and is always there. Filled integers become doubles unless
    ``as_integers`` rounds them, half to even. Where an id has several rows in a year,
    the one with the smallest values brackets the gap: deduplicate first. ``years`` are
    the panel's, if they are known.
    """
    need(df, id, time)
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    types = [types] if isinstance(types, str) else list(types)
    if bad := [t for t in types if t not in TYPES]:
        raise ValueError(f"unknown panel type: {', '.join(bad)}")
    kind = kinds(df)
    if vars is None:
        vars = [c for c in df.columns if is_number(kind[c]) and c not in (id, time) and not re.match("panel_", c)]
    if not vars or any(v not in kind or not is_number(kind[v]) for v in vars):
        raise ValueError("vars must name numeric columns")
    years = panel_years(df, time, id) if years is None else years
    cls = classify(df, time, id, years) if classification is None else classification
    fits = F.col("panel_type").isin(*types) & (F.col("panel_spell") == "segmented")
    if max_gap_size is not None:
        fits &= F.col("panel_gap_size_max") <= max_gap_size
    if max_gap_count is not None:
        fits &= F.col("panel_gap_count") <= max_gap_count
    eligible = cls.where(fits).select(quoted(id).alias("id"))

    axis = F.array(*[F.lit(y) for y in years]).cast(f"array<{kind[time]}>")
    rows = df.where(~missing(quoted(id), kind[id]) & ~missing(quoted(time), kind[time])).select(
        quoted(id).alias("id"), quoted(time).alias("t"), F.struct(*[present(quoted(v), kind[v]).alias(f"v{i}") for i, v in enumerate(vars)]).alias("v")
    )
    rows = rows.groupBy("id", "t").agg(F.min("v").alias("v")).join(eligible, "id", "left_semi").withColumn("p", F.array_position(axis, F.col("t")).cast("int"))
    w = Window.partitionBy("id").orderBy("p")
    gaps = rows.select("id", "t", "v", "p", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("t", "v", "p")]).where(F.col("next_p") - F.col("p") > 1)
    new = gaps.select("*", F.explode(F.sequence(F.col("p") + 1, F.col("next_p") - 1)).alias("q")).withColumn("at", F.element_at(axis, F.col("q")))
    filled = {v: fill(method, F.col("at"), F.col("t"), F.col("next_t"), F.col(f"v.v{i}"), F.col(f"next_v.v{i}")) for i, v in enumerate(vars)}
    whole = {v for v in vars if not kind[v] in ("double", "float") and not kind[v].startswith("decimal")}

    def kind_of(v: str) -> str:
        return ("double" if v in whole and not as_integers else kind[v])

    def new_column(c: str) -> Column:
        if c == id:
            return F.col("id").alias(c)
        if c == time:
            return F.col("at").alias(c)
        if c in filled:
            value = F.bround(filled[c], 0) if c in whole and as_integers else filled[c]
            return value.cast(kind_of(c)).alias(c)
        return F.lit(None).cast(kind[c]).alias(c)

    flag = "imputed_row"
    old = [quoted(c).cast(kind_of(c)).alias(c) if c in filled else quoted(c) for c in df.columns if c != flag]
    was = F.coalesce(quoted(flag).cast("boolean"), F.lit(False)) if flag in df.columns else F.lit(False)
    inserted = new.select(*[new_column(c) for c in df.columns if c != flag], F.lit(True).alias(flag))
    return df.select(*old, was.alias(flag)).unionByName(inserted)


def complete(df: DataFrame, method: str = "interpolate", types=("persistent", "entrant", "exit", "transient"), max_gap_size: float | None = None,
             max_gap_count: float | None = None, vars: list[str] | None = None, time: str = "TAX_YEAR", id: str = "EIN2", as_integers: bool = False,
             classification: DataFrame | None = None, reconcile: bool = False, reconcile_fixed=None, reconcile_section=None, identities=None, years: list | None = None) -> DataFrame:
    """``impute`` for every type, interpolating; ``reconcile`` then moves the new rows onto the accounting identities."""
    out = impute(df, classification, types, method, max_gap_size, max_gap_count, vars, time, id, as_integers, years)
    if reconcile:
        from .accounting import reconcile as adjust

        out = adjust(out, section=reconcile_section, fixed=reconcile_fixed, identities=identities)
    return out

"""Panel membership: who is observed when, and with what gaps.

Positions are those of the years observed anywhere in the panel, so a year in
which nobody filed is no gap.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import kinds, missing, need, quoted

TYPES = ("persistent", "entrant", "exit", "transient", "empty")
SPELLS = ("seamless", "segmented")
LABELS = ("panel_year_first", "panel_year_last", "panel_year_count", "panel_type", "panel_spell", "panel_gap_count", "panel_gap_size_max")


def pairs(df: DataFrame, time: str, id: str) -> DataFrame:
    """Rows with an id and a time, as ``id`` and ``t``; not distinct."""
    need(df, id, time)
    k = kinds(df)
    return df.where(~missing(quoted(id), k[id]) & ~missing(quoted(time), k[time])).select(quoted(id).alias("id"), quoted(time).alias("t"))


def panel_years(df: DataFrame, time: str, id: str) -> list:
    """The distinct times of the panel in order: tens of values, gathered by one aggregation."""
    return [r["t"] for r in pairs(df, time, id).select("t").distinct().orderBy("t").collect()]


def classify(df: DataFrame, time: str = "TAX_YEAR", id: str = "EIN2", years: list | None = None) -> DataFrame:
    """One row per id: ``LABELS``. One shuffle: each id's set of positions, at most one a panel year, is all it needs."""
    years = panel_years(df, time, id) if years is None else years
    kind = kinds(df)[time]
    axis = F.array(*[F.lit(y) for y in years]).cast(f"array<{kind}>")
    seen = pairs(df, time, id).groupBy("id").agg(
        F.min("t").alias("first"), F.max("t").alias("last"),
        F.sort_array(F.collect_set(F.array_position(axis, F.col("t")).cast("int"))).alias("at"),
    )
    return classes_of(seen, len(years), id)


def classes_of(seen: DataFrame, n_years: int, id: str) -> DataFrame:
    """``LABELS`` from ``id``, ``first``, ``last`` and ``at``, the places among a panel's ``n_years`` years in which an id is observed, from 1 and in order."""
    gaps = F.filter(F.transform("at", lambda p, i: F.when(i > 0, p - F.get("at", i - 1) - 1)), lambda g: g > 0)
    lo, hi = F.get("at", F.lit(0)), F.element_at("at", -1)
    return seen.select(
        F.col("id").alias(id),
        F.col("first").alias("panel_year_first"),
        F.col("last").alias("panel_year_last"),
        F.size("at").alias("panel_year_count"),
        F.when((lo == 1) & (hi == n_years), "persistent").when(hi == n_years, "entrant").when(lo == 1, "exit").otherwise("transient").alias("panel_type"),
        F.when(hi - lo + 1 == F.size("at"), "seamless").otherwise("segmented").alias("panel_spell"),
        F.size(gaps).alias("panel_gap_count"),
        F.coalesce(F.array_max(gaps), F.lit(0)).alias("panel_gap_size_max"),
    )


@dataclass(frozen=True)
class Summary:
    """What ``describe`` tells of a panel; each part is computed when asked for."""

    classification: DataFrame
    id: str
    years: list
    observed: DataFrame

    @cached_property
    def n_orgs(self) -> int:
        return self.classification.count()

    @property
    def n_years(self) -> int:
        return len(self.years)

    def by_type(self) -> DataFrame:
        """``panel_type``, a count for each spell, ``total`` and ``pct`` (half-even, one decimal)."""
        counts = self.classification.groupBy("panel_type").agg(
            *[F.sum((F.col("panel_spell") == s).cast("long")).alias(s) for s in SPELLS], F.count("*").alias("total")
        )
        # five rows at most
        all_n = counts.agg(F.sum("total").alias("n"))
        return counts.crossJoin(F.broadcast(all_n)).select("panel_type", *SPELLS, "total", F.bround(100 * F.col("total") / F.col("n"), 1).alias("pct"))

    def by_year(self) -> DataFrame:
        """``year`` and the ids observed in it by type; types without any are left out."""
        typed = self.observed.join(self.classification.select(F.col(self.id).alias("id"), "panel_type"), "id")
        held = [r[0] for r in self.classification.select("panel_type").distinct().collect()]
        return typed.groupBy(F.col("t").alias("year")).agg(*[F.sum((F.col("panel_type") == k).cast("long")).alias(k) for k in TYPES if k in held])

    def __repr__(self) -> str:
        return f"panel of {self.n_orgs} organizations over {self.n_years} years ({', '.join(map(str, self.years))})"


def describe(df: DataFrame, time: str = "TAX_YEAR", id: str = "EIN2") -> Summary:
    years = panel_years(df, time, id)
    return Summary(classify(df, time, id, years), id, years, pairs(df, time, id).distinct())


def label(df: DataFrame, time: str = "TAX_YEAR", id: str = "EIN2", classification: DataFrame | None = None) -> DataFrame:
    """``df`` with the classification's columns joined by id; label columns that it has are replaced."""
    cls = classify(df, time, id) if classification is None else classification
    new = [c for c in cls.columns if c != id]
    left = df.drop(*new)
    a = left.toDF(*[f"a{i}" for i in range(len(left.columns))])
    b = cls.select(quoted(id), *new).toDF("id", *[f"b{i}" for i in range(len(new))])
    joined = a.join(b, F.col(place(left, id, "a")) == F.col("id"), "left").drop("id")
    return joined.toDF(*left.columns, *new)


def place(df: DataFrame, name: str, prefix: str = "c") -> str:
    """What a column is called when all are named by their place: whatever else a table holds, nothing clashes with it."""
    folded = [c.lower() for c in df.columns]
    return f"{prefix}{df.columns.index(name) if name in df.columns else folded.index(name.lower())}"


def _known(values, valid: tuple, name: str) -> list | None:
    if values is None:
        return None
    got = [values] if isinstance(values, str) else list(values)
    bad = [v for v in got if v not in valid]
    if not got or bad:
        raise ValueError(f"unknown {name}: {', '.join(map(str, bad)) or 'none given'}")
    return got


def selected(panel_type=None, spell=None, min_obs: int | None = None) -> Column:
    """The condition of ``filter_members`` on a classification."""
    cond = F.lit(True)
    if (types := _known(panel_type, TYPES, "panel_type")) is not None:
        cond &= F.col("panel_type").isin(*types)
    if (spells := _known(spell, SPELLS, "spell")) is not None:
        cond &= F.col("panel_spell").isin(*spells)
    if min_obs is not None:
        cond &= F.col("panel_year_count") >= min_obs
    return cond


def filter_members(df: DataFrame, panel_type=None, spell=None, min_obs: int | None = None, classification: DataFrame | None = None,
                   time: str = "TAX_YEAR", id: str = "EIN2") -> DataFrame:
    """All rows of the ids whose class fits every condition given."""
    need(df, id)
    cond = selected(panel_type, spell, min_obs)
    cls = classify(df, time, id) if classification is None else classification
    return semi(df, cls.where(cond).select(quoted(id).alias("kept_id")), id)


def semi(df: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """Rows of ``df`` whose id is in the one column of ``ids``. Whether that is broadcast, its size decides."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.join(ids.toDF("k"), F.col(place(df, id)) == F.col("k"), "left_semi").toDF(*df.columns)

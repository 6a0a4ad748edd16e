"""Balanced panels: ids observed in every year of a window."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import kinds, quoted
from .membership import pairs, panel_years, semi


@dataclass(frozen=True)
class Balanced:
    """The rows kept and their years. How many ids were kept and dropped is counted when asked for."""

    df: DataFrame
    years: list
    kept: DataFrame
    observed: DataFrame

    @cached_property
    def orgs_kept(self) -> int:
        return self.kept.count()

    @cached_property
    def orgs_dropped(self) -> int:
        return self.observed.count() - self.orgs_kept

    @property
    def n_years(self) -> int:
        return len(self.years)


def _window_counts(positions: DataFrame, k: int) -> dict[tuple[int, int], int]:
    """How many ids cover each window of positions i..j.

    Each id's positions fall into runs; ids are counted per run (at most k*k kinds,
    summed before the shuffle), and a run covers all windows within it.
    """
    at = F.col("at")
    starts = F.filter(at, lambda p: ~F.array_contains(at, p - 1))
    ends = F.filter(at, lambda p: ~F.array_contains(at, p + 1))
    runs = positions.select(F.explode(F.arrays_zip(starts.alias("i"), ends.alias("j"))).alias("run"))
    counts = {(r["i"], r["j"]): r["n"] for r in runs.groupBy("run.i", "run.j").agg(F.count("*").alias("n")).collect()}
    return {(i, j): sum(n for (a, b), n in counts.items() if a <= i and b >= j) for i in range(k) for j in range(i, k)}


def balance(df: DataFrame, years=None, strategy: str = "window", min_years: int = 2, id: str = "EIN2", time: str = "TAX_YEAR", observed: list | None = None) -> Balanced:
    """Keep the ids observed in every target year, and those years alone.

    ``window`` targets the requested years that were observed, or all. ``max_rectangle``
    takes the run of them that makes ids times years largest; of equals the longer,
    then the earlier. ``observed`` are the panel's years, if they are known.
    """
    if strategy not in ("window", "max_rectangle"):
        raise ValueError("strategy must be window or max_rectangle")
    observed = panel_years(df, time, id) if observed is None else observed
    if not observed:
        raise ValueError("no observations with both an id and a time")
    universe = observed if years is None else [y for y in observed if y in set(years)]
    if not universe:
        raise ValueError("none of the requested years were observed")
    kind = kinds(df)[time]
    axis = F.array(*[F.lit(y) for y in universe]).cast(f"array<{kind}>")
    held = pairs(df, time, id).groupBy("id").agg(F.sort_array(F.collect_set(F.array_position(axis, F.col("t")).cast("int") - 1)).alias("at"))
    held = held.withColumn("at", F.filter("at", lambda p: p >= 0))
    if strategy == "window":
        if len(universe) < min_years:
            warnings.warn("the balanced window spans fewer than min_years years", stacklevel=2)
        best = (0, len(universe) - 1)
    else:
        counts = _window_counts(held, len(universe))
        wide = [w for w in counts if w[1] - w[0] + 1 >= min_years]
        if not wide:
            raise ValueError(f"no window of at least {min_years} years")
        best = max(wide, key=lambda w: (counts[w] * (w[1] - w[0] + 1), w[1] - w[0], -w[0]))
    i, j = best
    target = universe[i : j + 1]
    covering = held.where(F.size(F.filter("at", lambda p: p.between(i, j))) == j - i + 1).select(F.col("id").alias("kept_id"))
    out = semi(df.where(quoted(time).isin(*target)), covering, id)
    return Balanced(out, target, covering, held)

"""Moving averages within an id, by rows or by calendar years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.values import is_number, kinds, missing, need, present, quoted

WEIGHTS = ("equal", "half", "decay")
ALIGN = ("center", "left", "right")


def weight(weights: str, distance: int, others: int) -> float:
    """``half``: a half for the focal value, the other half shared by the ``others``."""
    if weights == "equal":
        return 1.0
    if weights == "decay":
        return 0.5**distance
    return (0.5 if others else 1.0) if distance == 0 else 0.5 / others


def _mean(terms: list[tuple[Column, Column]]) -> Column:
    """Weighted mean over the values that are there; (value, weight) pairs, null weights for places outside."""
    num = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in terms), F.lit(0.0))
    den = sum((F.when(v.isNotNull(), F.coalesce(w, F.lit(0.0))).otherwise(0.0) for v, w in terms), F.lit(0.0))
    return F.when(den > 0, num / den)


def smooth(df: DataFrame, vars: list[str] | str, window: int = 3, weights: str = "equal", align: str = "center", time: str = "TAX_YEAR", id: str = "EIN2") -> DataFrame:
    """``vars`` replaced by their moving averages; missing values leave the average, and are filled by it.

    ``center`` averages the ``window`` rows around each (odd; shifted inwards at an
    id's ends, all its rows if there are fewer); it bridges gaps. ``right`` averages
    the calendar years up to the row's own, ``left`` from it on; years that are not
    there are no part of it. Rows without an id, and rows without a time on calendar
    windows, keep their values. A window of 1 changes nothing.
    """
    vars = [vars] if isinstance(vars, str) else list(vars)
    need(df, id, time, *vars)
    kind = kinds(df)
    if weights not in WEIGHTS or align not in ALIGN:
        raise ValueError(f"weights must be one of {WEIGHTS} and align one of {ALIGN}")
    if not vars or any(not is_number(kind[v]) for v in vars):
        raise ValueError("vars must name numeric columns")
    if isinstance(window, bool) or int(window) != window or window < 1 or (align == "center" and window % 2 == 0):
        raise ValueError("window must be an integer of at least 1, odd for a centred one")
    if window == 1:
        return df
    if align == "center":
        return _center(df, vars, int(window), weights, time, id)
    return _calendar(df, vars, int(window), weights, align, time, id)


#: Parts that rows without an id are dealt into: they keep their values, so that it doesn't matter which stand together.
PARTS = 1024


def _dealt(df: DataFrame, vars: list[str], time: str, id: str) -> list[Column]:
    """The id, and for rows without one a number: no window holds all of these."""
    part = F.pmod(F.xxhash64(quoted(time), *[quoted(v) for v in vars]), F.lit(PARTS))
    return [quoted(id), F.when(missing(quoted(id), kinds(df)[id]), part)]


def _replaced(df: DataFrame, new: dict[str, Column], rows: DataFrame) -> DataFrame:
    return rows.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def _center(df: DataFrame, vars: list[str], window: int, weights: str, time: str, id: str) -> DataFrame:
    """Window functions only: each row looks at most ``window`` - 1 rows either way.

    A row whose window is shifted by s (at an id's ends) takes the rows at offsets
    -half+s .. half+s; both bounds clip where the id has fewer rows than the window.
    """
    kind = kinds(df)
    half = window // 2
    key = _dealt(df, vars, time, id)
    by = Window.partitionBy(*key).orderBy(quoted(time).asc_nulls_last(), *[quoted(v) for v in vars])
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    rows = df.select("*", F.row_number().over(by).alias("__at"), n.alias("__n"))
    at, size = F.col("__at"), F.least(F.lit(window).cast("long"), F.col("__n"))
    reach = F.floor(size / 2)
    begin = F.greatest(F.lit(1).cast("long"), F.least(at - reach, F.col("__n") - size + 1))
    new: dict[str, Column] = {}
    for v in vars:
        value = present(quoted(v), kind[v]).cast("double")
        terms = []
        for k in range(-(window - 1), window):
            other = value if k == 0 else F.lag(value, -k).over(by)
            inside = (at + k >= begin) & (at + k < begin + size)
            if weights == "half":
                w = F.when(size == 1, F.lit(1.0)).otherwise(F.lit(0.5) if k == 0 else F.lit(0.5) / (size - 1))
            else:
                w = F.lit(weight(weights, abs(k), window - 1))
            terms.append((other, F.when(inside, w)))
        new[v] = F.when(missing(quoted(id), kind[id]), quoted(v).cast("double")).otherwise(_mean(terms))
    return _replaced(df, new, rows)


def _calendar(df: DataFrame, vars: list[str], window: int, weights: str, align: str, time: str, id: str) -> DataFrame:
    """One range frame per calendar lag, all over the same partitioning and order: one shuffle, one sort."""
    kind = kinds(df)
    if not is_number(kind[time]):
        bad = df.where(quoted(time).isNotNull() & quoted(time).try_cast("double").isNull()).limit(1).count()
        if bad:
            raise ValueError("time must be calendar years on left and right windows")
    year = quoted(time).try_cast("double")
    rows = df.withColumn("__year", F.when(~F.isnan(year), year))
    order = F.col("__year") if align == "right" else -F.col("__year")
    rows = rows.withColumn("__order", order.cast("double"))
    by = Window.partitionBy(*_dealt(df, vars, time, id)).orderBy("__order")
    new: dict[str, Column] = {}
    for v in vars:
        value = present(quoted(v), kind[v]).cast("double")
        if weights == "equal":
            mean = F.avg(value).over(by.rangeBetween(-(window - 1), 0))
        else:
            nums, dens = [], []
            for k in range(window):
                w = weight(weights, k, window - 1)
                frame = by.rangeBetween(-k, -k)
                nums.append(F.coalesce(F.sum(value).over(frame), F.lit(0.0)) * w)
                dens.append(F.count(value).over(frame) * w)
            num, den = sum(nums[1:], nums[0]), sum(dens[1:], dens[0])
            mean = F.when(den > 0, num / den)
        new[v] = F.when(missing(quoted(id), kind[id]) | F.col("__year").isNull(), quoted(v).cast("double")).otherwise(mean)
    return _replaced(df, new, rows)

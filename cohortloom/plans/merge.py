"""Outer merge of the tables of a year: many tables with one row a filing in one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import kinds, quoted
from .dictionary import FILING_KEYS


def shared_keys(left: list[str], right: list[str], right_name: str, keys=FILING_KEYS) -> list[str]:
    by = [k for k in keys if k in left and k in right]
    if not by:
        raise ValueError(f"no shared join keys for {right_name}")
    return by


def right_names(left: list[str], right: list[str], right_name: str, by: list[str], collision: str = "error") -> dict[str, str]:
    """What the columns of the right table, but for the keys, are called in the merged one."""
    if collision not in ("error", "prefix"):
        raise ValueError("collision must be error or prefix")
    same = [c for c in right if c in left and c not in by]
    if same and collision == "error":
        raise ValueError(f"fields of {right_name} are there already: {', '.join(same)}")
    return {c: f"{right_name}__{c}" if c in same else c for c in right if c not in by}


def join_tables(left: DataFrame, right: DataFrame, right_name: str, keys=FILING_KEYS, collision: str = "error") -> DataFrame:
    """Full outer join on the filing keys that both have; null keys match each other.

    Other columns of the same name are an error, or get the right table's name as a prefix.
    """
    by = shared_keys(left.columns, right.columns, right_name, keys)
    named = right_names(left.columns, right.columns, right_name, by, collision)
    lk, rk = kinds(left), kinds(right)
    # columns by position: whatever a table calls its own, nothing clashes
    a = left.toDF(*[f"a{i}" for i in range(len(left.columns))])
    b = right.toDF(*[f"b{i}" for i in range(len(right.columns))])
    on, whole = None, {}
    for k in by:
        x, y = F.col(f"a{left.columns.index(k)}"), F.col(f"b{right.columns.index(k)}")
        if lk[k] != rk[k]:
            x, y = x.cast("string"), y.cast("string")
        # in an equi-join null-safe equality is still a hash or merge join on the keys
        on = x.eqNullSafe(y) if on is None else on & x.eqNullSafe(y)
        whole[k] = F.coalesce(x, y).alias(k)
    own = [F.col(f"a{i}").alias(c) for i, c in enumerate(left.columns) if c not in by]
    other = [F.col(f"b{i}").alias(named[c]) for i, c in enumerate(right.columns) if c not in by]
    return a.join(b, on, "full").select(*whole.values(), *own, *other)


def merge_unique(parts: list[tuple[str, DataFrame]], keys=FILING_KEYS, collision: str = "error") -> DataFrame:
    """Outer merge of named tables that each have one row a key: the same rows and columns as ``join_tables`` one after another.

    All rows go into one union of (keys, one struct a table), which is shuffled once by the keys; then a filing's structs
    stand side by side. Null keys are equal to each other. Each table is shuffled once whatever their
    number, where joins would shuffle the ever wider left side again and again. A key that a table repeats
    would lose rows here, so it must have been verified. Tables that don't have the
    same keys are joined one after another instead.
    """
    by = [k for k in keys if k in parts[0][1].columns]
    if len(parts) < 2 or any([k for k in keys if k in df.columns] != by for _, df in parts) or not by:
        return reduce(lambda left, part: join_tables(left, part[1], part[0], keys, collision), parts[1:], parts[0][1])
    names: list[dict[str, str]] = []
    sofar: list[str] = []
    for n, df in parts:
        named = right_names(sofar, df.columns, n, by, collision) if sofar else {c: c for c in df.columns if c not in by}
        names.append(named)
        sofar += [*(by if not sofar else []), *named.values()]
    first = kinds(parts[0][1])
    text = {k for k in by if any(kinds(df)[k] != first[k] for _, df in parts)}
    shapes = [df.select(F.struct(*[quoted(c).alias(f"v{j}") for j, c in enumerate(named)]).alias("s")).schema["s"].dataType if named else None for (_, df), named in zip(parts, names)]
    tagged = []
    for i, (_, df) in enumerate(parts):
        at = [quoted(k).cast("string") if k in text else quoted(k) for k in by]
        own = F.struct(*[quoted(c).alias(f"v{j}") for j, c in enumerate(names[i])]) if names[i] else None
        structs = [(own if t == i else F.lit(None).cast(shape)).alias(f"t{t}") for t, shape in enumerate(shapes) if shape is not None]
        tagged.append(df.select(*[k.alias(f"k{n}") for n, k in enumerate(at)], *structs))
    by_place = [f"k{n}" for n in range(len(by))]
    # dealt out before the aggregation: with one row a key, nothing is gained by aggregating before
    rows = reduce(DataFrame.unionAll, tagged).repartition(*by_place)
    taken = [F.first(f"t{t}", ignorenulls=True).alias(f"t{t}") for t, shape in enumerate(shapes) if shape is not None]
    merged = rows.groupBy(*by_place).agg(*taken) if taken else rows.select(*by_place).distinct()
    wide = [F.col(f"t{t}.v{j}").alias(new) for t, named in enumerate(names) for j, new in enumerate(named.values())]
    return merged.select(*[F.col(p).alias(k) for p, k in zip(by_place, by)], *wide)

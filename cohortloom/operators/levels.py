"""Levels of a text column: the values it can have, in order, whether or not a row has them.

They are kept in the column's metadata, which filters, joins and selections carry on.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import quoted

KEY = "levels"
#: More values than this make no levels.
MOST = 10_000


def levels_of(df: DataFrame, column: str) -> list[str] | None:
    """The column's levels in order; None if it has none."""
    return df.schema[column].metadata.get(KEY) if column in df.columns else None


def leveled(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if KEY in f.metadata]


def set_levels(df: DataFrame, levels: dict[str, list[str] | None]) -> DataFrame:
    """``df`` with these levels; None takes a column's away. Values that are no level become null."""
    def one(c: str) -> Column:
        meta = {k: v for k, v in df.schema[c].metadata.items() if k != KEY}
        if c not in levels:
            return quoted(c)
        if levels[c] is None:
            return quoted(c).alias(c, metadata=meta)
        text = quoted(c).cast("string")
        known = list(dict.fromkeys(str(v) for v in levels[c]))
        kept = F.when(F.array_contains(F.from_json(F.lit(json.dumps(known)), "array<string>"), text), text)
        return kept.alias(c, metadata={**meta, KEY: known})

    return df.select(*[one(c) for c in df.columns])


def present(df: DataFrame, columns: list[str], most: int = MOST) -> dict[str, list[str]]:
    """The values that each column has, sorted; one job for all of them, which gathers ``most`` values a column at the most."""
    if not columns:
        return {}
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), quoted(c).cast("string").alias("v")) for c in columns])).alias("x")
    found = df.select(entries).select("x.*").where(F.col("v").isNotNull()).distinct().limit(most * len(columns) + 1).collect()
    out = {c: sorted(r["v"] for r in found if r["c"] == c) for c in columns}
    if bad := [c for c, v in out.items() if len(v) > most] or ([columns[0]] if len(found) > most * len(columns) else []):
        raise ValueError(f"more than {most} values in {', '.join(bad)}")
    return out


def factor(df: DataFrame, columns: list[str]) -> DataFrame:
    """The values that columns have now, sorted, become their levels; of leveled columns the levels in use, in their order."""
    columns = [c for c in columns if c in df.columns]
    found = present(df, columns)
    return _relabel(df, {c: [v for v in (levels_of(df, c) or found[c]) if v in set(found[c])] for c in columns})


def drop_levels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Leveled columns, all or of those named, without the levels that no row has. Other columns stay as they are."""
    return factor(df, [c for c in (leveled(df) if columns is None else columns) if levels_of(df, c) is not None])


def _relabel(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """New levels that hold all values there are: nothing is compared with them."""
    return df.select(*[quoted(c).cast("string").alias(c, metadata={**df.schema[c].metadata, KEY: levels[c]}) if c in levels else quoted(c) for c in df.columns])


def each_level(df: DataFrame, column: str, table: DataFrame, fill: bool = True) -> DataFrame:
    """``table`` (one row a value of ``column``) with a row for each level that it lacks: counts are zero, or null without ``fill``."""
    levels = levels_of(df, column)
    if levels is None:
        return table
    rest = [c for c in table.columns if c != column]
    all_levels = df.sparkSession.createDataFrame([(v,) for v in levels], "level string")
    values = table.toDF("have", *[f"c{i}" for i in range(len(rest))])
    joined = all_levels.join(values, F.col("level") == F.col("have"), "left")
    return joined.select(F.col("level").alias(column), *[(F.coalesce(f"c{i}", F.lit(0)) if fill else F.col(f"c{i}")).alias(c) for i, c in enumerate(rest)])

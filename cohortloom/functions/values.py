"""Text, blanks and missing values.

Missing means null or NaN throughout; text is compared trimmed and in upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What filings write in checkboxes.
TRUE_WORDS = ("X", "TRUE", "T", "1", "Y", "YES")
FALSE_WORDS = ("FALSE", "F", "0", "N", "NO")
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def is_number(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def quoted(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def trim(c: Column) -> Column:
    """Without spaces, tabs and line ends at both ends (``F.trim`` strips spaces alone)."""
    return F.btrim(c.cast("string"), F.lit(" \t\r\n"))


def fold(c: Column) -> Column:
    return F.upper(trim(c))


def fold_value(v):
    return v.strip(" \t\r\n").upper() if isinstance(v, str) else v


def missing(c: Column, kind: str) -> Column:
    """Null, or NaN in a floating column."""
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


def present(c: Column, kind: str) -> Column:
    """The value, with NaN as null: Spark would take NaN for a number above all others."""
    return F.when(~F.isnan(c), c) if kind in ("double", "float") else c


def blank(c: Column, kind: str) -> Column:
    return missing(c, kind) | (trim(c) == "") if kind == "string" else missing(c, kind)


def truthy(c: Column, kind: str) -> Column:
    """True for the words of ``TRUE_WORDS`` in any case; false for anything else, null too."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if is_number(kind):
        return F.coalesce(c == 1, F.lit(False))
    return F.coalesce(fold(c).isin(*TRUE_WORDS), F.lit(False))


def stamp(c: Column) -> Column:
    """A timestamp from ``Y-m-d H:M:S``, ``Y-m-dTH:M:S`` or ``Y-m-d``; what follows, zones too, is ignored."""
    text = F.regexp_replace(trim(c), " (UTC|GMT)$", "")
    return F.coalesce(
        F.try_to_timestamp(F.regexp_replace(F.substring(text, 1, 19), "^(.{10})T", "$1 "), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")),
    )


def kinds(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def need(df: DataFrame, *names: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"column not found: {', '.join(absent)}")

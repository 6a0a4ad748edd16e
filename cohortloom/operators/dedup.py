"""One filing per entity and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.values import kinds, need, quoted, stamp, truthy


def deduplicate(df: DataFrame, id: str = "EIN2", year: str = "TAX_YEAR", group: str | None = "RETURN_GROUP_X", partial: str | None = "RETURN_PARTIAL_X",
                amended: str | None = "RETURN_AMENDED_X", timestamp: str | None = "RETURN_TIME_STAMP", tie: list[str] | None = None) -> DataFrame:
    """The best row of each id and year: not a group return, not partial, amended, then the newest.

    A preference whose column is absent is skipped. Rows still equal are told apart
    by ``tie`` columns, by default all others in their order, so that the result is
    the same however the rows lie. Null ids and years are keys like others.
    """
    need(df, id, year)
    kind = kinds(df)
    order = []
    for column, best in ((group, False), (partial, False), (amended, True)):
        if column and column in kind:
            flag = truthy(quoted(column), kind[column])
            order.append(flag.desc() if best else flag.asc())
    if timestamp and timestamp in kind:
        when = stamp(quoted(timestamp)) if kind[timestamp] == "string" else quoted(timestamp)
        order.append(when.desc_nulls_last())
    sortable = [c for c in df.columns if not kind[c].startswith("map")]
    order += [quoted(c).asc_nulls_last() for c in (tie if tie is not None else sortable)]
    w = Window.partitionBy(quoted(id), quoted(year)).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")

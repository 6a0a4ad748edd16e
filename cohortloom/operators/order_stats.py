"""Exact medians of groups of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import quoted
from ..sources.shared import shared_folder

#: Rows of a group up to which Spark's own median, one buffer a group, is used.
BUFFERED = 100_000


def large_groups(df: DataFrame, by: str, value: str, buffered: int | None = None) -> DataFrame | None:
    """``by`` and ``n`` of the groups with more than ``buffered`` values, counted now; None if there is none."""
    rows = df.where(quoted(by).isNotNull()).groupBy(quoted(by).alias("by")).agg(F.count(quoted(value)).alias("n"))
    held = _stored(rows.where(F.col("n") > (BUFFERED if buffered is None else buffered)))
    return None if held.isEmpty() else held


def group_medians(df: DataFrame, by: str, value: str, buffered: int | None = None, large: DataFrame | None = None) -> DataFrame:
    """``by`` and ``stat``, the exact median of ``value``, for each group of ``df``; null groups and null values don't count.

    Groups of more than ``buffered`` rows (``large``, if they are known) are selected from by rank, all at once:
    equal values of a group fold into one row; these rows are ranged over all partitions by (group, value);
    each partition's count tells which of them holds the middle, and only there are ranks added up.
    No task holds more of a group than its own part of the range. The other groups go into Spark's median.
    """
    rows = df.where(quoted(by).isNotNull()).select(quoted(by).alias("by"), quoted(value).alias("v"))
    held = large_groups(df, by, value, buffered) if large is None else large
    if held is None:
        return rows.groupBy("by").agg(F.median("v").cast("double").alias("stat"))
    # the names of large groups are few beside their rows
    small = rows.join(held.select("by"), "by", "left_anti").groupBy("by").agg(F.median("v").cast("double").alias("stat"))
    return small.unionAll(_selected(rows.join(held.select("by"), "by", "left_semi").where(F.col("v").isNotNull()), held))


def _stored(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession, 'medians')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _selected(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Medians of the groups in ``sizes`` (``by``, ``n``), by rank."""
    folded = rows.groupBy("by", "v").agg(F.count(F.lit(1)).alias("c"))
    lined = _stored(folded.repartitionByRange("by", "v").withColumn("part", F.spark_partition_id()))
    # as many rows as there are groups and partitions together
    parts = lined.groupBy("by", "part").agg(F.sum("c").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("by").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).join(sizes, "by")
    wanted = [((F.col("n") + 1) / 2).cast("long"), (F.col("n") / 2).cast("long") + 1]
    asked = parts.select("by", "part", "before", "held", F.explode(F.array_distinct(F.array(*wanted))).alias("rank"))
    asked = asked.where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("held")))
    where = asked.groupBy("by", "part", "before").agg(F.collect_list("rank").alias("ranks"))  # one or two
    here = lined.join(where, ["by", "part"])
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("by", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = here.withColumn("upto", upto)
    mine: Column = F.filter("ranks", lambda r: (r > F.col("upto") - F.col("c")) & (r <= F.col("upto")))
    hit = ranked.where(F.size(mine) > 0)
    # the middle value, or the mean of both middle values
    return hit.groupBy("by").agg(((F.min("v") + F.max("v")) / 2).cast("double").alias("stat"))

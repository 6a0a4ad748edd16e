"""Distinct rows of wide tables by row hashes: whole rows move only where a hash repeats."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import bit_table
from ..functions.values import quoted
from .shared import shared_folder

#: Rows of fewer columns are about as small as their hashes and are made distinct as they are.
WIDE = 8
#: Where more than one row in so many is a repeat, all rows are made distinct as they are.
OFTEN = 4


@dataclass(frozen=True)
class RowProfile:
    """How many rows a table has, how many of them are distinct, and the hashes of those that aren't single."""

    rows: int
    distinct: int
    repeated: DataFrame | None

    @property
    def duplicates(self) -> int:
        return self.rows - self.distinct


def row_hash(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes ``h1``, ``h2`` of a whole row. Spark's hash skips nulls, so the second also takes which columns are null."""
    own = [quoted(c) for c in df.columns]
    return [F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(1), *own, *[c.isNull() for c in own]).alias("h2")]


def _hash_counts(frames: list[DataFrame]) -> DataFrame:
    hashes = reduce(DataFrame.unionAll, [f.select(F.lit(i).alias("i"), *row_hash(f)) for i, f in enumerate(frames)])
    return hashes.groupBy("i", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))


def count_rows(frames: list[DataFrame]) -> list[tuple[int, int]]:
    """Rows and distinct rows of each frame, from one pass over all of them."""
    if not frames:
        return []
    found = {r["i"]: (r["n"], r["d"]) for r in _hash_counts(frames).groupBy("i").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()}
    return [found.get(i, (0, 0)) for i in range(len(frames))]


def profile_rows(frames: list[DataFrame]) -> list[RowProfile]:
    """A profile of each frame, from one pass over all of them: what is shuffled are 16 bytes a row, partially aggregated.

    The hashes that repeat are stored in the shared folder. Distinct rows are told by 128 bits here;
    ``distinct_rows`` compares them whole.
    """
    if not frames:
        return []
    spark = frames[0].sparkSession
    path = f"{shared_folder(spark, 'repeats')}/rows"
    # single rows of a frame fold into one row without a hash, before anything is shuffled again
    often = [F.when(F.col("n") > 1, F.col(h)).alias(h) for h in ("h1", "h2")]
    _hash_counts(frames).groupBy("i", *often).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).write.partitionBy("i").parquet(path)
    stored = spark.read.schema("h1 long, h2 long, n long, d long, i int").parquet(path)
    found = {r["i"]: (r["n"], r["d"]) for r in stored.groupBy("i").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()}
    out = []
    for i in range(len(frames)):
        rows, distinct = found.get(i, (0, 0))
        repeated = None if rows == distinct else spark.read.schema("h1 long, h2 long").parquet(f"{path}/i={i}").where("h1 IS NOT NULL")
        out.append(RowProfile(rows, distinct, repeated))
    return out


def distinct_rows(df: DataFrame, profile: RowProfile | None = None) -> DataFrame:
    """``df`` without repeated rows, compared whole.

    Rows whose hash is single pass straight from the scan, so that later projections reach it; the others
    are grouped. The repeated hashes are joined as Spark sees fit by their stored size;
    where they are too many to be broadcast, a table of fixed size first keeps rows out of the shuffle that can't be among them.
    """
    if len(df.columns) < WIDE:
        return df.dropDuplicates()
    p = profile or profile_rows([df])[0]
    if p.repeated is None:
        return df
    if p.duplicates * OFTEN > p.rows:
        return df.dropDuplicates()
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    own = flat.select("*", *row_hash(flat))
    met = own.join(p.repeated, ["h1", "h2"], "left_semi").select(*flat.columns).dropDuplicates()
    if _small(p):
        alone = own.join(p.repeated, ["h1", "h2"], "left_anti").select(*flat.columns)
    else:
        may = own.withColumn("may", bit_table(p.repeated.select("h1"))("h1"))
        asked = may.where("may")
        met = asked.join(p.repeated, ["h1", "h2"], "left_semi").select(*flat.columns).dropDuplicates()
        alone = may.where("NOT may").select(*flat.columns).unionAll(asked.join(p.repeated, ["h1", "h2"], "left_anti").select(*flat.columns))
    return alone.unionAll(met).toDF(*names)


def _small(p: RowProfile) -> bool:
    """Whether Spark may broadcast the repeated hashes: 16 bytes each, at most as many as there are repeats."""
    limit = int(p.repeated.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return p.duplicates * 16 <= limit

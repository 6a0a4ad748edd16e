"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored

#: A path of n nodes takes about log n rounds; this many cover any graph.
MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node it reaches, for every node in ``edges`` (columns ``a``, ``b``).

    Large-star and small-star rounds (Kiveris et al., Connected Components in
    MapReduce and Beyond): each joins nodes to the least of their neighbours, until
    no edge changes. Every round is aggregations and joins on the node, and is
    written to the shared folder, where it takes the place of the one before. Loops and repeated edges do no harm; no edges, no rows.
    Ids may be of any ordered type; the driver sees only a count and a sum of hashes.
    """
    now, path = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge of large runs from a greater node u to a smaller one v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        before = path
        now, path = stored(small.where(F.col("u") != F.col("v")).distinct())
        remove(now.sparkSession, before)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]

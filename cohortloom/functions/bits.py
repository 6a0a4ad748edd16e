"""A Bloom filter of a fixed size, made by Spark and asked in the tasks of a scan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB, whatever goes in; a table that is too full lets rows through that a join then drops.
BITS = 26


def bit_table(hashes: DataFrame, bits: int = BITS):
    """A UDF on 64-bit hashes: true for each that is in ``hashes`` (one column), seldom for others while there are far fewer than ``2 ** bits``.

    Two places a hash. The words of the table are put together in the tasks; the
    driver gathers ``2 ** bits`` bits and sends them out, never the hashes.
    """
    spark = hashes.sparkSession
    h = F.col(hashes.columns[0])
    places = F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND((1 << bits) - 1))).alias("p")
    found = (
        hashes.where(h.isNotNull()).select(places).select(F.shiftright("p", 6).alias("w"), F.col("p").bitwiseAND(63).cast("int").alias("b"))
        .groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("b")).toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(words)
    mask = (1 << bits) - 1

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        x = h.to_numpy().astype(np.int64).view(np.uint64)
        out = np.ones(len(x), bool)
        for p in (x >> np.uint64(64 - bits), x & np.uint64(mask)):
            out &= (sent.value[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)) == 1
        return pd.Series(out)

    return may


def hashed(key: Column) -> Column:
    """The hash that ``bit_table`` is asked by."""
    return F.xxhash64(key)

"""Exact dedup: counting quotient filters find repeated fingerprints, bytes decide.

Each task puts the fingerprints of its texts into counting quotient filters, cut
into blocks of the fingerprint's range. The blocks of all tasks merge by their
sorted remainders. Texts whose fingerprint counts more than one are compared byte by
byte, by grouping them; all others are unique and their texts never leave the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import WHITE_RE, arrow_batches, cut, flat, pick

#: Fingerprints that a task gathers before it hands on a filter.
FILTER_ROWS = 1 << 20
#: Fingerprints in a block of the merge, on average.
BLOCK_ROWS = 1 << 17
#: Bits of the table by which scans tell which texts may repeat: 8 MB, whatever the input.
ROUTE_BITS = 26
#: A text is hot if it has more than this part of all rows; so there are fewer hot texts than this.
HOT_TEXTS = 1000
#: Parts that a hot text's rows are dealt into.
SALTS = 100

BLOCKS = "block int, q int, n int, runs binary, remainders binary, counts binary"


def _norm(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RE, " ")


def _fingerprint(norm: Column, bits: int) -> Column:
    h = F.xxhash64(norm)
    return h if bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def _filters(prints: DataFrame, top: int) -> DataFrame:
    """Filters of each task's fingerprints (column ``fp``), one row a block."""
    schema = pa.schema([("block", pa.int32()), ("q", pa.int32()), ("n", pa.int32()), ("runs", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())])

    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        blocks = qf.high(prints, top).astype(np.int64)
        ends = np.flatnonzero(np.diff(blocks, append=-1)) + 1
        at, out = 0, []
        for end in ends:
            out.append((int(blocks[at]), *qf.encode(prints[at:end], counts[at:end], top)))
            at = end
        for i in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i:i + 1000]), schema.types)], schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                n += b.num_rows
            if n >= FILTER_ROWS:
                yield from rows(held)
                held, n = [], 0
        if held:
            yield from rows(held)

    return prints.select("fp").mapInArrow(build, BLOCKS)


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """``fp`` and its count ``n``, for each of the ``fp`` in ``prints`` (about ``rows`` of them) that comes more than once."""
    top = max(rows // BLOCK_ROWS, 1).bit_length() - 1

    def merged(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        parts = [qf.decode(qf.Filter(*r), top, int(key[0])) for r in block[list(qf.Filter._fields)].itertuples(index=False, name=None)]
        prints, counts = qf.merge(parts)
        often = counts > 1
        return pd.DataFrame({"fp": prints[often].view(np.int64), "n": counts[often]})

    return _filters(prints, top).groupBy("block").applyInPandas(merged, "fp long, n long")


def _router(repeated: DataFrame, bits: int = ROUTE_BITS):
    """A UDF that is true for every fingerprint in ``repeated``, and for few others while these are far fewer than ``2 ** bits``.

    What the driver gathers and sends out is a table of ``2 ** bits`` bits in words of 64.
    """
    spark = repeated.sparkSession
    word, bit = F.shiftrightunsigned("fp", 64 - bits + 6), F.shiftrightunsigned("fp", 64 - bits).bitwiseAND(63).cast("int").alias("bit")
    found = repeated.select(word.alias("w"), bit).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def routed(fp: pd.Series) -> pd.Series:
        x = fp.to_numpy().astype(np.int64).view(np.uint64)
        return pd.Series((sent.value[x >> np.uint64(64 - bits + 6)] >> (x >> np.uint64(64 - bits) & np.uint64(63)) & np.uint64(1)) == 1)

    return routed


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Per row of ``docs``: its id, ``keep_id`` (the id of the row that stays), ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are identical after each ``[\\x20\\x09-\\x0D]+`` became
    one space; ``text_sha256`` is of that form, in UTF-8. Of equal texts the row with the smallest id stays.

    * null is the empty text, and empty texts are equal like any other;
    * a null id comes after all others; a group without any id has a null ``keep_id``;
    * of rows that share text and id exactly one stays;
    * an empty table gives an empty result; other columns are not read, whatever their names.

    ``bits`` is the fingerprint's width; fewer bits make more texts meet and none
    equal. Long texts are hashed and grouped whole. One scan stores ids and hashes, some 60 bytes a
    row; filters, joins and the choice of the row that stays run on these. A second scan takes the
    texts with a repeated fingerprint, told by a table of fixed size, and groups them by their bytes with partial
    aggregation, so a group of copies of any size moves one row a task. Rows of hot
    texts are dealt out by their place before the last join.
    """
    arrow_batches(docs.sparkSession)
    src = pick(docs, id=id_col, text=text_col).select("id", _norm(F.col("text")).alias("norm")).withColumn("fp", _fingerprint(F.col("norm"), bits))
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    prints = cut(src.select("id", "fp", sha).withColumn("row", F.monotonically_increasing_id()))
    rows = prints.count()
    repeated = cut(repeated_fingerprints(prints, rows))
    routed = _router(repeated)

    # texts that are equal byte by byte; equal fingerprints alone make no group
    groups = (
        src.where(routed("fp")).groupBy("fp", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1").select("fp", sha, "keep_id", "group_size")
    )
    may = prints.withColumn("may", routed("fp"))
    met = may.where("may").drop("may")
    first = met.groupBy("fp", "sha").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("keep_row"))
    groups = cut(groups.join(first, ["fp", "sha"]))

    # both hashes, 320 bits, name a group from here on
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_TEXTS > rows).select("fp", "sha", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod("row", F.lit(SALTS))).otherwise(0).cast("int")
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = met.join(hot, ["fp", "sha"], "left").withColumn("salt", salt).drop("hot")
    groups = groups.join(hot, ["fp", "sha"], "left").withColumn("salt", F.explode(parts)).drop("hot")
    joined = dealt.join(groups, ["fp", "sha", "salt"], "left")
    alone = F.col("group_size").isNull()
    out = joined.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "sha",
    ).unionAll(may.where(~F.col("may")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, whole and under their own column names.

    Of rows that share text and id, the one whose columns have the least hash stays. Rows without a repeated fingerprint
    pass straight through; the others are grouped by their bytes.
    """
    arrow_batches(docs.sparkSession)
    df, names = flat(docs)
    id_at, text_at = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    src = df.withColumn("norm", _norm(text_at)).withColumn("fp", _fingerprint(F.col("norm"), bits))
    prints = cut(src.select("fp"))
    routed = _router(cut(repeated_fingerprints(prints, prints.count())))
    may = src.withColumn("may", routed("fp"))
    row = F.struct(*[F.col(c) for c in df.columns])
    one = may.where("may").groupBy("fp", "norm").agg(F.min_by(row, F.struct(id_at.isNull(), id_at, F.xxhash64(*df.columns))).alias("row"))
    return one.select("row.*").unionAll(may.where(~F.col("may")).select(*df.columns)).toDF(*names)

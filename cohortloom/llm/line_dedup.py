"""Line dedup: drop lines that recur in many documents.

Explode normalised lines, hash them, count distinct documents per hash, drop the
lines over the threshold and put the others together by position. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, at, cut, flat, pick

MIN_CHARS = 20
MIN_DOCS = 3
#: A key is hot if it has more than this part of the repeated lines; so there are fewer hot keys than this.
HOT_KEYS = 1000
#: Parts that a hot key's lines are dealt into.
SALTS = 100


def _keys(text: Column, min_chars: int) -> Column:
    """A struct of two 64-bit hashes for each line; null where the key is too short."""
    trimmed = F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    return F.transform(
        trimmed,
        lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))),
    )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Per row of ``docs``: its id, ``text`` without dropped lines, ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.
    A key of at least ``min_chars`` code points that at least ``min_docs`` documents
    hold loses its lines in all of them but the one with the largest id.

    * null text is an empty text: one empty line, kept;
    * rows that share an id are one document, counted once; each returns a row;
    * rows with a null id count for nothing and keep their lines;
    * within the keeping document every repeat of a line stays;
    * an empty table gives an empty result; other columns are not read.

    Keys are two independent 64-bit hashes. First a count per key with map-side
    partial aggregation finds keys on at least ``min_docs`` lines; only their lines
    go on to the exact count of distinct documents. Keys with over a thousandth of
    those lines, of which there can't be a thousand, are marked by a broadcast and
    their lines dealt out by id before they are joined.
    """
    src = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return _marked(src, min_chars, min_docs).select(
        F.col("id").alias(id_col),
        _kept().alias("text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text_col`` as ``line_dedup`` leaves it, and ``chars_col``, if there is one, counted anew.

    All rows and columns stay; a text without dropped lines, a null one too, stays as it is. Ids, repeats and null ids are taken as by ``line_dedup``; an empty table gives an empty result.
    """
    src, names = flat(docs)
    src = src.withColumns({"id": F.col(at(docs, id_col)), "text": F.coalesce(F.col(at(docs, text_col)), F.lit(""))})
    out = _marked(src, min_chars, min_docs).withColumn("kept", F.when(F.col("drop").isNotNull(), _kept()))
    new = {at(docs, text_col): F.col("kept")} | ({at(docs, chars_col): F.length("kept")} if chars_col in names else {})
    columns = [(f"c{i}", kind) for i, (_, kind) in enumerate(docs.dtypes)]
    return out.select(*[F.coalesce(new[c].cast(kind), F.col(c)).alias(c) if c in new else F.col(c) for c, kind in columns]).toDF(*names)


def _kept() -> Column:
    split = F.split("text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("drop"))
    return F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: F.get(split, i)), "\n"))


def _salted(lines: DataFrame, keys: DataFrame, hot: DataFrame) -> DataFrame:
    """``lines`` joined to ``keys`` on ``h1``, ``h2``: lines of hot keys are dealt by id into ``SALTS`` parts, each of which gets the key."""
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")
    parts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = lines.join(hot, ["h1", "h2"], "left").withColumn("salt", salt).drop("is_hot")
    return dealt.join(keys.join(hot, ["h1", "h2"], "left").withColumn("salt", F.explode(parts)).drop("is_hot"), ["h1", "h2", "salt"]).drop("salt")


def _marked(src: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``src`` (``id``, ``text``, others) with ``drop``, the places of the lines that go; null for none."""
    src = src.withColumn("mark", F.xxhash64("text"))
    lines = (
        src.where(F.col("id").isNotNull())
        .select("id", "mark", F.posexplode(_keys(F.col("text"), min_chars)).alias("pos", "key"))
        .where(F.col("key").isNotNull())
        .select("id", "mark", "pos", "key.h1", "key.h2")
    )
    often = cut(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs))
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(often.where(F.col("n") * HOT_KEYS > total).select("h1", "h2", F.lit(True).alias("is_hot")))
    repeated = cut(_salted(lines, often.select("h1", "h2"), hot))
    keys = (
        repeated.select("h1", "h2", "id").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )
    drops = (
        _salted(repeated, keys, hot)
        .where(F.col("id") != F.col("keeper"))
        .select("id", "mark", "pos").distinct()
        .groupBy("id", "mark").agg(F.collect_list("pos").alias("drop"))
    )
    return src.join(drops, ["id", "mark"], "left")

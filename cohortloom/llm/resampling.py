"""Importance resampling towards a target distribution.

Features are runs of words. A dictionary of distinct features counts each string
over all documents and hashes it once; buckets add these counts up, and a bucket's
gain compares the target with the documents. The gains are joined back to the
features that each document counts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut, flat, pick

BUCKETS = 10000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Distinct features that a task counts before it hands them on, and their bytes.
HELD_FEATURES, HELD_BYTES = 200_000, 16 << 20
#: A feature is common if it has more than this part of all; so there are fewer common ones than this.
COMMON = 20_000
#: Features of more bytes than this are joined by their digest.
KEY_BYTES = 64

#: Bytes to words: A-Z are lower-cased, other ASCII but letters and digits ends a word, the rest stays.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def features_of(words: list[bytes], longest: int) -> Counter:
    """Runs of 1 to ``longest`` words, joined by one space, and how often each comes."""
    found = Counter(words)
    for n in range(2, longest + 1):
        found.update(map(b" ".join, zip(*[words[i:] for i in range(n)])))
    return found


def _key(feature: bytes) -> bytes:
    return feature if len(feature) <= KEY_BYTES else b"\0" + hashlib.sha256(feature).digest()


def _key_of(feature: Column) -> Column:
    digest = F.concat(F.unhex(F.lit("00")), F.unhex(F.sha2(feature, 256)))
    return F.when(F.octet_length(feature) <= KEY_BYTES, feature).otherwise(digest)


def feature_dictionary(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``feature``, its count ``n`` over all of ``texts`` (binary column ``text``) and its ``bucket``: one row, and one hash, a distinct string."""
    schema = pa.schema([("feature", pa.binary()), ("n", pa.int64())])

    def rows(held: Counter) -> Iterator[pa.RecordBatch]:
        names = list(held)
        for i in range(0, len(names), 10_000):
            part = names[i:i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([held[x] for x in part], pa.int64())], schema=schema)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0
        for b in batches:
            for t in b.column(0):
                if t := t.as_py():
                    before = len(held)
                    found = features_of(words_of(t), longest)
                    held.update(found)
                    size += (len(held) - before) * (sum(map(len, found)) // max(len(found), 1) + 1)
                    if len(held) >= HELD_FEATURES or size >= HELD_BYTES:
                        yield from rows(held)
                        held, size = Counter(), 0
        yield from rows(held)

    counted = texts.select("text").mapInArrow(tally, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return counted.withColumn("bucket", F.pmod(F.crc32("feature"), F.lit(buckets)).cast("int"))


def bucket_gains(own: DataFrame, target: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """``gain`` of each of the ``buckets``, and the number of features in ``own``, from two dictionaries."""
    spark = own.sparkSession
    s, t = (d.groupBy("bucket").agg(F.sum("n").alias(c)) for d, c in ((own, "s"), (target, "t")))
    # one row a bucket: as many as there are buckets, whatever the input
    both = cut(
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(s), "bucket", "left").join(F.broadcast(t), "bucket", "left").na.fill(0)
    )
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    return both.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain")), total["s"]


def _weighed(docs: DataFrame, common: dict[bytes, int], longest: int) -> DataFrame:
    """``docs`` (``id``, ``text`` as binary, ``hash``) with the number of words and features, the gains of the common features, and the other features with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(common)
    entry = pa.struct([("key", pa.binary()), ("n", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = sent.value
        for b in batches:
            n_words, n_features, weights, ends, keys, counts = [], [], [], [0], [], []
            for t in b.column("text"):
                words = words_of(t.as_py() or b"")
                found, weight = features_of(words, longest), 0
                for f, n in found.items():
                    k = _key(f)
                    if (g := gains.get(k)) is None:
                        keys.append(k)
                        counts.append(n)
                    else:
                        weight += g * n
                n_words.append(len(words))
                n_features.append(sum(found.values()))
                weights.append(weight)
                ends.append(len(keys))
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], fields=list(entry)))
            arrays = [b.column("id"), b.column("hash"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(weights, pa.int64()), rest]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "hash", "n_words", "n_features", "weight", "rest"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(weigh, f"id {kind}, hash long, n_words long, n_features long, weight long, rest array<struct<key: binary, n: long>>")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3... in ``order``: partitioned by range, and each partition numbered from where the one before ends.

    The driver sees one count a partition.
    """
    lined = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = lined.groupBy(part.alias("part")).count().collect()
    starts, total = [], 0
    for r in sorted(sizes):
        starts.append((r["part"], total))
        total += r["count"]
    before = rows.sparkSession.createDataFrame(starts, "part int, before long")
    out = lined.withColumn("part", part).join(F.broadcast(before), "part", "left")
    return out.withColumn("rank", place + F.col("before") + 1).drop("at", "part", "before")


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS,
               min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``: its id, ``n_features``, ``weight``, ``score`` and ``rank``; null rank if it isn't drawn.

    Words are runs of letters, digits and whatever isn't ASCII, A-Z lower-cased;
    features are runs of up to ``longest`` words. The weight adds up the gains of a
    row's features, the score adds Gumbel noise that the id and ``seed`` fix, and of the N
    rows with ``min_words`` words the ``percent * N // 100`` highest scores are drawn,
    ties to the smaller id.

    * null and empty texts have no features and weight 0;
    * a null id counts as an empty string in the noise, and comes last among ties;
    * rows that repeat each get a row, a score and a place of their own;
    * an empty table gives an empty result, an empty target gives gains that only ``docs`` makes; other columns are not read.

    The dictionary is counted in the tasks first, so a frequent word moves one row a
    task. Features with over a ``COMMON``-th of all, fewer than ``COMMON`` of at most ``KEY_BYTES`` bytes each, go to
    the tasks with their gains; the others of each row, none of which is frequent, are joined by
    shuffles. Texts are read whole, twice.
    """
    src = pick(docs, id=id_col, text=text_col).withColumn("hash", F.xxhash64("text"))
    return _drawn(src, target, target_text, longest, buckets, min_words, percent, seed).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``importance`` draws, whole; rows that share id and text are drawn together."""
    df, names = flat(docs)
    id_at, text_at = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    src = pick(docs, id=id_col, text=text_col).withColumn("hash", F.xxhash64("text"))
    spec = {"target_text": "text", "longest": 1, "buckets": BUCKETS, "min_words": MIN_WORDS, "percent": PERCENT, "seed": SEED} | options
    drawn = _drawn(src, target, **spec).where(F.col("rank").isNotNull()).select("id", "hash").distinct()
    return df.join(drawn, id_at.eqNullSafe(F.col("id")) & (F.xxhash64(text_at) == F.col("hash")), "left_semi").toDF(*names)


def _drawn(src: DataFrame, target: DataFrame, target_text: str, longest: int, buckets: int, min_words: int, percent: int, seed: str) -> DataFrame:
    arrow_batches(src.sparkSession)
    src = src.withColumn("text", F.col("text").cast("binary"))
    own = cut(feature_dictionary(src, longest, buckets))
    other = feature_dictionary(pick(target, text=target_text).select(F.col("text").cast("binary").alias("text")), longest, buckets)
    gains, total = bucket_gains(own, other, buckets)
    # as many rows as there are buckets
    known = own.join(F.broadcast(gains), "bucket").select(_key_of(F.col("feature")).alias("key"), "n", "gain")
    common = known.where(F.col("n") * COMMON > total)
    held = {bytes(r["key"]): r["gain"] for r in common.select("key", "gain").collect()}

    rows = cut(_weighed(src.select("id", "hash", "text"), held, longest).withColumn("row", F.monotonically_increasing_id()))
    rest = rows.where(F.size("rest") > 0).select("row", F.explode("rest").alias("f")).select("row", "f.key", F.col("f.n").alias("times"))
    more = rest.join(known.where(F.col("n") * COMMON <= total).select("key", "gain"), "key").groupBy("row").agg(F.sum(F.col("gain") * F.col("times")).alias("more"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = cut(
        rows.drop("rest").join(more, "row", "left").withColumn("weight", F.col("weight") + F.coalesce("more", F.lit(0)))
        .withColumn("score", F.col("weight") + noise).drop("more", "row")
    )
    enough = scored.where(F.col("n_words") >= min_words)
    drawn = enough.count() * percent // 100
    order = F.col("score").desc(), F.col("id").asc_nulls_last()
    ranks = ranked(enough, *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    few = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranks.select(*few.columns).unionAll(few)

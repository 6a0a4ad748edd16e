"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``, the white space of every contract here.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows in one Arrow batch: texts are long, so far fewer than Spark's 10,000.
ARROW_ROWS = 1000
#: Nor more bytes than this, but for one text that is longer.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns ``new=old`` only, by position, so that other columns may bear any name.

    Spark resolves names without regard to case; here the first column spelled
    exactly as asked for is taken, whatever else the table holds.
    """
    out, cols = flat(df)
    return out.select(*[F.col(f"c{cols.index(old)}").alias(new) for new, old in names.items()])


def flat(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ... and their true names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def at(df: DataFrame, name: str) -> str:
    """Where ``flat`` puts the first column spelled ``name``."""
    return f"c{df.columns.index(name)}"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` is quick and equal on pure ASCII; other texts are translated."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


#: The temporary folder of each application that names none.
_folders: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one, the same for an application's life, where none is set and all runs on one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        app = spark.sparkContext
        if app.master.startswith("local-cluster") or not app.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app.applicationId not in _folders:
            _folders[app.applicationId] = tempfile.mkdtemp(prefix="checkpoints-")
        at = _folders[app.applicationId]
    return at.rstrip("/")


#: A key is hot if it has more than this part of the rows of a join; so there are fewer hot keys than this.
HOT_KEYS = 1000
#: Parts that a hot key's rows are dealt into.
SALTS = 100


def salted(left: DataFrame, right: DataFrame, on: list[str], n: str, by: list[str]) -> DataFrame:
    """``left`` joined to ``right`` on the columns ``on``, which aren't null, without ``right``'s column ``n``.

    ``right`` has one row a key, with the number of ``left``'s rows that have it in
    ``n``. Rows of hot keys are dealt by the hash of ``by`` into ``SALTS`` parts, each
    of which gets the key. Hot keys are known by 64-bit hashes, fewer than
    ``HOT_KEYS`` of them, which are broadcast; a key that shares a hash is dealt out too.
    """
    total = right.agg(F.sum(n).alias("hot_total"))
    hot = right.crossJoin(F.broadcast(total)).where(F.col(n) * HOT_KEYS > F.col("hot_total")).select(F.xxhash64(*on).alias("hot_key")).distinct().withColumn("is_hot", F.lit(True))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("hot_key", F.xxhash64(*on)).join(F.broadcast(hot), "hot_key", "left")

    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("int")
    parts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = marked(left).withColumn("salt", salt).drop("hot_key", "is_hot")
    copies = marked(right).withColumn("salt", F.explode(parts)).drop("hot_key", "is_hot", n)
    return dealt.join(copies, [*on, "salt"]).drop("salt")


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within the block go at its end: whatever is lazy must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and where; what is still there goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    file_system, p = _file_system(spark, path)
    file_system.deleteOnExit(p)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, which outlives any executor."""
    return stored(df)[0]


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Hand texts to Python in small batches, so that a worker holds a few MB at a time.

    Lazy plans read these settings when they run, so they stay lowered for the session.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this job wrote, on whatever file system it lies."""
    file_system, p = _file_system(spark, path)
    file_system.delete(p, True)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def within(sample: DataFrame, size: str, most: int) -> DataFrame:
    """The first rows of ``sample``, a written table of bounded length with an ``id`` a row, in the order of the ids' hashes, as far as their ``size`` in bytes comes to ``most``.

    Only an id's hash and its size come to the driver.
    """
    held = sample.select(F.xxhash64("id").alias("h"), F.col(size).alias("n")).collect()
    total, last = 0, None
    for h, n in sorted((r["h"], r["n"]) for r in held):
        total += n
        if total > most:
            break
        last = h
    return sample.where(F.lit(False)) if last is None else sample.where(F.xxhash64("id") <= last)

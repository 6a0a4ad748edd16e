"""Staging files into a cache, and a log of it. Spark reads in place; this is for slow mirrors."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import DataSource, resolve_tables
from .transfer import RANGE_BYTES, Copy, budget, copy_files  # noqa: F401  (budget is part of staging)

SCHEMA = "year int, request string, table string, cardinality string, source string, path string, status string, attempts int, bytes long, elapsed_seconds double, error string"


@dataclass(frozen=True)
class Staged:
    """One table-year and what became of it: downloaded, reused or failed."""

    year: int
    request: str
    table: str
    cardinality: str
    source: str
    path: str
    status: str
    attempts: int = 0
    bytes: int | None = None
    elapsed_seconds: float = 0.0
    error: str | None = None


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file systems have ``path``, wherever that is."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fetch(url: str, destination: str, retry_max: int = 3, timeout: float = 1800, expected_bytes: int | None = None, backoff: float = 1.0) -> tuple[int, int]:
    """(attempts, bytes). Waits ``backoff`` * 2^(k-1) after attempt k of a range; no partial file is ever at ``destination``."""
    ((status, attempts, size, _, _, error),) = copy_files(SparkSession.active(), [Copy(url, destination, expected_bytes)], True, retry_max, timeout, backoff)
    if status == "failed":
        raise OSError(error)
    return attempts, size


def stage(wanted: list[Staged], overwrite: bool = False, expected_bytes: dict[str, int] | None = None, expected_sha256: dict[str, str] | None = None, **options) -> list[Staged]:
    """Copy files; those that are there as published are reused, those that can't be got recorded as failed.

    What is published is told by the names of the sources; ``options`` are those of ``copy_files``.
    """
    names = [w.source.rsplit("/", 1)[-1] for w in wanted]
    copies = [Copy(w.source, w.path, (expected_bytes or {}).get(n), (expected_sha256 or {}).get(n)) for w, n in zip(wanted, names)]
    done = copy_files(SparkSession.active(), copies, overwrite, **options)
    return [replace(w, status=status, attempts=attempts, bytes=size, elapsed_seconds=seconds, error=error) for w, (status, attempts, size, _, seconds, error) in zip(wanted, done)]


def download_tables(years, tables, source: DataSource, path: str, overwrite: bool = False, retry_max: int = 3, timeout: float = 1800, backoff: float = 1.0,
                    expected_bytes: dict[str, int] | None = None, expected_sha256: dict[str, str] | None = None, range_bytes: int = RANGE_BYTES) -> list[Staged]:
    """Copy each table-year into the cache folder ``path``, on any file system that driver and executors reach.

    Each range of a file is a task of its own, so that bytes don't pass the driver; what became of each file comes
    back to it. ``expected_bytes`` and ``expected_sha256`` go by file name, as in a build's manifest. A copy that was
    broken off goes on at the next call.
    """
    wanted = [Staged(year, t.request, t.table, t.cardinality, source.path(t.table, year), source.cache_path(path, t.table, year), "failed")
              for year in sorted({int(y) for y in years}) for t in resolve_tables(tables, source)]
    return stage(wanted, overwrite, expected_bytes, expected_sha256, retry_max=retry_max, timeout=timeout, backoff=backoff, range_bytes=range_bytes)


def download_manifest(spark: SparkSession, staged: list[Staged]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(s).values()) for s in staged], SCHEMA)


LOG = f"run_id string, kind string, recorded_at timestamp, {SCHEMA}"
RUNS = "run_id string, kind string, recorded_at timestamp, resources long, downloaded long, reused long, failed long, bytes long, elapsed_seconds double, log_file string"


def write_log(folder: str, staged: list[Staged], kind: str = "download") -> str:
    """One Parquet folder a run under ``logs``, on any file system; returns the run's id.

    Runs never write to the same place, so drivers may log at once; a run counts from when its folder has
    its ``_SUCCESS`` marker, which is written last.
    """
    spark = SparkSession.active()
    now = datetime.now(UTC)
    run = f"{now.strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:8]}"
    rows = [(run, kind, now, *asdict(s).values()) for s in staged]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{folder.rstrip('/')}/logs/{kind}-{run}")
    return run


def retrieval_log(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each whole run, in the order of their times; none if nothing was logged."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(f"{folder.rstrip('/')}/logs")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [x.getPath() for x in fs.listStatus(root) if x.isDirectory()] if fs.exists(root) else []
    whole = [p.toString() for p in runs if fs.exists(path(p, "_SUCCESS"))]
    if not whole:
        return spark.createDataFrame([], RUNS)
    tally = [F.sum((F.col("status") == k).cast("long")).alias(k) for k in ("downloaded", "reused", "failed")]
    rows = spark.read.schema(LOG).parquet(*whole).groupBy("run_id", "kind", "recorded_at").agg(
        F.count("*").alias("resources"), *tally, F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.round(F.sum("elapsed_seconds"), 1).alias("elapsed_seconds"))
    return rows.withColumn("log_file", F.concat_ws("-", "kind", "run_id")).orderBy("recorded_at", "run_id")

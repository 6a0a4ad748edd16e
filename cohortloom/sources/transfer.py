"""Copies of files onto any file system that Arrow reaches, in ranges.

A range of a file is a row of a DataFrame and is fetched in a task; it lies beside the target until all
of the file is there, so a copy that was broken off goes on where it stopped. The last task of a file
puts its ranges together, verifies them, and renames the whole to its name.
"""

from __future__ import annotations

import hashlib
import math
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache
from typing import BinaryIO
from urllib.error import HTTPError
from urllib.parse import unquote, urlparse

import pandas as pd
from pyarrow import fs as arrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one range, and of one read.
RANGE_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: The slowest transfer that a timeout allows for, and the longest timeout.
BYTES_A_SECOND = 512 * 1024
MAX_TIMEOUT = 2_147_483

PROBED = "i int, source string, target string, bytes long, sha256 string, size long, ranged boolean, version string, held long, fits boolean, error string"
FETCHED = "i int, first long, length long, digest string, attempts int, seconds double, error string"
COPIED = "i int, status string, attempts int, bytes long, sha256 string, elapsed_seconds double, error string"


@dataclass(frozen=True)
class Copy:
    """A file to copy, with its published size and SHA-256 where they are known."""

    source: str
    target: str
    bytes: int | None = None
    sha256: str | None = None


def budget(timeout: float, size: int | None = None, floor: float = 0) -> int:
    """Seconds to allow for ``size`` bytes."""
    need = math.ceil(size / BYTES_A_SECOND) if size else 0
    return int(min(max(timeout, need, floor), MAX_TIMEOUT))


def over_http(uri: str) -> bool:
    return urlparse(uri).scheme in ("http", "https")


@cache
def _system(scheme: str, authority: str) -> arrow.FileSystem:
    return arrow.FileSystem.from_uri(f"{scheme}://{authority}/")[0]


def place(uri: str) -> tuple[arrow.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return arrow.LocalFileSystem(), unquote(u.path) if u.scheme else uri
    if u.scheme in ("s3", "s3a", "s3n", "gs", "gcs"):
        return _system("s3" if u.scheme.startswith("s3") else "gs", u.netloc), f"{u.netloc}{u.path}"
    return _system(u.scheme, u.netloc), u.path


def size_there(uri: str) -> int | None:
    """Bytes of a file; None if there is none."""
    system, path = place(uri)
    info = system.get_file_info(path)
    return info.size if info.type == arrow.FileType.File else None


def probe(source: str, timeout: float) -> tuple[int | None, bool, str]:
    """Size of a source, whether ranges of it can be had, and a mark of its version."""
    if not over_http(source):
        system, path = place(source)
        info = system.get_file_info(path)
        if info.type != arrow.FileType.File:
            raise FileNotFoundError(f"no such file: {source}")
        return info.size, True, f"{info.size}-{info.mtime_ns}"
    try:
        with urllib.request.urlopen(urllib.request.Request(source, method="HEAD"), timeout=budget(timeout)) as r:
            told = r.headers
    except OSError as e:
        if isinstance(e, HTTPError) and e.code in (404, 410):
            raise
        return None, False, ""  # a server that doesn't answer this may still give the file
    size = told.get("Content-Length")
    ranged = size is not None and told.get("Accept-Ranges", "").lower() == "bytes"
    return int(size) if size is not None else None, ranged, f"{size}-{told.get('ETag') or told.get('Last-Modified') or ''}"


@contextmanager
def reading(source: str, first: int, length: int | None, timeout: float) -> Iterator[tuple[BinaryIO, int | None]]:
    """A stream of ``length`` bytes from ``first`` on, or of the whole file without a length; and how many bytes are promised."""
    if over_http(source):
        head = {} if length is None else {"Range": f"bytes={first}-{first + length - 1}"}
        with urllib.request.urlopen(urllib.request.Request(source, headers=head), timeout=budget(timeout, length)) as r:
            if head and r.status != 206:
                raise OSError(f"{source}: asked for a range, got status {r.status}")
            told = r.headers.get("Content-Length")
            yield r, int(told) if length is None and told is not None else length
    else:
        system, path = place(source)
        with system.open_input_file(path) as f:
            f.seek(first)
            yield f, length


def flow(source: BinaryIO, out, digest, length: int | None = None) -> int:
    """Bytes moved from ``source`` to ``out``, in small reads."""
    moved = 0
    while block := source.read(READ_BYTES if length is None else min(READ_BYTES, length - moved)):
        digest.update(block)
        if out is not None:
            out.write(block)
        moved += len(block)
    return moved


def digest_of(uri: str) -> str:
    system, path = place(uri)
    digest = hashlib.sha256()
    with system.open_input_stream(path, compression=None) as f:
        flow(f, None, digest)
    return digest.hexdigest()


def settle(uri: str, write: Callable) -> None:
    """Write a file under a name of its own, then rename it: at ``uri`` there is all of it or nothing, whichever attempt comes first."""
    system, path = place(uri)
    own = f"{path}.{uuid.uuid4().hex}"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    try:
        with system.open_output_stream(own, compression=None) as out:
            write(out)
        if system.type_name != "local" and system.get_file_info(path).type == arrow.FileType.File:
            system.delete_file(path)
        system.move(own, path)
    finally:
        if system.get_file_info(own).type == arrow.FileType.File:
            system.delete_file(own)


def folder_of(target: str, version: str) -> str:
    """Where the ranges of a file wait; ranges of another version of its source lie elsewhere."""
    return f"{target}.ranges/{hashlib.sha256(version.encode()).hexdigest()[:16]}"


def range_at(target: str, version: str, first: int) -> str:
    return f"{folder_of(target, version)}/{first:020d}"


def fetch_range(source: str, target: str, version: str, first: int, length: int | None, retry_max: int, timeout: float, backoff: float) -> tuple[int, str, int]:
    """(bytes, SHA-256, attempts) of one range beside the target. One that is there, in its whole length, is not asked for: no attempts."""
    at = range_at(target, version, first)
    if length is not None and size_there(at) == length:
        return length, digest_of(at), 0
    for attempt in range(1, retry_max + 1):
        digest, moved = hashlib.sha256(), 0

        def write(out) -> None:
            nonlocal moved
            with reading(source, first, length, timeout) as (r, promised):
                moved = flow(r, out, digest, length)
            if promised is not None and moved != promised:
                raise OSError(f"incomplete transfer: {moved} of {promised} bytes from {first} on")

        try:
            settle(at, write)
            return moved, digest.hexdigest(), attempt
        except OSError:
            if attempt == retry_max:
                raise
            time.sleep(backoff * 2 ** (attempt - 1))
    raise ValueError("retry_max must be at least 1")


def drop_folder(uri: str) -> None:
    system, path = place(uri)
    if system.get_file_info(path).type == arrow.FileType.Directory:
        system.delete_dir(path)


def commit(copy: Copy, version: str, parts: list[tuple[int, int, str]]) -> tuple[int, str]:
    """(bytes, SHA-256) of the whole file, put together from ``parts`` (first, length, digest), verified, and renamed.

    A task that runs again after its file was committed finds no ranges but the file, and verifies that. What
    doesn't fit its published size or digest goes with its ranges.
    """
    total = sum(n for _, n, _ in parts)
    places = [range_at(copy.target, version, first) for first, _, _ in parts]
    try:
        if copy.bytes is not None and total != copy.bytes:
            raise OSError(f"expected {copy.bytes} bytes, got {total}")
        if any(size_there(p) is None for p in places):
            if size_there(copy.target) != total:
                raise OSError(f"ranges of {copy.target} are gone")
            whole = digest_of(copy.target)
            _verify(copy, whole)
            return total, whole
        if len(parts) == 1:
            whole = parts[0][2]
            _verify(copy, whole)
            system, path = place(copy.target)
            if system.type_name != "local" and system.get_file_info(path).type == arrow.FileType.File:
                system.delete_file(path)
            system.move(place(places[0])[1], path)
        else:
            digest = hashlib.sha256()

            def write(out) -> None:
                for p in places:
                    system, path = place(p)
                    with system.open_input_stream(path, compression=None) as f:
                        flow(f, out, digest)
                _verify(copy, digest.hexdigest())

            settle(copy.target, write)
            whole = digest.hexdigest()
    except OSError:
        drop_folder(f"{copy.target}.ranges")
        raise
    drop_folder(f"{copy.target}.ranges")
    return total, whole


def _verify(copy: Copy, digest: str) -> None:
    if copy.sha256 is not None and digest != copy.sha256.lower():
        raise OSError(f"expected SHA-256 {copy.sha256.lower()}, got {digest}")


def probed(spark: SparkSession, copies: list[Copy], timeout: float = 1800) -> DataFrame:
    """A row a file: its size and version, the bytes at its target, and whether these are as published. Each is asked for in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["id"]:
                c = copies[i]
                try:
                    held, fits, size, ranged, version, error = None, False, None, False, "", None
                    held = size_there(c.target)
                    fits = held is not None and c.bytes in (None, held) and (c.sha256 is None or digest_of(c.target) == c.sha256.lower())
                    size, ranged, version = probe(c.source, timeout)
                except OSError as e:
                    error = str(e)
                rows.append((i, c.source, c.target, c.bytes, c.sha256, size, ranged, version, held, fits, error))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PROBED.split(", ")]).astype({"bytes": "Int64", "size": "Int64", "held": "Int64"})

    return spark.range(len(copies), numPartitions=max(1, min(len(copies), 1000))).mapInPandas(run, PROBED)


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row a range: ``first`` and ``length``, which is null where only the whole file can be had."""
    whole = ~F.col("ranged") | F.col("size").isNull() | (F.col("size") == 0)
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long")))
    return files.select("*", whole.alias("whole"), F.explode(starts).alias("first")).withColumn(
        "length", F.when(~F.col("whole"), F.least(F.lit(range_bytes).cast("long"), F.col("size") - F.col("first"))))


def copy_files(spark: SparkSession, copies: list[Copy], overwrite: bool = False, retry_max: int = 3, timeout: float = 1800, backoff: float = 1.0, range_bytes: int = RANGE_BYTES) -> list[tuple]:
    """What became of each of ``copies``, in their order, as ``COPIED`` says without its ``i``.

    A file that is at its target is reused, if it has its published size, or none is published; its digest is
    verified too where one is published. Others are copied range by range: a task holds a megabyte of a file, whatever its
    size. A range that can't be got fails its file after ``retry_max`` attempts, and the ranges that were got stay for the
    next call. Two jobs run, and a row a file comes back to the driver.
    """
    if not copies:
        return []
    if retry_max < 1:
        raise ValueError("retry_max must be at least 1")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                began, length = time.monotonic(), None if pd.isna(r.length) else int(r.length)
                try:
                    moved, digest, attempts = fetch_range(r.source, r.target, r.version, r.first, length, retry_max, timeout, backoff)
                    rows.append((r.i, r.first, moved, digest, attempts, time.monotonic() - began, None))
                except OSError as e:
                    rows.append((r.i, r.first, None, None, retry_max, time.monotonic() - began, str(e)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FETCHED.split(", ")]).astype({"length": "Int64"})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                c, began = copies[r.i], time.monotonic()
                status, total, whole, error = "failed", None, None, r.error
                if error is None:
                    try:
                        total, whole = commit(c, r.version, [(p["first"], p["length"], p["digest"]) for p in r.parts])
                        status = "downloaded"
                    except OSError as e:
                        error = str(e)
                rows.append((r.i, status, r.attempts, total, whole, round(r.seconds + time.monotonic() - began, 3), error))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in COPIED.split(", ")]).astype({"bytes": "Int64"})

    done, todo = {}, []
    for r in probed(spark, copies, timeout).collect():
        if r["fits"] and not overwrite:
            done[r["i"]] = ("reused", 0, r["held"], r["sha256"], 0.0, None)
        elif r["error"] is not None:
            done[r["i"]] = ("failed", retry_max, None, None, 0.0, r["error"])
        else:
            todo.append(r)
    if todo:
        tasks = sum(max(1, math.ceil((r["size"] or 1) / range_bytes)) for r in todo)
        asked = ranges(spark.createDataFrame(todo, PROBED), range_bytes).repartition(min(tasks, 10_000), "target", "first")
        got = asked.select("i", "source", "target", "version", "first", "length").mapInPandas(fetch, FETCHED)
        files = got.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("first", "length", "digest"))).alias("parts"), F.max("attempts").alias("attempts"),
                                     F.sum("seconds").alias("seconds"), F.min("error").alias("error"))
        versions = spark.createDataFrame([(r["i"], r["version"]) for r in todo], "i int, version string")
        for r in files.join(versions, "i").repartition(min(len(todo), 1000), "i").mapInPandas(finish, COPIED).collect():
            done[r["i"]] = tuple(r)[1:]
    return [done[i] for i in range(len(copies))]

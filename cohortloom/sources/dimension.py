"""Reading the organization dimension: a table, one file, or state files stacked."""

from __future__ import annotations

import json
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import fold, quoted
from ..operators.dimension import FIELDS, HELPERS, Prepared, prepare
from ..operators.membership import semi
from ..plans.catalog import format_of
from .keyed import keep_entities
from .stage import Staged, exists, stage, write_log

# Codes of the state files.
STATES = (
    "AA", "AE", "AK", "AL", "AP", "AR", "AS", "AZ", "CA", "CO", "CT", "DC", "DE", "FL", "FM", "GA", "GU", "HI", "IA", "ID", "IL", "IN", "KS", "KY", "LA",
    "MA", "MD", "ME", "MH", "MI", "MN", "MO", "MP", "MS", "MT", "NC", "ND", "NE", "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR", "PA", "PR", "PW", "RI",
    "SC", "SD", "TN", "TX", "UT", "VA", "VI", "VT", "WA", "WI", "WV", "WY", "ZZ",
)


# How a build lies under its root, and its states' files under theirs.
FILES = {"parquet": "bmf_unified_geocoded.parquet", "csv": "bmf_unified_geocoded.csv", "manifest": "_manifest.json"}
STATE_FILES = ("state={}", "state={}/part-0.parquet", "state%3D{}/part-0.parquet", "state={}.parquet", "bmf_master_{}.csv")
FORMATS = ("auto", "parquet", "states", "csv")


def dimension_fields() -> tuple[str, ...]:
    return FIELDS


def dimension_url(root: str, format: str = "parquet") -> str:
    """Where a build's file, or its manifest, lies under ``root``."""
    if format not in FILES:
        raise ValueError(f"format must be one of {', '.join(FILES)}")
    return f"{root.rstrip('/')}/{FILES[format]}"


def state_file(spark: SparkSession, root: str, state: str) -> str | None:
    """A state's file, Parquet or CSV, in any of the published layouts; None if there is none."""
    return next((at for f in STATE_FILES if exists(spark, at := f"{root.rstrip('/')}/{f.format(state)}")), None)


def resolve_states(states=None) -> list[str]:
    if states is None:
        return list(STATES)
    got = list(dict.fromkeys(str(s).strip().upper() for s in ([states] if isinstance(states, str) else states)))
    if bad := [s for s in got if s not in STATES]:
        raise ValueError(f"unknown state code: {', '.join(bad)}")
    return got


def build_manifest(spark: SparkSession, path: str) -> dict:
    """A build's manifest, a JSON object, in a file or in the parts of a folder.

    Read by the file system: Spark's readers pass over names that begin with an underscore.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.globStatus(at) or ()]
    files = [y.getPath() for x in found for y in fs.listStatus(x) if y.isFile() and (y.getPath().equals(x) or not y.getPath().getName().startswith(("_", ".")))]
    text = ""
    for f in files:
        stream = fs.open(f)
        try:
            text += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    return json.loads(text)


def manifest_entry(manifest: dict, name: str) -> dict:
    """What the manifest tells of a file, as ``bytes`` and ``sha256``; nothing, if it doesn't have it."""
    files = manifest.get("files", {})
    if isinstance(files, dict) and name in files:
        f = files[name]
        return f if isinstance(f, dict) else {"bytes": f}
    entries = files.values() if isinstance(files, dict) else files
    return next((f for f in entries if isinstance(f, dict) and f.get("name") == name), {})


def manifest_bytes(manifest: dict, name: str) -> int | None:
    """The published size of a file, if the manifest has it."""
    size = manifest_entry(manifest, name).get("bytes")
    return None if size is None else int(size)


def stage_dimension(spark: SparkSession, root: str, folder: str, format: str = "parquet", overwrite: bool = False, **options) -> Staged:
    """Copy a build's file into ``folder``, its size and SHA-256 checked against the build's manifest where that has them; a whole copy is reused."""
    url = dimension_url(root, format)
    at = dimension_url(root, "manifest")
    return _staged(spark, [url], folder, build_manifest(spark, at) if exists(spark, at) else {}, overwrite, **options)[0]


def _staged(spark: SparkSession, urls: list[str], folder: str, manifest: dict, overwrite: bool = False, **options) -> list[Staged]:
    names = [u.rsplit("/", 1)[1] for u in urls]
    published = {n: manifest_entry(manifest, n) for n in names}
    wanted = [Staged(0, n, n, "1x1", u, f"{folder.rstrip('/')}/{n}", "failed") for n, u in zip(names, urls)]
    return stage(wanted, overwrite, {n: int(e["bytes"]) for n, e in published.items() if "bytes" in e}, {n: e["sha256"] for n, e in published.items() if e.get("sha256")}, **options)


def read_file(spark: SparkSession, path: str, vars=None) -> DataFrame:
    """Parquet or CSV; of ``vars`` and the helpers, those that the file has."""
    if not path.lower().endswith(".csv"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    if vars is None:
        return df
    names = [c for c in df.columns if c in {*vars, *HELPERS}]
    if not names:
        raise ValueError(f"none of the requested fields are in {path}")
    return df.select(*[quoted(c) for c in names])


def stack_states(frames: list[DataFrame]) -> DataFrame:
    """State files by name, without their partition column."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.drop("state")


def retrieve(spark: SparkSession, source: DataFrame | str, vars=FIELDS, ids=None, states=None, strict: bool = False, id: str = "EIN2", manifest: dict | None = None, format: str = "auto",
             path: str | None = None, overwrite: bool = False) -> Prepared:
    """A prepared dimension from a table, a file, or a build's folder; ``ids`` (values or a table) narrows it first.

    Of a folder ``auto`` takes the state files if ``states`` are asked for; else the unified Parquet file, the unified CSV
    file, or all state files, whichever is there first. State files that aren't there are left out with a warning. All of them together
    are a build of their own that may lag behind the unified file: that is warned of, in numbers if the build's
    ``manifest`` tells them (a job that counts). The manifest that lies beside a unified file is read if none is given.
    Diagnostics tell where the rows come from, and the manifest's vintage or else the newest in the data.

    With ``path`` a unified file is copied there first, verified against its manifest, and the copy is read; the run is logged
    there, and a copy that fails raises. A copy that is there as published is reused unless ``overwrite``.
    """
    if format not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    origin: dict = {"source_type": "memory", "format": None, "states": None}
    if isinstance(source, DataFrame):
        df = source
    elif states is None and format == "auto" and source.lower().endswith((".parquet", ".csv")):
        df = read_file(spark, source, vars)
        origin |= {"source_type": "file", "format": format_of(source)}
    else:
        if format == "auto":
            there = [f for f in ("parquet", "csv") if exists(spark, dimension_url(source, f))]
            format = "states" if states is not None or not there else there[0]
        if format == "states":
            df, held = _states(spark, source, vars, states)
            if len(held) == len(STATES):
                warn_lag(manifest.get("rows") if manifest else None, df)
            origin |= {"source_type": "state_marts", "format": "states", "states": ",".join(held)}
        else:
            at = dimension_url(source, "manifest")
            manifest = manifest or (build_manifest(spark, at) if exists(spark, at) else None)
            if path is not None:
                staged = _staged(spark, [dimension_url(source, format)], path, manifest or {}, overwrite)
                write_log(path, staged, "dimension")
                if staged[0].status == "failed":
                    raise OSError(staged[0].error)
            df = read_file(spark, dimension_url(source, format) if path is None else staged[0].path, vars)
            origin |= {"source_type": f"unified_{format}", "format": format}
    origin |= {"vintage": (manifest or {}).get("vintage"), "whole": df}
    if ids is not None:
        if isinstance(ids, DataFrame):
            df = semi(df.withColumn(id, fold(quoted(id))), ids.select(fold(quoted(ids.columns[0])).alias("kept_id")), id)
        else:
            df = keep_entities(df, id, list(ids))
    return replace(prepare(df, vars, strict, id), origin=origin)


def _states(spark: SparkSession, root: str, vars, states) -> tuple[DataFrame, list[str]]:
    asked = resolve_states(states)
    found = {s: at for s in asked if (at := state_file(spark, root, s)) is not None}
    if not found:
        raise ValueError(f"no state file of those asked for under {root}")
    if len(found) < len(asked):
        warnings.warn(f"state files left out, as they aren't there: {', '.join(s for s in asked if s not in found)}", stacklevel=3)
    return stack_states([read_file(spark, at, vars) for at in found.values()]), list(found)


def warn_lag(unified_rows: int | None, states: DataFrame) -> None:
    """State files may lag behind the unified one; with the number of its rows, they are counted."""
    if unified_rows is None:
        warnings.warn("the state files may be older than the unified file and hold fewer rows", stacklevel=3)
    elif (n := states.count()) < unified_rows:
        warnings.warn(f"the state files have {unified_rows - n} rows less than the unified file", stacklevel=3)

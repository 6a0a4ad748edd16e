"""A folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of each application that names none.
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names in ``spark.checkpoint.dir``; under a temporary one where none is set and all runs on one machine (tests).

    It is there, empty, and goes with all it holds when the driver's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext
        if app.master.startswith("local-cluster") or not app.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app.applicationId not in _folders:
            _folders[app.applicationId] = tempfile.mkdtemp(prefix="shared-")
        root = _folders[app.applicationId]
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    file_system.mkdirs(p)
    file_system.deleteOnExit(p)
    return path


def write_each(df: DataFrame, column: str, paths: dict[int, str], format: str = "parquet", **options) -> None:
    """Write the rows of each whole number of ``column`` in ``paths`` to its path, without the column: one scan, however many there are.

    Their folders are written side by side and take their names when all of them are there. Each must have rows, and no path may be taken.
    """
    if not paths:
        return
    spark = df.sparkSession
    new = spark._jvm.org.apache.hadoop.fs.Path
    at = f"{next(iter(paths.values())).rsplit('/', 1)[0]}/_parts-{uuid.uuid4().hex}"
    file_system = new(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for path in paths.values():
        if file_system.exists(new(path)):
            raise FileExistsError(path)
    df.where(df[column].isin(*paths)).write.partitionBy(column).format(format).options(**options).save(at)
    try:
        parts = {value: new(f"{at}/{column}={value}") for value in paths}
        if absent := [value for value, part in parts.items() if not file_system.exists(part)]:
            raise ValueError(f"no rows of {column} {', '.join(map(str, absent))}")
        for value, part in parts.items():
            if not file_system.rename(part, new(paths[value])):
                raise OSError(f"{part} could not be renamed to {paths[value]}")
    finally:
        file_system.delete(new(at), True)

"""Folders for intermediate tables, streams' checkpoints and committed stores.

All lie under the folder that spark.checkpoint.dir names, which driver and executors share.
They are deleted when the session's JVM ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of Hadoop for a path."""
    sc = spark.sparkContext
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(sc._jsc.hadoopConfiguration()), found


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder.

    Only where the session names none and runs on one machine a temporary one is set; on a
    cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="kinset-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    path = f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: its lineage ends there."""
    path = folder(df.sparkSession, name) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_kinset_core_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    home = tempfile.mkdtemp(prefix="kinset-code-")
    atexit.register(shutil.rmtree, home, True)
    code = shutil.make_archive(f"{home}/kinset_core", "zip", root.parent, root.name)
    sc.addPyFile(code)
    sc._kinset_core_shipped = True


def swap(spark: SparkSession, path: str, text: str) -> None:
    """Put text into a small file, whole: a reader sees what was there before or all of it."""
    jvm = spark.sparkContext._jvm
    fs, at = file_system(spark, path)
    _, new = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    full = fs.makeQualified(at)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), full, options)


def content(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where there is no file."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    source = fs.open(at)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()

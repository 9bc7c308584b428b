"""Shared helpers: the cluster's shared folder, cut lineage, table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the one that spark.checkpoint.dir names.

    Only where the session names none and all runs on one machine (tests), a temporary one
    is set. On a cluster that is an error: executors would not see the folder.
    """
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="kinset-")
        atexit.register(shutil.rmtree, named, True)
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def uri(folder: str) -> str:
    """The folder with its scheme, as file system libraries want it."""
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinset_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what `stored` wrote for these tables; nothing may read them any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._kinset_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as no column of df has."""
    taken = {c.lower() for c in df.columns}
    mark = "__"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_kinset_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="kinset-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "kinset_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._kinset_shipped = True


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions so that each holds about rows_each rows, at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))

"""Runs of many cells that go on where an earlier run ended."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinset.sources import writers

EVENT = "seq bigint, event string, cell string, build string"


def run(spark: SparkSession, folder: str, cells: dict[str, Callable[[SparkSession], DataFrame]], build: str) -> list[str]:
    """Write each cell's rows as Parquet to folder/cells/<name>; the names that were run now.

    A cell appears whole or not at all, so one that is there was finished and is kept. Every
    step is an event of its own file, which is never written again. Going on under another
    build than that of the first event is an error, as is a name that is no plain file name.
    """
    odd = [n for n in cells if not n.replace("_", "").replace("-", "").isalnum()]
    if odd:
        raise ValueError(f"names of cells must be letters, digits, - and _: {odd}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(f"{folder}/events"))
    known = events(spark, folder).orderBy("seq").collect()
    if known and known[0].build != build:
        raise ValueError(f"begun under build {known[0].build!r}, not {build!r}")
    seq = known[-1].seq + 1 if known else 0

    def note(event: str, cell: str) -> None:
        nonlocal seq
        out = fs.create(hadoop.Path(f"{folder}/events/{seq:012d}.json"), False)
        try:
            out.write(bytearray(json.dumps({"seq": seq, "event": event, "cell": cell, "build": build}).encode() + b"\n"))
        finally:
            out.close()
        seq += 1

    note("resumed" if known else "begun", "")
    done = []
    for name, rows in cells.items():
        target = f"{folder}/cells/{name}"
        if fs.exists(hadoop.Path(target)):
            continue
        fs.mkdirs(hadoop.Path(f"{folder}/cells"))
        note("started", name)
        try:
            writers.published(spark, target, lambda path, rows=rows: rows(spark).write.parquet(path))
        except Exception:
            note("failed", name)
            raise
        note("completed", name)
        done.append(name)
    note("ended", "")
    return done


def events(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, event, cell, build) of all runs so far."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(f"{folder}/events")

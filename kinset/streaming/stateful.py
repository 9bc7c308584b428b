"""Sketches over a stream of insertions and deletions, held as keyed state.

The state of a key is a list (its ranks, at most d) and a value (how far it has come). A
micro-batch's operations are applied in order of seq; one whose seq is not above the key's
last one came too late for its place in the fold: it is counted and left out. The state store
and the checkpoint make a stream that was stopped go on where it was: a batch that is run
again starts from the state before it, and the sink replaces what it had written for that
batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType

from kinset.sources import workspace
from kinset.streaming.dynamic import apply_one

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of files that one micro-batch takes.
BATCH_BYTES = 256 << 20


class BottomSketch(StatefulProcessor):
    """Keeps the d ranks of each key; see `dynamic.fold` for the step."""

    def __init__(self, d: int, names: list[str]):
        self.d, self.names = d, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranks = handle.getListState("ranks", "rank string")
        self.progress = handle.getValueState("progress", "last bigint, rebuild boolean, refused bigint, late bigint, ops bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, rebuild, refused, late, ops = self.progress.get() if self.progress.exists() else (None, False, 0, 0, 0)
        ranks = [r[0] for r in self.ranks.get()] if self.ranks.exists() else []
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, op, rank in zip(batch["seq"].tolist(), batch["op"].tolist(), batch["rank"].tolist()):
            if last is not None and seq <= last:
                late += 1
                continue
            last, ops = seq, ops + 1
            refused += bool(rebuild)
            ranks, rebuild = apply_one(ranks, bool(rebuild), op, rank, self.d)
        if ranks:
            self.ranks.put([(r,) for r in ranks])
        else:
            self.ranks.clear()
        self.progress.update((last, bool(rebuild), refused, late, ops))
        yield pd.DataFrame([[*key, ranks, bool(rebuild), refused, late, ops]], columns=self.names)

    def close(self) -> None:
        pass


def sketched(events: DataFrame, by: list[str], d: int) -> DataFrame:
    """A streaming (by.., seq, op, rank) to a row for each key of a batch: its state after it."""
    workspace.ship(events.sparkSession)
    schema = events.select(*by).schema.add("ranks", ArrayType(StringType())).add("rebuild", BooleanType())
    for name in ("refused", "late", "ops"):
        schema = schema.add(name, LongType())
    rows = events.select(*by, "seq", "op", "rank")
    return rows.groupBy(*by).transformWithStateInPandas(BottomSketch(d, schema.names), schema, "Update", "None")


def run(out: DataFrame, to: str, checkpoint: str) -> None:
    """Run a stream over what has arrived, then stop; each batch is a folder of its own.

    A batch that is run again replaces its folder, so nothing is written twice.
    """
    spark = out.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        query = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if held is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


def newest(spark: SparkSession, to: str, by: list[str]) -> DataFrame:
    """Each key's row of the last batch that had it."""
    rows = spark.read.option("basePath", to).parquet(f"{to}/batch=*")
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in names if c not in by]), "batch").alias("s")).select(*by, "s.*")


def replayed(events: DataFrame, by: list[str], d: int, slices: int = 4, stop_after: int = 2) -> DataFrame:
    """The sketches of a stored table of events (by.., seq, op, rank), played as a stream.

    The table arrives as files in order of seq; the stream runs over the first ones, stops,
    and a new one goes on from its checkpoint over the rest.
    """
    spark = events.sparkSession
    home = workspace.folder(spark, "stream")
    cut = events.agg(F.percentile_approx("seq", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    bounds = [None, *cut, None]

    def arrive(lo: int | None, hi: int | None) -> None:
        part = events if lo is None else events.where(F.col("seq") > lo)
        part = part if hi is None else part.where(F.col("seq") <= hi)
        part.write.mode("append").parquet(f"{home}/in")

    def go_on() -> None:
        stream = spark.readStream.schema(events.schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{home}/in")
        run(sketched(stream, by, d), f"{home}/out", f"{home}/checkpoint")

    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:]), 1):
        arrive(lo, hi)
        if k == stop_after:
            go_on()
    go_on()
    return newest(spark, f"{home}/out", by)

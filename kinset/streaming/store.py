"""A store of versions that is committed batch by batch.

A batch writes a folder of its own, with the versions it brought and what became of each
update, and then swaps one small file, the pointer, which names the folders of the store and
the last batch. Until the swap nothing of a batch is seen; after it all is. A batch whose number
is not above the pointer's was committed before, so running it again changes nothing; what a
killed attempt left in its folder is named by no pointer. A reader follows one pointer, so
it sees all owners at one version of the store. After ``COMPACT`` batches the next one writes
the store whole.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.sources import workspace
from kinset.streaming import dynamic
from kinset.streaming.versions import APPLIED, replace_versions

COMPACT = 16
FIELDS = ("owner", "epoch", "payload")


@dataclass(frozen=True)
class Pointer:
    """What one version of the store consists of."""

    batch: int
    parts: tuple[str, ...]
    logs: tuple[str, ...]


class VersionStore:
    """Versions (owner, epoch, payload) in a folder that driver and executors share.

    One writer at a time, as Spark's streams are; any number of readers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def pointer(self) -> Pointer | None:
        found = workspace.content(self.spark, f"{self.path}/current")
        if found is None:
            return None
        read = json.loads(found)
        return Pointer(read["batch"], tuple(read["parts"]), tuple(read["logs"]))

    def _commit(self, pointer: Pointer) -> None:
        workspace.swap(self.spark, f"{self.path}/current", json.dumps({"batch": pointer.batch, "parts": pointer.parts, "logs": pointer.logs}))

    def create(self, initial: DataFrame) -> None:
        """Begin with initial (owner, epoch, payload); a store that exists is left as it is."""
        if self.pointer() is None:
            part = f"initial-{uuid.uuid4().hex}"
            initial.select("owner", F.col("epoch").cast("bigint").alias("epoch"), "payload").write.parquet(f"{self.path}/{part}")
            self._commit(Pointer(-1, (part,), ()))

    def read(self, at: Pointer | None = None) -> DataFrame:
        """Every owner's latest version, all as of one pointer."""
        at = at or self.pointer()
        if at is None:
            raise ValueError(f"there is no store at {self.path}")
        return dynamic.latest(self.spark.read.parquet(*[f"{self.path}/{p}" for p in at.parts]))

    def log(self) -> DataFrame | None:
        """What became of each update so far: (owner, seq, status, epoch, payload)."""
        at = self.pointer()
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in at.logs]) if at and at.logs else None

    def apply(self, updates: DataFrame, batch: int) -> bool:
        """Commit updates (owner, seq, expected, epoch, payload) as one batch; False if it was."""
        at = self.pointer()
        if at is None:
            raise ValueError(f"there is no store at {self.path}")
        if batch <= at.batch:
            return False
        name = f"batch-{batch}-{uuid.uuid4().hex}"
        now = self.read(at)
        replace_versions(now, updates).write.parquet(f"{self.path}/{name}/log")
        log = self.spark.read.parquet(f"{self.path}/{name}/log")
        brought = log.where(F.col("status") == APPLIED).groupBy("owner").agg(F.max(F.struct("epoch", "payload")).alias("v")).select("owner", "v.*")
        parts = (*at.parts, f"{name}/versions")
        if len(parts) > COMPACT:
            brought, parts = dynamic.latest(now.unionByName(brought)), (f"{name}/versions",)
        brought.write.parquet(f"{self.path}/{name}/versions")
        self._commit(Pointer(batch, parts, (*at.logs, f"{name}/log")))
        return True

    def refresh(self, owner: str, expected: int, payload: str) -> str:
        """Replace one owner's version by its successor; the others stay. Returns the status."""
        at = self.pointer()
        kind = self.read(at).schema["owner"].dataType.simpleString()
        update = self.spark.createDataFrame([(owner, 0, expected, expected + 1, payload)], f"owner {kind}, seq bigint, expected bigint, epoch bigint, payload string")
        self.apply(update, at.batch + 1)
        last = self.spark.read.parquet(f"{self.path}/{self.pointer().logs[-1]}")
        return last.first()["status"]

    def snapshot(self, a: str, b: str) -> DataFrame:
        """Both owners' latest versions at one version of the store; see `dynamic.snapshot`."""
        at = self.pointer()
        return dynamic.snapshot(self.spark.read.parquet(*[f"{self.path}/{p}" for p in at.parts]), a, b)


def follow(updates: DataFrame, store: VersionStore, checkpoint: str) -> None:
    """Run a stream of updates (owner, seq, expected, epoch, payload) into the store, then stop.

    The stream's batch number is the store's: a batch that Spark runs again after a failure is
    known by it.
    """
    query = updates.writeStream.foreachBatch(lambda batch, number: store.apply(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

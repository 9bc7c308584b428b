"""Compare-and-set updates of a store of versions, for owners of any number of updates.

An update applies where it expects its owner's epoch and brings the next one; so on epochs it
is the map of one number to its successor, and a run of updates is a partial map, too. The
updates are cut into blocks by (owner, seq). Where an owner spans several blocks, the maps of
its blocks are made side by side and composed up a binary tree; going down the tree gives
every block the epoch that it begins with. Then all blocks run side by side. A task keeps one
block's map or one epoch, never an owner's history, and an owner with a third of all updates
is spread over a third of the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from kinset.sources.workspace import ship, stored

APPLIED, STALE, FUTURE = "applied", "stale_epoch", "future_epoch"
UNKNOWN, NO_SUCCESSOR = "unknown_owner", "not_successor"


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, bool, list]]:
    """(key, whether it is new, its rows' other columns) along sorted batches."""
    last = None
    for batch in batches:
        rows = list(zip(*[c.to_pylist() for c in batch.columns]))
        at = 0
        while at < len(rows):
            key, to = rows[at][:keys], at
            while to < len(rows) and rows[to][:keys] == key:
                to += 1
            yield key, key != last, [r[keys:] for r in rows[at:to]]
            last, at = key, to


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def block_maps(valid: DataFrame) -> DataFrame:
    """(owner, node, entry, leaves): the epochs that a block changes, and to what.

    valid holds (owner, node, seq, expected) of updates that bring the successor of what they
    expect; read from the last to the first, each puts itself before what follows it.
    """
    ship(valid.sparkSession)
    owner = valid.schema["owner"].dataType
    schema = StructType().add("owner", owner).add("node", LongType()).add("entry", LongType()).add("leaves", LongType())

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, goes, kind = None, {}, None

        def done() -> pa.RecordBatch:
            fields = [("owner", kind), ("node", pa.int64()), ("entry", pa.int64()), ("leaves", pa.int64())]
            return _batch([(*now, e, x) for e, x in goes.items()], pa.schema(fields))

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for key, new, rows in _runs(typed(), 2):
            if new and now is not None:
                yield done()
                goes = {}
            now = key
            for _, expected in rows:
                goes[expected] = goes.get(expected + 1, expected + 1)
        if now is not None:
            yield done()

    back = valid.select("owner", "node", "seq", "expected").repartition("owner", "node").sortWithinPartitions("owner", "node", F.desc("seq"))
    return back.mapInArrow(maps, schema)


def composed(maps: DataFrame) -> DataFrame:
    """The maps of neighbouring nodes 2n and 2n + 1, one after the other, as maps of nodes n."""
    half = F.floor(F.col("node") / 2).alias("node")
    first = maps.where("node % 2 = 0").select("owner", half, "entry", "leaves")
    second = maps.where("node % 2 = 1").select("owner", half, "entry", "leaves")
    through = first.join(second.select("owner", "node", F.col("entry").alias("leaves"), F.col("leaves").alias("on")), ["owner", "node", "leaves"], "left")
    both = through.select("owner", "node", "entry", F.coalesce("on", "leaves").alias("leaves"))
    return both.unionByName(second.join(first, ["owner", "node", "entry"], "left_anti"))


def block_entries(ends: DataFrame, maps: DataFrame, store: DataFrame, span: int) -> DataFrame:
    """(owner, block, entry): the epoch with which each block of the owners in ends begins.

    ends holds (owner, lo, hi), the first and last block of owners that span several, and span
    is the most blocks that one spans; for owners that the store lacks entry is null, so that
    each of their blocks has its row, too.
    """
    levels = [stored(maps, "maps")]
    while 1 << len(levels) < span:
        levels.append(stored(composed(levels[-1]), "maps"))
    now = ends.join(store.select("owner", F.col("epoch").cast("bigint").alias("entry")), "owner", "left").select("owner", F.lit(0).cast("bigint").alias("node"), "entry")
    for level in reversed(levels):
        left = level.where("node % 2 = 0").select("owner", F.floor(F.col("node") / 2).alias("node"), "entry", "leaves")
        right = now.join(left, ["owner", "node", "entry"], "left").select("owner", (F.col("node") * 2 + 1).alias("node"), F.coalesce("leaves", "entry").alias("entry"))
        now = now.select("owner", (F.col("node") * 2).alias("node"), "entry").unionByName(right)
        # one row for each block that these owners span and its neighbour
        now = stored(now.join(ends, "owner").where(F.col("node") * (1 << levels.index(level)) <= F.col("hi") - F.col("lo")).select("owner", "node", "entry"), "entries")
    return now.join(ends, "owner").select("owner", (F.col("lo") + F.col("node")).cast("int").alias("block"), "entry")


def _played(rows: DataFrame) -> DataFrame:
    """Updates of blocks with their status and what stands after them; see replace_versions.

    Each (owner, block) begins with a head that has its epoch and, in an owner's first block,
    the payload; inherits is true where the payload is that of an earlier block.
    """
    ship(rows.sparkSession)
    schema = StructType().add("owner", rows.schema["owner"].dataType).add("block", rows.schema["block"].dataType).add("seq", LongType()).add("status", StringType()).add("epoch", LongType()).add("payload", rows.schema["payload"].dataType).add("inherits", "boolean")

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        epoch, payload, inherits = None, None, False
        for batch in batches:
            out = []
            for (block, owner), _, rows in _runs(iter([batch]), 2):
                for head, seq, expected, successor, new, begins in rows:
                    if head == 0:
                        epoch, payload, inherits = expected, new, bool(begins)
                        continue
                    if epoch is None:
                        status = UNKNOWN
                    elif expected is None or successor is None or successor != expected + 1:
                        status = NO_SUCCESSOR
                    elif expected != epoch:
                        status = STALE if expected < epoch else FUTURE
                    else:
                        status, epoch, payload, inherits = APPLIED, successor, new, False
                    out.append((owner, block, seq, status, epoch, payload, inherits))
            kinds = batch.schema
            fields = [("owner", kinds.field("owner").type), ("block", kinds.field("block").type), ("seq", pa.int64()), ("status", pa.string()), ("epoch", pa.int64()), ("payload", kinds.field("payload").type), ("inherits", pa.bool_())]
            yield _batch(out, pa.schema(fields))

    ordered = rows.repartition("block", "owner").sortWithinPartitions("block", "owner", "head", "seq", "expected", "successor", "payload")
    return ordered.select("block", "owner", "head", "seq", "expected", "successor", "payload", "begins").mapInArrow(play, schema)


def replace_versions(store: DataFrame, updates: DataFrame, blocks: int | None = None) -> DataFrame:
    """Updates (owner, seq, expected, epoch, payload) against store (owner, epoch, payload).

    In order of seq, an update is applied where expected is the owner's epoch and its own
    epoch is the next; else it is stale or from the future. One row per update, with the
    status and the owner's epoch and payload after it. Unknown owners are unknown_owner,
    epochs that do not follow (or are null) are not_successor. blocks defaults to the
    session's number of shuffle partitions. An owner has one row in store; updates of equal
    owner and seq go in order of expected, epoch and payload.
    """
    spark = updates.sparkSession
    number = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = lambda c: F.col(c).cast("bigint")
    rows = updates.select("owner", long("seq").alias("seq"), long("expected").alias("expected"), long("epoch").alias("successor"), "payload")
    placed = stored(rows.repartitionByRange(number, "owner", "seq").withColumn("block", F.spark_partition_id()), "updates")
    # at most one owner for each bound between blocks
    bounds = placed.groupBy("owner").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    ends = stored(bounds.where("lo < hi"), "ends")
    span = ends.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0]
    firsts = bounds.join(store.select("owner", long("epoch").alias("entry"), "payload"), "owner", "left")
    heads = firsts.select("owner", F.col("lo").alias("block"), "entry", F.col("payload").cast(updates.schema["payload"].dataType).alias("payload"), F.lit(False).alias("begins"))
    if span:
        valid = placed.join(F.broadcast(ends), "owner").where("successor = expected + 1").select("owner", (F.col("block") - F.col("lo")).cast("bigint").alias("node"), "seq", "expected")
        later = block_entries(ends, block_maps(valid), store, span).join(ends.select("owner", "lo"), "owner").where("block > lo")
        heads = heads.unionByName(later.select("owner", "block", "entry", F.lit(None).cast(heads.schema["payload"].dataType).alias("payload"), F.lit(True).alias("begins")))
    empty = F.lit(None).cast("bigint")
    first = heads.select("owner", "block", F.lit(0).alias("head"), empty.alias("seq"), F.col("entry").alias("expected"), empty.alias("successor"), "payload", "begins")
    played = _played(first.unionByName(placed.select("owner", "block", F.lit(1).alias("head"), "seq", "expected", "successor", "payload", F.lit(False).alias("begins"))))
    names = ["owner", "seq", "status", "epoch", "payload"]
    if not span:
        return played.select(*names)
    played = stored(played, "played")
    # at most one row for each block of the owners in ends
    last = played.join(F.broadcast(ends), "owner").where(F.col("status") == APPLIED).groupBy("owner", "block").agg(F.max_by("payload", "epoch").alias("payload"), F.max("epoch").alias("epoch"))
    start = ends.join(store, "owner").select("owner", (F.col("lo") - 1).alias("block"), F.col("payload").cast(heads.schema["payload"].dataType).alias("payload"), long("epoch").alias("epoch"))
    # the payload of an epoch: an owner reaches each epoch once
    reached = last.unionByName(start).select(F.col("owner").alias("__owner"), F.col("epoch").alias("__epoch"), F.col("payload").alias("__earlier"))
    same = (F.col("owner") == F.col("__owner")) & F.col("epoch").eqNullSafe(F.col("__epoch"))
    taken = played.where("inherits").join(reached, same, "left").select("owner", "seq", "status", "epoch", F.col("__earlier").alias("payload"))
    return played.where("NOT inherits").select(*names).unionByName(taken)

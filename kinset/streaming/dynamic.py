"""Sketches under insertions and deletions, and a store of versions.

Batch: an ordered fold of each coordinate's operations in one array expression. Stream: the
same step function over keyed state. The step keeps what the fold's definition says: after
deletions have shortened a full sketch, any new rank is taken, though a trimmed one may be
smaller.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType

from kinset.streaming.versions import APPLIED, FUTURE, STALE, replace_versions

__all__ = ["APPLIED", "FUTURE", "STALE", "replace_versions"]


def fold(ops: Column, d: int) -> Column:
    """struct(ranks, rebuild, refused) after array ops of struct(seq, op, rank), ordered by seq.

    op is 'insert' or 'delete'. A coordinate that a deletion empties asks for a rebuild;
    what comes later is refused and counted.
    """
    start = F.struct(F.array().cast("array<string>").alias("ranks"), F.lit(False).alias("rebuild"), F.lit(0).cast("bigint").alias("refused"))

    def step(acc: Column, o: Column) -> Column:
        ranks, w = acc["ranks"], o["rank"]
        takes = ~F.array_contains(ranks, w) & ((F.size(ranks) < d) | (w < F.element_at(ranks, -1)))
        inserted = F.when(takes, F.slice(F.array_sort(F.concat(ranks, F.array(w))), 1, d)).otherwise(ranks)
        removed = F.array_remove(ranks, w)
        to = F.when(o["op"] == "insert", inserted).otherwise(removed)
        emptied = (o["op"] == "delete") & (F.size(ranks) > 0) & (F.size(removed) == 0)
        return F.struct(F.when(acc["rebuild"], ranks).otherwise(to).alias("ranks"), (acc["rebuild"] | emptied).alias("rebuild"), (acc["refused"] + acc["rebuild"].cast("bigint")).alias("refused"))

    return F.aggregate(ops, start, step)


def folded(events: DataFrame, by: list[str], d: int) -> DataFrame:
    """Rows (by.., seq, op, rank) folded per group, in order of seq."""
    ops = F.array_sort(F.collect_list(F.struct("seq", "op", "rank")))
    return events.groupBy(*by).agg(fold(ops, d).alias("state")).select(*by, "state.*")


def apply_one(ranks: list[str], rebuild: bool, op: str, rank: str, d: int) -> tuple[list[str], bool]:
    """One step of the fold on plain values, for the streaming form."""
    if rebuild:
        return ranks, True
    if op == "insert":
        if rank not in ranks and (len(ranks) < d or rank < ranks[-1]):
            ranks = sorted([*ranks, rank])[:d]
        return ranks, False
    left = [r for r in ranks if r != rank]
    return left, bool(ranks) and not left


def stream(events: DataFrame, by: list[str], d: int, time: str = "ts") -> DataFrame:
    """A streaming frame (by.., time, seq, op, rank) to one row per group and batch: its sketch.

    Rows of a batch are applied in order of seq. Events later than the frame's watermark
    are dropped by Spark where one is set; that rule is ours.
    """
    schema = events.select(*by).schema.add("ranks", ArrayType(StringType())).add("rebuild", BooleanType()).add("ops", LongType())
    state = "ranks array<string>, rebuild boolean, ops bigint"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        ranks, rebuild, ops = held.get if held.exists else ([], False, 0)
        ranks = list(ranks)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for op, rank in zip(rows["op"], rows["rank"]):
            ranks, rebuild = apply_one(ranks, bool(rebuild), op, rank, d)
            ops += 1
        held.update((ranks, bool(rebuild), int(ops)))
        yield pd.DataFrame([[*key, ranks, bool(rebuild), int(ops)]], columns=schema.names)

    return events.groupBy(*by).applyInPandasWithState(step, schema, state, "update", GroupStateTimeout.NoTimeout)


def signature(state: Column) -> Column:
    """The signature's value at a coordinate: the first rank of its state; null where there is none."""
    return F.get(state, F.lit(0))


def rebuilt(states: DataFrame, members: DataFrame, by: list[str], d: int) -> DataFrame:
    """states (by.., ranks, rebuild, refused), those that ask for a rebuild made anew.

    members (by.., rank) are the current ones; the d least different ranks of a group become
    its state. A group without members has an empty state and asks on.
    """
    asks = states.where("rebuild").select(*by)
    least = members.join(asks, by, "left_semi").select(*by, "rank").distinct()
    place = F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
    made = least.withColumn("__place", place).where(F.col("__place") <= d).groupBy(*by).agg(F.array_sort(F.collect_list("rank")).alias("__made"))
    none = F.array().cast("array<string>")
    joined = states.join(made, by, "left")
    ranks = F.when(F.col("rebuild"), F.coalesce("__made", none)).otherwise(F.col("ranks"))
    return joined.select(*by, ranks.alias("ranks"), (F.col("rebuild") & F.col("__made").isNull()).alias("rebuild"), F.when(F.col("rebuild"), F.lit(0).cast("bigint")).otherwise(F.col("refused")).alias("refused"))


def same_seed(sketches: DataFrame, seed: int, column: str = "seed") -> DataFrame:
    """sketches as they are; reading a row that was made under another seed is an error."""
    other = ~F.col(column).eqNullSafe(F.lit(seed))
    checked = F.when(other, F.raise_error(F.concat(F.lit(f"made under another seed than {seed}: "), F.coalesce(F.col(column).cast("string"), F.lit("none"))))).otherwise(F.col(column))
    return sketches.withColumn(column, checked.cast(sketches.schema[column].dataType))


def latest(store: DataFrame) -> DataFrame:
    """(owner, epoch, payload): each owner's version of the greatest epoch."""
    return store.groupBy("owner").agg(F.max(F.struct("epoch", "payload")).alias("v")).select("owner", "v.epoch", "v.payload")


def snapshot(store: DataFrame, a: str, b: str) -> DataFrame:
    """One row (epoch_a, payload_a, epoch_b, payload_b): both owners' latest versions, read at once.

    Where an owner has no version there is no row.
    """
    of = lambda owner, name: F.max(F.when(F.col("owner") == owner, F.struct("epoch", "payload"))).alias(name)
    both = store.where(F.col("owner").isin(a, b)).agg(of(a, "a"), of(b, "b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("epoch", "payload")])


def refreshed(store: DataFrame, owner: str, expected: int, payload: str) -> tuple[DataFrame, DataFrame]:
    """(store, status): one owner's version replaced by its successor, all others unchanged."""
    now = latest(store)
    update = store.sparkSession.createDataFrame([(owner, 0, expected, expected + 1, payload)], "owner string, seq bigint, expected bigint, epoch bigint, payload string")
    status = replace_versions(now.where(F.col("owner") == owner), update)
    new = status.where(F.col("status") == APPLIED).select("owner", "epoch", "payload")
    return now.join(new, "owner", "left_anti").unionByName(new.select(*[F.col(c).cast(now.schema[c].dataType) for c in now.columns])), status

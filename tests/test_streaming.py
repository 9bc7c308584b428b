import random

import pytest
from pyspark.sql import functions as F


from kinset.streaming import dynamic


def events(n=300):
    rng = random.Random(2)
    return [(rng.randrange(4), i, rng.choice(["insert", "insert", "delete"]), f"{rng.randrange(12):016x}") for i in range(n)]


def plain(rows, d):
    out = {}
    for k, _, op, rank in sorted(rows, key=lambda r: r[1]):
        ranks, rebuild = out.get(k, ([], False))
        out[k] = dynamic.apply_one(ranks, rebuild, op, rank, d)
    return out


def test_drift_after_deletion_is_kept(spark):
    ops = [(1, i, op, f"{r:016x}") for i, (op, r) in enumerate([("insert", 3), ("insert", 5), ("insert", 9), ("delete", 3), ("insert", 11)])]
    r = dynamic.folded(spark.createDataFrame(ops, "k long, seq long, op string, rank string"), ["k"], 2).first()
    assert [int(x, 16) for x in r.ranks] == [5, 11] and not r.rebuild
    more = [*ops, (1, 9, "delete", f"{5:016x}"), (1, 10, "delete", f"{11:016x}"), (1, 11, "insert", f"{1:016x}")]
    r = dynamic.folded(spark.createDataFrame(more, "k long, seq long, op string, rank string"), ["k"], 2).first()
    assert r.ranks == [] and r.rebuild and r.refused == 1


def test_fold_against_plain_python(spark):
    rows = events()
    got = {r.k: (r.ranks, r.rebuild) for r in dynamic.folded(spark.createDataFrame(rows, "k long, seq long, op string, rank string"), ["k"], 3).collect()}
    assert got == plain(rows, 3)


def test_stream_gives_the_fold(spark, tmp_path):
    rows = events()
    schema = "k long, seq long, op string, rank string"
    for i in range(3):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    last = {}

    def take(batch, _):
        for r in batch.collect():
            if r.ops >= last.get(r.k, (0,))[0]:
                last[r.k] = (r.ops, list(r.ranks), r.rebuild)

    q = dynamic.stream(stream, ["k"], 3).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {k: (r, b) for k, (_, r, b) in last.items()} == plain(rows, 3)


def test_epoch_store(spark):
    store = spark.createDataFrame([("a", 0, "p0"), ("b", 5, "q5")], "owner string, epoch long, payload string")
    updates = [("a", 1, 0, 1, "p1"), ("a", 2, 0, 1, "late"), ("a", 3, 4, 5, "early"), ("a", 4, 1, 3, "jump"), ("a", 5, 1, 2, "p2"), ("b", 1, 5, 6, "q6"), ("c", 1, 0, 1, "x")]
    got = dynamic.replace_versions(store, spark.createDataFrame(updates, "owner string, seq long, expected long, epoch long, payload string"))
    assert {(r.owner, r.seq): (r.status, r.epoch, r.payload) for r in got.collect()} == {
        ("a", 1): ("applied", 1, "p1"),
        ("a", 2): ("stale_epoch", 1, "p1"),
        ("a", 3): ("future_epoch", 1, "p1"),
        ("a", 4): ("not_successor", 1, "p1"),
        ("a", 5): ("applied", 2, "p2"),
        ("b", 1): ("applied", 6, "q6"),
        ("c", 1): ("unknown_owner", None, None),
    }


def test_rebuild_signature_and_seed(spark):
    states = spark.createDataFrame([(1, [], True, 2), (2, ["b", "c"], False, 1), (3, [], True, 0)], "g int, ranks array<string>, rebuild boolean, refused bigint")
    members = spark.createDataFrame([(1, "d"), (1, "a"), (1, "a"), (1, "c"), (2, "a")], "g int, rank string")
    got = {r.g: r for r in dynamic.rebuilt(states, members, ["g"], 2).withColumn("sign", dynamic.signature(F.col("ranks"))).collect()}
    assert [(got[g].ranks, got[g].rebuild, got[g].refused, got[g].sign) for g in (1, 2, 3)] == [(["a", "c"], False, 0, "a"), (["b", "c"], False, 1, "b"), ([], True, 0, None)]
    sketches = spark.createDataFrame([(1, 42), (2, 42)], "g int, seed bigint")
    assert dynamic.same_seed(sketches, 42).count() == 2
    with pytest.raises(Exception, match="another seed"):
        dynamic.same_seed(sketches, 7).collect()


def test_snapshot_and_refresh(spark):
    store = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "owner string, epoch bigint, payload string")
    assert tuple(dynamic.snapshot(store, "a", "b").first()) == (2, "y", 5, "z")
    assert dynamic.snapshot(store, "a", "c").collect() == []
    for expected, status, epoch in ((2, "applied", 3), (1, "stale_epoch", 2), (4, "future_epoch", 2)):
        new, told = dynamic.refreshed(store, "a", expected, "w")
        assert told.first().status == status
        assert sorted((r.owner, r.epoch) for r in new.collect()) == [("a", epoch), ("b", 5)]

import random

import pytest

from kinset.plans import catalogue
from kinset.sources import workspace
from kinset.streaming import dynamic, stateful, store
from kinset.streaming.versions import replace_versions

from tests.test_versions import UPDATES, apart, made, plain, unknown  # noqa: F401

STORE = "owner string, epoch long, payload string"


def opened(spark, rows):
    out = store.VersionStore(spark, workspace.folder(spark, "store"))
    out.create(spark.createDataFrame(rows, STORE))
    return out


def read(s):
    return sorted(tuple(r) for r in s.read().collect())


def final(rows, updates):
    out = {o: (e, p) for o, e, p in rows}
    for line in map(eval, plain(rows, updates)):
        if line[2] == "applied" and line[3] > out[line[0]][0]:
            out[line[0]] = line[3:]
    return sorted((o, e, p) for o, (e, p) in out.items())


def test_batches_and_replays(spark, monkeypatch):
    monkeypatch.setattr(store, "COMPACT", 3)
    rows, updates = made(5, 900)
    s = opened(spark, rows)
    s.create(spark.createDataFrame([("x", 0, "not taken")], STORE))
    seen = []
    for n in range(5):
        batch = spark.createDataFrame(updates[n * 180 : (n + 1) * 180], UPDATES)
        assert s.apply(batch, n)
        seen.append(read(s))
        assert not s.apply(batch, n) and read(s) == seen[-1]
        assert seen[-1] == final(rows, updates[: (n + 1) * 180])
    assert not s.apply(spark.createDataFrame(updates[:180], UPDATES), 2)
    assert sorted(str(tuple(r)) for r in s.log().collect()) == plain(rows, updates)
    assert len(s.pointer().parts) <= 3


def test_unknown_owners_bring_no_version(spark, apart, monkeypatch):  # noqa: F811
    monkeypatch.setattr(store, "replace_versions", lambda now, updates: replace_versions(now, updates, 24))
    rows, updates = unknown()
    s = opened(spark, rows)
    assert s.apply(spark.createDataFrame(updates, UPDATES), 0)
    assert read(s) == final(rows, updates)


def test_a_killed_batch_leaves_nothing(spark, monkeypatch):
    rows, updates = made(6, 300)
    s, batch = opened(spark, rows), spark.createDataFrame(updates, UPDATES)
    before, pointer = read(s), s.pointer()
    with monkeypatch.context() as m:
        m.setattr(workspace, "swap", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            s.apply(batch, 0)
    assert s.pointer() == pointer and read(s) == before
    assert s.apply(batch, 0) and read(s) == final(rows, updates)


def test_readers_see_one_version(spark):
    rows = [("a", 1, "x"), ("b", 5, "z")]
    s = opened(spark, rows)
    old = s.pointer()
    s.apply(spark.createDataFrame([("a", 0, 1, 2, "y"), ("b", 1, 5, 6, "w")], UPDATES), 0)
    assert tuple(s.snapshot("a", "b").first()) == (2, "y", 6, "w")
    assert sorted(tuple(r) for r in s.read(old).collect()) == rows
    assert s.refresh("a", 2, "v") == "applied" and s.refresh("a", 2, "u") == "stale_epoch" and s.refresh("a", 9, "u") == "future_epoch"
    assert read(s) == [("a", 3, "v"), ("b", 6, "w")]


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    rows, updates = made(7, 400)
    s = opened(spark, rows)
    for n, part in enumerate((updates[:150], updates[150:260], updates[260:])):
        spark.createDataFrame(part, UPDATES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n != 1:
            source = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            store.follow(source, s, f"{tmp_path}/checkpoint")
    assert read(s) == final(rows, updates) and s.pointer().batch == 2


def test_sketch_stream_with_a_hot_key_and_late_rows(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(30), i, rng.choice(["insert", "insert", "delete"]), f"{rng.randrange(12):016x}") for i in range(600)]
    frame = spark.createDataFrame(rows, "k long, seq long, op string, rank string")
    got = {r.k: (list(r.ranks), r.rebuild, r.refused, r.late) for r in stateful.replayed(frame, ["k"], 3, slices=3, stop_after=1).collect()}
    assert got == {r.k: (list(r.ranks), r.rebuild, r.refused, 0) for r in dynamic.folded(frame, ["k"], 3).collect()}


def test_rows_that_come_after_their_place_are_counted(spark, tmp_path):
    schema = "k long, seq long, op string, rank string"
    for part in ([(1, 5, "insert", "b")], [(1, 3, "insert", "a"), (1, 6, "insert", "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stateful.run(stateful.sketched(stream, ["k"], 3), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert tuple(stateful.newest(spark, f"{tmp_path}/out", ["k"]).first()) == (1, ["b", "c"], False, 0, 1, 2)


def test_an_empty_stream_of_events(spark):
    empty = spark.createDataFrame([], "k long, seq long, op string, rank string")
    assert stateful.replayed(empty, ["k"], 3).collect() == []


def test_queries_are_registered():
    assert {"st2_bottom_stream", "st7_committed_store"} <= set(catalogue.QUERIES) & set(catalogue.ORACLES)

import random

import pytest

from kinset.streaming import versions


def plain(store, updates):
    now, out = {o: (e, p) for o, e, p in store}, []
    for owner, seq, expected, epoch, payload in sorted(updates, key=lambda u: (u[0], u[1])):
        at = now.get(owner)
        if at is None:
            status = "unknown_owner"
        elif expected is None or epoch is None or epoch != expected + 1:
            status = "not_successor"
        elif expected != at[0]:
            status = "stale_epoch" if expected < at[0] else "future_epoch"
        else:
            status, now[owner] = "applied", (epoch, payload)
        out.append((owner, seq, status, *now.get(owner, (None, None))))
    return sorted(map(str, out))


def made(seed, n=3000):
    """A third of all updates are of one owner, whose epochs go far."""
    rng = random.Random(seed)
    epochs, out = {}, []
    for seq in range(n):
        owner = "hot" if rng.random() < 0.4 else f"o{rng.randrange(60)}"
        at = epochs.get(owner, 0)
        expected = max(0, at + rng.choice([0, 0, 0, 0, -1, 1, -5]))
        epoch = expected + (1 if rng.random() < 0.95 else 2)
        if expected == at and epoch == at + 1:
            epochs[owner] = epoch
        out.append((owner, seq, expected if rng.random() < 0.99 else None, epoch, f"v{seq}"))
    store = [("hot", 0, "start"), *[(f"o{k}", 0 if k % 5 else 2, f"s{k}") for k in range(55)]]
    return store, out


UPDATES = "owner string, seq long, expected long, epoch long, payload string"


@pytest.mark.parametrize("seed,blocks", [(1, 16), (2, 5), (3, 1), (4, 64)])
def test_against_plain_fold(spark, seed, blocks):
    store, updates = made(seed)
    got = versions.replace_versions(spark.createDataFrame(store, "owner string, epoch long, payload string"), spark.createDataFrame(updates, UPDATES), blocks)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(store, updates)


def test_one_owner_only_and_no_rows(spark):
    store = spark.createDataFrame([(7, 3, "a")], "owner long, epoch int, payload string")
    updates = [(7, k, 3 + k // 2, 4 + k // 2, str(k)) for k in range(500)]
    got = versions.replace_versions(store, spark.createDataFrame(updates, "owner long, seq int, expected int, epoch int, payload string"), 11)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain([(7, 3, "a")], updates)
    assert versions.replace_versions(store, spark.createDataFrame([], "owner long, seq int, expected int, epoch int, payload string")).collect() == []


def test_maps_compose_in_any_grouping(spark):
    """(f then g) then h is f then (g then h), and equals the updates played one by one."""
    rng = random.Random(9)
    blocks = [[rng.randrange(6) for _ in range(8)] for _ in range(4)]
    rows = [("x", b, k, e) for b, block in enumerate(blocks) for k, e in enumerate(block)]
    maps = versions.block_maps(spark.createDataFrame(rows, "owner string, node long, seq long, expected long"))
    whole = {r.entry: r.leaves for r in versions.composed(versions.composed(maps)).collect()}
    for epoch in range(8):
        at = epoch
        for block in blocks:
            for e in block:
                at += e == at
        assert whole.get(epoch, epoch) == at


@pytest.fixture
def apart(spark):
    """Small partitions stay apart, so blocks of an owner follow blocks of others."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def unknown(n=150):
    """Every second owner is unknown, and each spans several blocks; the known ones stop at epoch 2."""
    store = [(f"o{k}", k % 4, f"s{k}") for k in range(0, 8, 2)]
    expected = lambda k, q: q % 4 if k % 2 else q % 2
    return store, [(f"o{k}", q, expected(k, q), expected(k, q) + 1, f"v{k}-{q}") for k in range(8) for q in range(n)]


def test_unknown_owners_over_several_blocks(spark, apart):
    store, updates = unknown()
    got = versions.replace_versions(spark.createDataFrame(store, "owner string, epoch long, payload string"), spark.createDataFrame(updates, UPDATES), 24)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(store, updates)

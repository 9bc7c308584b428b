import random

import numpy as np
import xxhash

from kinset.llm import simhash


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = simhash.SHINGLE
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_trie_forest_is_the_link_graph():
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(12):
            x ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1)
            fps.add(x)
    fps = sorted(fps)
    cut = len(fps) // 3
    labels = simhash.trie_forest(np.array(fps, np.uint64), np.array([0, cut, len(fps)]))
    want = groups(fps[:cut]) + [cut + x for x in groups(fps[cut:])]
    assert labels.tolist() == want


def test_crowded_values_are_split_by_their_bits(spark, monkeypatch):
    """Fingerprints that all share their first bits, dense and linked in the rest."""
    rng = random.Random(4)
    fps = sorted({rng.getrandbits(11) | 0x7FF << 50 for _ in range(400)} | {rng.getrandbits(63) for _ in range(50)})
    monkeypatch.setattr(simhash, "UNIT_LEAVES", 64)
    got = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), len(fps))).collect()
    root = {r.node: r.root for r in got}
    assert [root.get(f, f) for f in fps] == [fps[g] for g in groups(fps)]


def test_finer_blocks_tile_the_rest():
    masks = [0]
    for left in (43, 29, 20, 14):
        masks = [f for m in masks for f in simhash.finer(m)]
        assert max(64 - m.bit_count() for m in masks) <= left
    a, b, c = simhash.finer(0xFF)
    assert a | b | c == 2**64 - 1 and a & b == b & c == 0xFF


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, root string, fp string, __id string, __text long")


def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    out, k = [], 0
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.randrange(1, 4)):
            copy = list(base)
            if rng.random() < 0.5:
                copy[rng.randrange(len(copy))] = "Changed"
            out.append((k, " \n".join(copy), "x", None))
            k += 1
    out += [(k, None, None, None), (k + 1, "", None, "y"), (k + 2, " \t ", None, "y"), (k + 3, "One", "z", "y"), (k + 4, "one\n", "z", "y"), (k + 5, "é ü " * 9000, "z", None)]
    return out


def test_query_against_brute_force(spark, monkeypatch):
    data = rows()
    want_fp = [brute(r[1]) for r in data]
    roots = groups(want_fp)
    want = {r[0]: (f"{f:016x}", data[g][0]) for r, f, g in zip(data, want_fp, roots)}
    for unit in (8192, 2):  # the second enters crowded subtries by more bits
        monkeypatch.setattr(simhash, "UNIT_LEAVES", unit)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(docs(spark, data)).collect()}
        assert got == want


def test_one_of_each_group_stays(spark):
    data = rows()
    roots = groups([brute(r[1]) for r in data])
    data += data[:2] + [(None, "a null id that has a text", None, None)]
    kept = simhash.drop_near_duplicates(docs(spark, data))
    assert kept.columns == ["doc_id", "text", "root", "fp", "__id", "__text"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(data[i][0]) for i in set(roots)] + ["None"])


def test_empty_table(spark):
    assert simhash.query(docs(spark, [])).collect() == []
    assert simhash.drop_near_duplicates(docs(spark, [])).collect() == []

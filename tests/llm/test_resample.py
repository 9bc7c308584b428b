import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd

from kinset.llm import bytetext, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def rows(seed=3, n=300):
    rng = random.Random(seed)
    words = ["the", "Cat", "naïve", "x" * 70, "日本", "o-n", "a1", "ÉA", "dog", "w" * 64, "v" * 65, "z"]
    out = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 19, 20, 21, 60])))) for k in range(n)]
    out += [(900 + k, "the cat naïve dog " * 8) for k in range(40)]
    out += [(7, "the dog " * 15)] * 30 + [(None, "z z " * 12)] * 3 + [(None, None), (950, ""), (951, " ,;\n"), (952, "a\x00b \x7fc " * 10)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "k", 2, "s") for r in data], "doc_id long, text string, score int, __w string, weight int, `a.b` string")


def targets(spark, texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "item_id string, text string")


def brute(data, texts, percent=5):
    def runs(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, text in data:
        for b in runs(text)[1]:
            s[b] += 1
    for text in texts:
        for b in runs(text)[1]:
            t[b] += 1
    S, T = float(s.sum()), float(t.sum())
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (S + 10000) / ((float(s[b]) + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, text in data:
        w, f = runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    order = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in out)


TEXTS = ["the cat dog dog", "naïve A1 日本", "", None, "x" * 70 + " the cat"]


def test_against_brute_force_and_sql(spark):
    data = rows()
    got = sorted(str(tuple(r)) for r in resample.query(frame(spark, data), targets(spark, TEXTS)).collect())
    assert got == brute(data, TEXTS)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": object}))
    con.register("benchmark", pd.DataFrame({"text": TEXTS}))
    assert sorted(map(str, con.execute(resample.ORACLE).fetchall())) == got


def test_many_equal_rows_are_numbered_in_spans(spark, monkeypatch):
    monkeypatch.setattr(resample, "COPIES", 7)
    data = [(1, "the dog cat z " * 6)] * 400 + [(k, "z " * 25) for k in range(2, 60)]
    scored = resample.scored(frame(spark, data), resample.learned_gains(frame(spark, data), targets(spark, TEXTS)))
    got = resample.ranked(scored, 50).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(data, TEXTS, 50)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 230))


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abÉ1", k=rng.choice([1, 3, 9, 80, 300]))) for _ in range(400))
    data = [(1, long), (2, "x" * 5000), (3, "a b " + "y" * 3000 + " c d e"), (4, "; ; " * 900 + "q r"), (5, long[:999])]
    monkeypatch.setattr(bytetext, "SLAB_BYTES", 1 << 20)
    whole = brute(data, [long[:300]])
    import pyarrow as pa

    column = pa.array([t for _, t in data])
    sums = lambda: [sum(int(np.bincount(f[f >= 0], minlength=10000) @ np.arange(10000)) for _, _, runs in resample._features(column, 10000) for f in runs), sum(int((f >= 0).sum()) for _, _, runs in resample._features(column, 10000) for f in runs)]
    want = sums()
    for size in (64, 257, 1000):
        monkeypatch.setattr(bytetext, "SLAB_BYTES", size)
        monkeypatch.setattr(bytetext.slabs, "__defaults__", (size,))
        assert sums() == want
    monkeypatch.setattr(bytetext.slabs, "__defaults__", (1 << 20,))
    assert sorted(str(tuple(r)) for r in resample.query(frame(spark, data), targets(spark, [long[:300]])).collect()) == whole


def test_drawn_rows(spark):
    data = rows(8)
    d = frame(spark, data)
    got = resample.drawn(d, targets(spark, TEXTS), 20)
    assert got.columns == d.columns
    want = [eval(x) for x in brute(data, TEXTS, 20)]
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in want if r[4])


def test_empty_tables(spark):
    assert resample.query(frame(spark, []), targets(spark, TEXTS)).collect() == []
    assert resample.drawn(frame(spark, []), targets(spark, TEXTS)).collect() == []
    data = rows(1, 50)
    assert sorted(str(tuple(r)) for r in resample.query(frame(spark, data), targets(spark, [])).collect()) == brute(data, [])

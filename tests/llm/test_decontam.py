import hashlib
import random
import re

from kinset.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for i, text, *_ in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(len(v), window)
            if not k:
                continue
            grams = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)}
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in grams:
                    hit |= set(range(p, p + k))
                    ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def tables(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "Béta", "gamma", "x1", "delta", "it", "of"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 30])))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "solo"), (2, items[7][1]), (103, "--")]
    docs = []
    for k in range(60):
        text = " ".join(rng.choice([*vocabulary, "other", "words"]) for _ in range(rng.randrange(60)))
        for _ in range(rng.randrange(3)):
            v = rng.choice(items)[1] or ""
            text += rng.choice([" ", ", ", "\n", "-"]) + v.upper()
        docs.append((k, text, "a", 1))
    docs += [(90, None, "a", 1), (91, "", None, None), (92, "Solo!", "a", 5), (92, "Solo!", "a", 5), (None, "it of", "b", 5), (93, "é" * 70000, "c", 1)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string, n_hit string, n_chars long"), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark, monkeypatch):
    docs, items, d, b = tables(spark)
    want = sorted(brute(docs, items), key=str)
    for words_each in (200_000, 40):  # the second needs several automata
        monkeypatch.setattr(decontam, "MODEL_WORDS", words_each)
        assert sorted(map(tuple, decontam.contamination(d, b).collect()), key=str) == want


def test_spans_go_and_the_rest_stays(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"Before. {passage.upper()}, after " + "more " * 20, "k", 7), (2, passage, "k", 7), (3, "clean text", "k", 7), (4, None, "k", 7)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_hit string, n_chars long")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = {r.doc_id: r for r in decontam.decontaminate(d, b).collect()}
    assert sorted(out) == [1, 3, 4]
    assert out[1].text == "Before. , after " + "more " * 20 and out[1].n_chars == len(out[1].text)
    assert out[3].text == "clean text" and out[3].n_chars == 7 and out[4].text is None


def test_empty_tables(spark):
    docs, items, d, b = tables(spark)
    assert decontam.contamination(d.limit(0), b).collect() == []
    assert not [r for r in decontam.contamination(d, b.limit(0)).collect() if r.contaminated]
    assert decontam.decontaminate(d, b.limit(0)).count() == len(docs)


def test_words_with_like_hashes_are_different(spark, monkeypatch):
    from tests.llm.test_linerules import twins

    a, b = twins()
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    docs = spark.createDataFrame([(1, b), (2, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_hit) for r in decontam.contamination(docs, items).collect()) == [(1, 0), (2, 1)]
    # words are compared by their bytes even where hashes meet
    import numpy as np

    from kinset.llm import bytetext as bt

    model = decontam.Model.of([("x", "alpha beta"), ("y", "gamma")])
    words = decontam.Words(next(bt.slabs(__import__("pyarrow").array(["delta alphb gamma"]))))
    monkeypatch.setattr(bt, "found_in", lambda keys, table: np.zeros(len(keys), np.int64))
    assert (model._numbers(words) >= 0).sum() <= 1


def test_long_items_are_cut_without_losing_a_window(spark, monkeypatch):
    """One item of many pieces, hit at the seams of its pieces, beside short ones and a null id."""
    monkeypatch.setattr(decontam, "PIECE_WORDS", 25)
    rng = random.Random(31)
    long = [f"w{rng.randrange(400)}" for _ in range(400)]
    items = [("long", " ".join(long)), ("short", "q1 q2 q3"), (None, "n1 " * 30), ("again", " ".join(long[100:140]))]
    docs = [(k, "pad " + " ".join(long[k : k + 10]) + " pad") for k in range(0, 391)] + [(900, " ".join(long)), (901, "q1 q2 q3"), (902, " ".join(long[5:14])), (903, "n1 " * 12)]
    got = {r.doc_id: r for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    for k in range(391):
        assert got[k].n_hit == 10 and got[k].n_items == (2 if 100 <= k <= 130 else 1), k
    assert (got[900].n_hit, got[900].n_items) == (400, 2) and got[901].n_items == 1
    assert not got[902].contaminated and got[903].n_hit == 12 and got[903].n_items == 0


def test_an_item_of_a_million_words_is_bounded(spark):
    long = " ".join(f"v{k % 49_999} w{k % 1_013}" for k in range(500_000))
    words = long.split(" ")
    docs = spark.createDataFrame([(1, " ".join(words[700_000:700_060])), (2, "v1 w2 v3")], "doc_id long, text string")
    items = spark.createDataFrame([("x", long)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.contamination(docs, items).collect()}
    assert got == {1: (60, 1), 2: (0, 0)}

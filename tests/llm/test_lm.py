import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinset.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toks(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "</s>"]


def brute(rows, priors):
    """Row results by dictionaries, and the model as a function of context and word."""
    train = [toks(t) for _, t, use in rows if use]
    seen, ctx = Counter(), Counter()
    order = len(priors) + 1
    for t in train:
        t = ["<s>", *t]
        for i in range(1, len(t)):
            seen[(t[i],)] += 1
            for k in range(1, order):
                if i - k >= 0:
                    seen[tuple(t[i - k : i + 1])] += 1
                    ctx[tuple(t[i - k : i])] += 1
    uni = {g[0]: c for g, c in seen.items() if len(g) == 1}
    n, v = sum(uni.values()), len(uni)
    once, twice = (sum(c == k for c in uni.values()) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05

    def p(context, w):
        if not context:
            return (uni[w] - d) / n if w in uni else (d * v / n if n else 1.0)
        k = priors[len(context) - 1]
        return (seen[(*context, w)] + k * p(context[1:], w)) / (ctx[context] + k)

    out = []
    for i, t, use in rows:
        t = toks(t)
        base = sum(math.log10((uni.get(w, 0) + 1) / (n + v + 1)) for w in t)
        padded = ["<s>", *t]
        whole = sum(math.log10(p(tuple(padded[max(0, j - order + 2) : j + 1]), w)) for j, w in enumerate(t))
        out.append((i, use, len(t), sum(w in uni for w in t), n, base, whole))
    return out, p, uni


def rows():
    rng = random.Random(8)
    vocabulary = ["The", "the", "a", "Ünder", "cat", "sat", "on", "mat", "dog,", "ran"]
    out = [(k, " \n".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))), rng.random() < 0.7) for k in range(90)]
    return out + [(200, "", True), (201, "never seen words", False), (202, "the cat " * 9000, True), (202, "the cat", True), (202, "the cat", True)]


@pytest.mark.parametrize("block_bytes, range_keys, priors", [(1 << 24, 1 << 20, lm.PRIORS), (9000, 60, (3.0, 0.5)), (9000, 400, (7.0,)), (9000, 400, (5.0, 2.0, 1.0))])
def test_against_dictionaries(spark, block_bytes, range_keys, priors):
    data = rows()
    df = spark.createDataFrame([(i, t, u, "x") for i, t, u in data] + [(None, None, True, "x")], "doc_id long, text string, train boolean, score string")
    got = lm.scored(df, F.col("train"), order=len(priors) + 1, priors=priors, block_bytes=block_bytes, range_keys=range_keys).collect()
    want, p, uni = brute([*data, (None, None, True)], priors)
    key = lambda r: (str(r[0]), r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_equal_texts_have_equal_scores_at_every_size(spark):
    """The same texts in blocks of other sizes, beside other texts: the same bits."""
    data = [(k, t, u) for k, t, u in rows()] + [(500 + k, "the cat sat on a mat, ran " * 300, False) for k in range(9)] + [(600 + k, "a cat sat", False) for k in range(50)]
    df = spark.createDataFrame(data, "doc_id long, text string, train boolean")
    for block_bytes, range_keys in ((1 << 24, 1 << 20), (9000, 60), (2000, 400)):
        got = lm.scored(df, F.col("train"), block_bytes=block_bytes, range_keys=range_keys).where("doc_id >= 500").collect()
        for low in (500, 600):
            assert len({(r.base_score, r.score) for r in got if low <= r.doc_id < low + 100}) == 1


def test_probabilities_sum_to_one():
    _, p, uni = brute(rows(), lm.PRIORS)
    for u in [("<s>",), ("the",), ("the", "cat"), ("unknown", "cat"), ("<s>", "the")]:
        assert sum(p(u, w) for w in [*uni, "unknown"]) == pytest.approx(1)


def test_words_with_like_hashes_are_different(spark):
    from tests.llm.test_linerules import twins

    a, b = twins()
    df = spark.createDataFrame([(1, a, True), (2, b, False)], "doc_id long, text string, train boolean")
    assert sorted((r.doc_id, r.n_known) for r in lm.scored(df, F.col("train")).collect()) == [(1, 2), (2, 1)]


def test_no_training_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, train boolean")
    r = lm.scored(df, F.col("train")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
    assert lm.scored(df.limit(0), F.col("train")).collect() == []

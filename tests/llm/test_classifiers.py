import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinset.llm import bytetext as bt
from kinset.llm import features, quality, toxicity
from kinset.llm.common import fold_of
from kinset.llm.learn import BoostedTrees, Isotonic


def corpus(n=900):
    """Rows (doc_id, text, label): one in four holds insults, plain or of an unknown kind."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("bel", "cor", "dan", "fil", "gur", "hos") for b in ("ta", "re", "nim", "os", "ul")]
    out = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(2 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "you moron", "zurgblat" + rng.choice("abc")]))
        out.append((k, " ".join(words).capitalize() + ".", int(bad)))
    return out


def tables(spark):
    data = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in data], "doc_id long, text string, score string, label string")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in data if i % 10] + [(None, 1, 1), (11, None, None)], "doc_id long, toxic int, quality int")
    return data, docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_on_held_out_rows(spark):
    data, docs, labels = tables(spark)
    got = {r.doc_id: r for r in toxicity.query(docs, labels).collect()}
    assert len(got) == len(data)
    right = [got[i].predicted == y for i, _, y in data if held(i)]
    assert np.mean(right) > 0.95
    for i, r in got.items():
        assert r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.3}


def test_held_out_labels_are_not_read(spark):
    data, docs, labels = tables(spark)
    flipped = labels.withColumn("toxic", F.when(fold_of(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(fold_of(F.col("doc_id"), 4) == 2, 0).otherwise(F.col("quality")))
    for query in (toxicity.query, quality.query):
        a, b = ({r.doc_id: r.score for r in query(docs, x).collect()} for x in (labels, flipped))
        assert a == pytest.approx(b, abs=1e-9)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(800):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(10, 80))]
        bad = rng.random() < 0.3
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        rows.append((k, text))
        labels.append((k, int(not bad)))
    got = {r.doc_id: r for r in quality.query(spark.createDataFrame([*rows, (None, None), (900, ""), (0, rows[0][1])], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert np.mean([got[i].predicted == y for i, y in labels if held(i)]) > 0.95
    assert 0 <= got[None].score <= 1 and got[900].score == pytest.approx(got[None].score)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edge_tables(spark, module):
    docs = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (2, "word " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1)], "doc_id long, toxic int, quality int")
    for known in (labels, one):
        got = module.query(docs, known).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert module.query(docs.limit(0), one).collect() == []


def test_isotonic_is_monotone_and_pools():
    x = np.arange(6.0)
    iso = Isotonic.fit(x, np.array([0, 1, 0, 1, 1, 1.0]))
    p = iso(np.linspace(-1, 7, 50))
    assert (np.diff(p) >= 0).all() and iso(np.array([1.5]))[0] == pytest.approx(0.5, abs=0.01)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = BoostedTrees().fit(x[:2000], y[:2000])
    assert np.mean((m.raw(x[2000:]) > 0) == y[2000:]) > 0.95


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", "One two.\nOne two.\n", None, "ÄB!! c@t #1 | x", "a a a b", " \n", "längere Zeile mit Wörtern, und so weiter"]
    whole = np.concatenate([features.statistics(s) for s in bt.slabs(pa.array(texts))])
    alone = np.concatenate([features.statistics(s) for t in texts for s in bt.slabs(pa.array([t], pa.string()))])
    assert np.array_equal(whole, alone)
    table, weight = np.sort(np.array([bt.text_hash("zeile")], np.uint64)), np.array([2.0])
    whole = np.concatenate([features.lexicon_features(s, table, weight) for s in bt.slabs(pa.array(texts))])
    alone = np.concatenate([features.lexicon_features(s, table, weight) for t in texts for s in bt.slabs(pa.array([t], pa.string()))])
    assert np.array_equal(whole, alone)
    assert whole[6][features.LEXICON.index("log_learned")] > 0
    row = np.concatenate([features.lexicon_features(s, table[:0], weight[:0]) for s in bt.slabs(pa.array(["You id1ot, what a m*r*n you are, you idiot and iiidiot"]))])[0]
    assert all(row[features.LEXICON.index(n)] > 0 for n in ("insults", "near_reader", "disguised", "masked", "stretched"))


def test_partition_sums_over_many_partitions(spark):
    """More partial sums than one round takes, against plain sums."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, quality.WIDTH)).astype(np.float32)
    y = rng.integers(0, 2, 400)
    rows = spark.createDataFrame([(v.tolist(), int(w)) for v, w in zip(x, y)], "x array<float>, label int").repartition(70)
    got = quality.partition_sums(rows, lambda a, b: np.concatenate([(a.T @ a).ravel(), a.T @ b]), quality.WIDTH**2 + quality.WIDTH)
    z = x.astype(np.float64)
    assert got == pytest.approx(np.concatenate([(z.T @ z).ravel(), z.T @ y]), rel=1e-9)


def test_ridge_scores_against_a_plain_solution(spark):
    """The fit on tables equals normal equations that are solved over all rows at once."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, quality.WIDTH)).astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.3).astype(int)
    stats = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id long, x array<float>")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(stats, labels)
    used = {tuple(r.x) for r in quality.training_rows(stats, labels, "quality").where("NOT calibrates").collect()}
    mine = np.array([tuple(v.tolist()) in used for v in x])
    a = x[mine].astype(np.float64)
    assert model.map.mean == pytest.approx(a.mean(axis=0), abs=1e-9)
    z = np.hstack([np.cos(np.clip((a - a.mean(axis=0)) / a.std(axis=0), -6, 6) @ model.map.w + model.map.b) * np.sqrt(2 / quality.FEATURES), np.ones((len(a), 1))])
    ridge = np.eye(quality.FEATURES + 1) * quality.RIDGE
    ridge[-1, -1] = 1e-6
    assert z @ model.weights == pytest.approx(z @ np.linalg.solve(z.T @ z + ridge, z.T @ y[mine]), abs=1e-6)


def test_trees_against_a_plain_search_of_the_first_split():
    """The root of the first tree is the cut of greatest gain among all cuts."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 3)).astype(np.float32)
    y = (x[:, 1] + rng.normal(size=300) > 6).astype(float)
    model = BoostedTrees(rounds=1, depth=1).fit(x, y)
    p = (y.sum() + 0.5) / 301
    g, h = y - p, np.full(300, p * (1 - p))
    gain = {}
    for j in range(3):
        for c in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= c
            if min(h[left].sum(), h[~left].sum()) >= 1:
                gain[j, c] = sum(g[m].sum() ** 2 / (h[m].sum() + 2) for m in (left, ~left))
    feature, cut, value = model.trees[0]
    best = max(gain, key=gain.get)
    assert feature[0] == best[0] and np.floor(cut[0]) == best[1]
    left = x[:, best[0]] <= best[1]
    assert value == pytest.approx([0.15 * g[m].sum() / (h[m].sum() + 2) for m in (left, ~left)])


def test_isotonic_against_the_min_max_formula():
    rng = np.random.default_rng(5)
    x, y = np.arange(40.0), rng.integers(0, 2, 40).astype(float)
    want = [max(min(y[a : b + 1].mean() for b in range(k, 40)) for a in range(k + 1)) for k in range(40)]
    iso = Isotonic.fit(x, y)
    sizes = np.unique(np.round(want, 9), return_counts=True)
    # a block's value has a pseudo-count each way
    assert np.sort(iso.y) == pytest.approx([(m * n + 0.1) / (n + 0.2) for m, n in zip(*sizes)], abs=1e-6)


def test_labelled_sample_keeps_its_share(spark):
    labels = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    whole = labels.where(fold_of(F.col("doc_id"), 4) != 2).count()
    for most in (3, 300, 5000, 100_000):
        n = toxicity.labelled_sample(labels, "toxic", max_rows=most).count()
        assert abs(n - min(most, whole)) <= 4 * most**0.5

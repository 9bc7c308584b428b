import random

import pytest

import corpus_pipeline
from kinset.llm import toxicity
from tests.llm import test_decontam, test_simhash


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ba", "de", "ki", "lo", "mu", "ne"]) for _ in range(rng.randrange(1, 4)))
    items = [(k, " ".join(word() for _ in range(25))) for k in range(6)]
    docs, labels = [], []
    for k in range(260):
        words = [word() for _ in range(rng.randrange(60, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), "you idiot")
        if rng.random() < 0.1:
            words[10:10] = items[k % 6][1].upper().split()
        if rng.random() < 0.1:
            words.insert(3, "mail me.%d@mail.example.com or 10.20.30.%d" % (k, k % 250))
        text = " ".join(words)
        docs.append((k, text, "en", rng.choice(["a", "a", "b", None]), len(text)))
        labels.append((k, 1, int(toxic)))
    docs += [(300 + i, d[1] + (" extra" if i % 2 else ""), "en", "b", 1) for i, d in enumerate(docs[:20])]
    docs += [(400, None, None, None, None), (401, "", "en", "c", 0), (402, items[0][1], "en", "c", 1)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns == documents.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii_surrogates", "mixing"]
    # toxicity: those below the threshold stay
    score = {r.doc_id: r.score for r in toxicity.query(documents, labels).collect()}
    assert set(kept["toxicity"]) == {i for i, s in score.items() if s < 0.3}
    toxic = {r.doc_id for r in labels.collect() if r.toxic}
    assert len(toxic & set(kept["toxicity"])) < 0.1 * len(toxic)
    # near-copies: the least id of each brute-force group stays
    rows = [(i, r.text) for i, r in sorted(kept["toxicity"].items())]
    roots = test_simhash.groups([test_simhash.brute(t) for _, t in rows])
    assert set(kept["near_duplicates"]) == {rows[g][0] for g in roots}
    # decontamination: nothing is hit any more, clean texts stay as they were
    hits = {r[0]: r for r in test_decontam.brute([(i, r.text) for i, r in kept["near_duplicates"].items()], items)}
    for i, r in kept["near_duplicates"].items():
        n, hit = hits[i][1:3]
        assert (i in kept["decontamination"]) == (2 * hit <= n or not hit)
        if i in kept["decontamination"]:
            new = kept["decontamination"][i].text
            assert new == r.text if not hit else len(test_decontam.words(new)) == n - hit
    # surrogates: no address is left, texts without one stay
    for i, r in kept["decontamination"].items():
        new = kept["pii_surrogates"][i].text
        assert ("mail." in (r.text or "")) == (new != r.text)
        assert "@mail.example.com" not in (new or "")
    # mixing: run() gives the same rows
    again = sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, folder).collect())
    assert again == sorted(str(tuple(r)) for r in docs.collect())
    assert {r.doc_id for r in docs.collect()} <= set(kept["pii_surrogates"])

"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinset.functions import hashing as H
from kinset.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the generated tables")


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return [normal(x) for x in v] if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in catalogue.ORACLES:
        assert rows
        return
    got = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = [[normal(v) for _, v in sorted(zip(names, r))] for r in got.fetchall()]
    have = [[normal(r[c]) for c in sorted(df.columns)] for r in rows]
    assert sorted(map(str, have)) == sorted(map(str, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_words_in_lower_case_without_folding(spark, tmp_path):
    """A letter that folding would write out parts words here, as in the SQL."""
    texts = ["Keitßber dem ertzheit erßch.", "Der geeinie deschheitchie auöß.", "one two three foİur", "a b c d Ｅ", "K b c d e", None]
    docs = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(docs)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{docs}/*.parquet'")
    want = sorted(c.execute(catalogue.ORACLES["flt1_empty_features"]).fetchall())
    assert sorted(tuple(r) for r in catalogue.QUERIES["flt1_empty_features"](spark, str(tmp_path)).collect()) == want


@pytest.fixture
def draws(monkeypatch):
    """How many tasks make each product that the least pairs are drawn from."""
    from kinset.operators import pairing

    tasks, least = [], pairing._least

    def counted(draw, *rest):
        tasks.append(draw(F.lit(True)).rdd.getNumPartitions())
        return least(draw, *rest)

    monkeypatch.setattr(pairing, "_least", counted)
    return tasks


@pytest.mark.parametrize("name,products", [("jn2_jn3_negative_sample", 1), ("jn5_unrelated_pairs", 1), ("tk3_pair_union", 2)])
def test_products_are_made_on_all_cores(spark, draws, name, products):
    """A small table is one file and one task; the pairs made of it are hashed by many."""
    catalogue.QUERIES[name](spark, SF).collect()
    assert len(draws) == products and min(draws) >= spark.sparkContext.defaultParallelism


def test_tasks_of_a_product_fill_whole_rounds(spark, draws, monkeypatch):
    """One task more than the cores have places for would leave all but one core idle."""
    from kinset.operators import pairing

    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(pairing, "TASK", 1000)
    left, right = spark.range(2 * cores + 1).withColumnRenamed("id", "a"), spark.range(1000).withColumnRenamed("id", "b")
    known = spark.createDataFrame([(0, 0)], "a long, b long")
    assert pairing.nonmatches(left, right, known, 5).count() == 5
    assert draws == [3 * cores]


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_least_pairs_however_the_sides_are_dealt(spark, monkeypatch, sent):
    from kinset.operators import pairing

    monkeypatch.setattr(pairing, "SENT", sent)
    r = spark.createDataFrame([(k, f"s{k % 3}" if k % 11 else "") for k in range(90)], "id long, subject string")
    want = pairing.related(r, "subject").orderBy("digest", "a", "b").limit(25).collect()
    assert pairing.least_related(r, "subject", 25).collect() == want
    x, y = r.select(F.col("id").alias("a"), F.col("subject").alias("k")).where("k <> ''"), r.select(F.col("id").alias("b"), F.col("subject").alias("l")).where("l <> ''")
    far = x.join(y, F.expr("a < b AND k <> l")).select("a", "b", H.pair_rank(F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"))
    assert pairing.unrelated(r, "subject", 25).collect() == far.orderBy("digest", "a", "b").limit(25).collect()
    none = pairing.least_related(r.where("id < 0"), "subject", 5)
    assert none.collect() == []


@pytest.mark.parametrize("holders", [0, 3, 1000])
def test_common_elements_however_many_hold_them(spark, holders):
    from kinset.operators import similarity

    rows = [(s, e) for s in range(12) for e in range(40) if e == 0 or (s * 7 + e) % (e % 5 + 2) == 0]
    sets = spark.createDataFrame(rows, "set_id long, element long")
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, min(a + 4, 13))], "a long, b long")
    want = {tuple(r) for r in similarity.overlaps(sets, pairs).where("inter > 0").select("a", "b", "inter").collect()}
    assert {tuple(r) for r in similarity.common(sets, pairs, holders).collect()} == want


@pytest.mark.parametrize("ids", [range(-5000, -10, 7), ()], ids=["negative", "none"])
def test_batches_take_updates_of_any_number(spark, tmp_path, ids):
    """Every update goes into one batch, also those numbered below 0; no updates are no error."""
    rows = [(k, k % 23) for k in ids]
    events = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(events)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/*.parquet'")
    want = sorted(c.execute(catalogue.ORACLES["st7_committed_store"]).fetchall())
    got = catalogue.QUERIES["st7_committed_store"](spark, str(tmp_path)).select("owner", "epoch", "payload", "versions")
    assert sorted(tuple(r) for r in got.collect()) == want

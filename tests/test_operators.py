import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from kinset.functions import hashing as H
from kinset.operators import bitmaps as B
from kinset.operators import deletion as D
from kinset.operators import generators as G
from kinset.operators import pairing as P
from kinset.operators import similarity as S
from kinset.operators import sketch as K
from kinset.operators import stats
from kinset.operators import threshold as R
from kinset.operators import validate as V
from kinset.plans import pipelines


def sets(spark):
    rng = random.Random(4)
    members = {i: sorted(rng.sample(range(60), rng.randrange(1, 40))) for i in range(12)}
    rows = [(i, e) for i, m in members.items() for e in m]
    return members, spark.createDataFrame(rows, "set_id long, element long")


def test_minhash_forms_agree(spark):
    _, s = sets(spark)
    want = sorted(map(tuple, K.minhash(s, 6).collect()))
    assert sorted(map(tuple, K.minhash(s, 6, shared=False).collect())) == want
    assert want == sorted(map(tuple, K.bottom(s, 6, 3).where("pos = 1").select("set_id", "coord", "rank").collect()))


@pytest.mark.parametrize("read", [1, 16])
def test_array_minhash_whatever_is_read(spark, read):
    """Ranks of sets that have no digest below their bound are those of all their digests."""
    rng = random.Random(8)
    members = {n: [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)] for n in (1, 2, 15, 16, 17, 90, 700)}
    rows = spark.createDataFrame(list(members.items()), "set_id long, elements array<long>")
    rank = lambda c, e: int.from_bytes(hashlib.sha256(H.MINHASH.encode() + (42).to_bytes(8, "big") + c.to_bytes(4, "big") + e.to_bytes(8, "big", signed=True)).digest()[:8], "big") - (1 << 63)
    want = {n: [min(rank(c, e) for e in m) for c in range(12)] for n, m in members.items()}
    assert {r.set_id: r.sketch for r in K.array_minhash(rows, 12, read=read).collect()} == want
    some = {r.set_id: r.sketch for r in K.array_minima(rows, 12, read=read).collect()}
    assert all(x in (None, y) for n in want for x, y in zip(some[n], want[n]))
    assert (None in some[90] + some[700]) == (read == 1)


def test_overlaps_at_steps_across_blocks(spark):
    rng = random.Random(9)
    members = {i: rng.sample(range(30), rng.randrange(1, 20)) for i in [*range(-140, 140), 1 << 40, (1 << 40) + 11, (1 << 40) + 63] if i % 7 != 3}
    rows = spark.createDataFrame(list(members.items()), "set_id long, elements array<long>")
    want = [(a, a + s, len({*members[a]} & {*members[a + s]}), len(members[a]), len(members[a + s])) for a in members for s in (1, 2, 11) if a + s in members]
    assert sorted(map(tuple, pipelines.overlaps(rows, (1, 2, 11)).collect())) == sorted(want)


def test_sketch_merges(spark):
    """The signature of a union is the element-wise minimum of its parts' signatures."""
    _, s = sets(spark)
    whole = K.minhash(s.select(F.lit(0).cast("long").alias("set_id"), "element").distinct(), 6)
    parts = K.minhash(s, 6).groupBy("coord").agg(F.min("rank").alias("rank"))
    assert sorted(map(tuple, whole.select("coord", "rank").collect())) == sorted(map(tuple, parts.collect()))


@pytest.mark.parametrize("on_empty", [0.0, 1.0, None])
def test_jaccard_edges(spark, on_empty):
    members, s = sets(spark)
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 14)] + [(12, 13)], "a long, b long")
    for r in S.overlaps(s, pairs).withColumn("j", S.jaccard(F.col("inter"), F.col("size_a"), F.col("size_b"), on_empty)).collect():
        a, b = set(members.get(r.a, ())), set(members.get(r.b, ()))
        assert (r.inter, r.size_a, r.size_b) == (len(a & b), len(a), len(b))
        assert r.j == (len(a & b) / len(a | b) if a | b else on_empty)


def test_corrected_is_clamped_and_labels_are_half_open(spark):
    rows = spark.createDataFrame([(0, 64), (1, 64), (64, 64), (32, 64)], "v long, k long")
    got = [r.c for r in rows.select(S.corrected(F.col("v"), F.col("k"), 64).alias("c")).collect()]
    assert got[0] == got[1] == 0 and got[2] == 1 and got[3] == pytest.approx((0.5 - 1 / 64) / (1 - 1 / 64))
    labels = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.3, 0.6, 1.0)], "j double").select(S.bucket_label(F.col("j")).alias("b")).collect()
    assert [r.b for r in labels] == ["b00_10", "b10_30", "b30_60", "b60_100", "b60_100"]


@pytest.mark.parametrize("n", [1, 2, 19, 20])
def test_error_summary(spark, n):
    values = [float(i) for i in range(1, n + 1)]
    r = stats.error_summary(spark.createDataFrame([("g", v) for v in values], "g string, x double"), ["g"], "x").first()
    assert (r.n, r.mae, r.median, r.p95, r.max) == (n, statistics.mean(values), statistics.median(values), values[math.ceil(0.95 * n) - 1], values[-1])
    if n == 1:
        assert r.sample_sd is None and r.ci95_low is None
    else:
        assert r.sample_sd == pytest.approx(statistics.stdev(values))
        assert r.ci95_high - r.mae == pytest.approx(1.96 * statistics.stdev(values) / math.sqrt(n))


def test_intervals(spark):
    rows = spark.createDataFrame([(0, 10), (10, 10), (3, 10), (0, 0)], "x long, n long")
    rate, low, high = stats.binomial_interval(F.col("x"), F.col("n"))
    got = [tuple(r) for r in rows.select(rate, low, high).collect()]
    assert got[0] == (0, 0, 0) and got[1] == (1, 1, 1) and got[3] == (None, None, None)
    assert got[2][1] == pytest.approx(0.3 - 1.96 * math.sqrt(0.021))
    with pytest.raises(Exception, match="degrees of freedom"):
        stats.t_interval(spark.range(40).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x")), ["g"], "x").collect()


def test_threshold_functions(spark):
    def of(c):
        return spark.range(1).select(c).first()[0]

    k = F.lit(128).cast("long")
    assert of(R.jaccard_of_tau(F.lit(76), k, 64)) == pytest.approx(0.5873015873015873, abs=1e-15)
    assert of(R.binomial_survival(k, F.lit(76), F.lit(0.59375))) == pytest.approx(0.5380497333771499, abs=1e-10)
    assert of(R.binomial_survival(k, F.lit(0), F.lit(0.3))) == 1 and of(R.binomial_survival(k, F.lit(129), F.lit(0.3))) == 0
    assert of(R.binomial_survival(k, F.lit(5), F.lit(0.0))) == 0 and of(R.binomial_survival(k, F.lit(5), F.lit(1.0))) == 1
    assert of(R.tau_of_jaccard(F.lit(0.0), k, 64)) == 2 and of(R.tau_of_jaccard(F.lit(1.0), k, 64)) == 128


def test_calibration_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.5)) for _ in range(60)]
    got = {round(r.threshold, 9): r for r in R.calibrate(spark.createDataFrame(rows, "j double, y int"), "j", "y").collect()}
    distinct = sorted({j for j, _ in rows})
    want = {*distinct, *[(a + b) / 2 for a, b in zip(distinct, distinct[1:])]}
    assert set(got) == {round(t, 9) for t in want}
    for t in want:
        r = got[round(t, 9)]
        assert r.tp == sum(j >= t and y for j, y in rows) and r.fp == sum(j >= t and not y for j, y in rows)
    best = min(got.values(), key=lambda r: (round(r.balanced, 12), -r.threshold))
    assert R.best(R.calibrate(spark.createDataFrame(rows, "j double, y int"), "j", "y")).first().threshold == best.threshold


def test_deletion_known_values(spark):
    curve = {r.r: r for r in D.survival_curve(spark, 5, 2, 1).collect()}
    assert curve[2].survival == pytest.approx(0.9) and curve[3].survival == pytest.approx(0.7)
    two = {r.r: r for r in D.survival_curve(spark, 5, 2, 2).collect()}
    assert two[3].survival == pytest.approx(0.49) and two[3].bound == pytest.approx(0.4)
    limits = D.deletion_limits(D.survival_curve(spark, 1024, 5, 128), 0.99).first()
    assert limits.max_safe == 156 and limits.expected_first_failure == pytest.approx(357.745231932978, abs=1e-6)


def test_simulation_fits_the_exact_mean(spark):
    exact = D.deletion_limits(D.survival_curve(spark, 40, 3, 4), 0.99).first().expected_first_failure
    r = D.simulate(spark, 40, 3, 4, 300).agg(F.avg("failure").alias("m"), F.stddev_samp("failure").alias("s")).first()
    assert abs(r.m - exact) < 4 * r.s / math.sqrt(300)


def test_generators(spark):
    grid = {(r.k, r.grid_index): r for r in G.threshold_grid(spark).collect()}
    assert len(grid) == 84
    for k, g, inter, uni in ((128, 0, 740, 1260), (64, -10, 655, 1345), (512, 10, 818, 1182)):
        assert (grid[k, g].inter, grid[k, g].uni) == (inter, uni)
    pair = G.set_pair(spark, 30, 12).groupBy("element").agg(F.collect_set("side").alias("s")).collect()
    assert sum(len(r.s) == 2 for r in pair) == 12 and sum("a" in r.s for r in pair) == sum("b" in r.s for r in pair) == 30


@pytest.mark.parametrize("seed", [1, 9])
def test_negative_sample_is_the_sorted_prefix(spark, seed):
    left, right = spark.range(9).select(F.col("id").alias("a")), spark.range(8).select((F.col("id") + 50).alias("b"))
    known = spark.createDataFrame([(1, 51), (2, 52)], "a long, b long")
    got = [(r.a, r.b) for r in P.nonmatches(left, right, known, 20, seed).orderBy("digest").collect()]
    every = left.crossJoin(right).select("a", "b", H.negative_rank(F.col("a").cast("string"), F.col("b").cast("string"), seed).alias("d")).collect()
    assert got == [(r.a, r.b) for r in sorted(every, key=lambda r: r.d) if (r.a, r.b) not in {(1, 51), (2, 52)}][:20]


def test_a_negative_sample_reaches_past_its_first_cut(spark):
    """Nearly all pairs are matches, and repeated; the cut is raised until enough remain."""
    left, right = spark.range(60).select(F.col("id").alias("a")), spark.range(50).select((F.col("id") + 100).alias("b"))
    every = left.crossJoin(right).withColumn("d", H.negative_rank(F.col("a").cast("string"), F.col("b").cast("string"), 7)).collect()
    known = {(r.a, r.b) for r in every if (r.a + r.b) % 40}
    matches = spark.createDataFrame([k for k in known for _ in range(2)], "a long, b long")
    want = [(r.a, r.b) for r in sorted(every, key=lambda r: r.d) if (r.a, r.b) not in known]
    for keep in (1, 30, len(want), len(want) + 9):
        got = [(r.a, r.b) for r in P.nonmatches(left, right, matches, keep).orderBy("digest").collect()]
        assert got == want[:keep]
    assert P.nonmatches(left.where("a < 0"), right, matches, 5).collect() == []


def test_unrelated_pairs_are_the_sorted_prefix(spark):
    """One key has most records, so few pairs are unrelated."""
    rows = [(i, "hot" if i < 70 else "" if i < 75 else f"k{i % 3}") for i in range(90)]
    records = spark.createDataFrame(rows, "id long, subject string")
    pairs = [(a, b) for a, ka in rows for b, kb in rows if a < b and ka and kb and ka != kb]
    ranked = spark.createDataFrame(pairs, "a long, b long").withColumn("d", H.pair_rank(F.col("a").cast("string"), F.col("b").cast("string"), 7)).orderBy("d").collect()
    for keep in (7, 400, 5000):
        assert [(r.a, r.b) for r in P.unrelated(records, "subject", keep).orderBy("digest").collect()] == [(r.a, r.b) for r in ranked][:keep]
    assert {r.subject: (r.members, r.links) for r in P.related_classes(records, "subject").collect()}["hot"] == (70, 70 * 69 // 2)
    close, far = P.related(records, "subject"), P.unrelated(records, "subject", 10)
    union = P.pair_union(close, far, 5, 15).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in union} == {"thread_related": 5, "cross_thread": 10}
    with pytest.raises(ValueError, match="11 unrelated pairs asked for, 10 available"):
        P.pair_union(close, far, 5, 16)
    assert P.pair_union(close, far, 5, 16, fill=True).count() == 15


def test_split_alternates_within_labels(spark):
    for n in (3, 4):
        rows = spark.createDataFrame([(f"p{i}", i % 2) for i in range(2 * n)], "pair string, label int")
        for label in (0, 1):
            got = sorted((r.rank, r.split) for r in P.split_by_rank(rows, "label", F.col("pair")).collect() if r.label == label)
            assert got == [(i, "evaluation" if i % 2 else "calibration") for i in range(n)]


def test_selection_shortfall_is_an_error(spark):
    with pytest.raises(ValueError, match="available"):
        P.top_by_hash(spark.range(3), F.col("id").cast("string"), 4)


def test_dedup_order(spark):
    rows = [("a", "f1", "m1", 9), ("b", "f1", "m2", 9), ("c", "f2", "m1", 9), ("d", "f3", None, 0), ("e", "f4", None, 4), ("f", "f5", "m2", 5), ("g", "f6", None, 5)]
    kept, counts = P.dedup_messages(spark.createDataFrame(rows, "path string, fingerprint string, message_id string, n_tokens long"))
    assert sorted(r.path for r in kept.collect()) == ["a", "f", "g"]
    assert {r.status: r.n for r in counts.collect()} == {"duplicate_copy": 1, "duplicate_id": 1, "empty": 1, "short": 1, "kept": 3}


def test_rules(spark):
    arrays = spark.createDataFrame([([],), ([1],), ([1, 2, 9],), ([1, 1],), ([3, 2],)], "a array<int>")
    assert [r[0] for r in arrays.select(V.strictly_increasing(F.col("a"))).collect()] == [True, True, True, False, False]
    seq = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (3, 1), (4, 0), (4, 0)], "k int, s int")
    assert sorted(r.k for r in V.incomplete(seq, "k", "s").collect()) == [2, 3, 4]
    with pytest.raises(ValueError, match="twice"):
        V.demand(V.repeated(seq, "k", "s"), "twice")


def test_encodings(spark):
    with pytest.raises(ValueError, match="power of four"):
        K.digits(F.lit(1), 32)
    r = spark.range(1).select(K.onehot_decoded(K.onehot(F.array(F.lit(3), F.lit(0), F.lit(2)), 4), 4)).first()
    assert r[0] == [3, 0, 2]


def test_parameters():
    from fractions import Fraction

    from kinset.operators import parameters as A

    p = A.Parameters()
    assert (p.feature_dim, p.ring_dim, p.depth) == (8192, 8192, 1)
    assert p.plaintext_mod % (2 * p.ring_dim) == 1 and A.is_prime(p.plaintext_mod) and p.plaintext_mod > p.k
    assert A.Parameters(sqrt=True).feature_dim == 128 * 16
    for bad in ({"k": 0}, {"m": 1}, {"m": 32, "sqrt": True}, {"tau": 129}, {"security": "x"}):
        with pytest.raises(ValueError):
            A.Parameters(**bad)
    for degree in (16, 32, 64, 128, 256, 512):
        s = A.polynomial_shape(degree)
        assert (s.step - 1) ** 2 < degree + 1 <= s.step**2 and (s.chunks - 1) * s.step <= degree < s.chunks * s.step
    assert A.sanitizer_bits(40, 1 << 20, 8192, 30, 8) == {"query": 60, "coefficient": 73, "flood": 111}
    assert A.exact_jaccard("0.250") == Fraction(1, 4) and A.exact_jaccard("1") == 1
    for bad in ("", ".5", "1.", "1.01", "-0", "0.1.2", "0." + "1" * 19):
        with pytest.raises(ValueError):
            A.exact_jaccard(bad)
    q = A.plaintext_modulus(16, 64)
    coefficients = A.threshold_polynomial(16, 7, q)
    assert [A.horner(coefficients, v, q) for v in range(17)] == [int(v >= 7) for v in range(17)]


def test_protocol_methods(spark):
    from kinset.operators import protocols as M

    rows = [(1, 1), (1, 1), (1, 2), (2, 2), (2, 3)]
    s = spark.createDataFrame(rows, "set_id long, element long")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert {(r.a, r.b): r.jaccard for r in M.exact(s, pairs).collect()} == {(1, 2): 1 / 3, (3, 4): 1.0}
    # the repeated element counts in the union of the indicator method
    assert {(r.a, r.b): r.jaccard for r in M.indicator(10)(s, pairs).collect()} == {(1, 2): 1 / 4, (3, 4): 1.0}
    for method in (M.minhash_intersection(64), M.bucketed(64, 64)):
        assert abs(method(s, pairs).first().jaccard - 1 / 3) < 0.3
    assert M.at_least(16, 64, 1)(s, pairs).first().decision in (True, False)


def test_balanced_prefix(spark):
    def pick(labels, keep):
        df = spark.createDataFrame(list(enumerate(labels)), "row_pos long, label int")
        return sorted(r.row_pos for r in P.balanced_prefix(df, keep).collect())

    assert pick([0, 0, 0, 0, 1, 1, 1, 1], 5) == [0, 1, 4, 5, 6]
    assert pick([0, 0, 1, 1, 1, 1, 1], 6) == [0, 1, 2, 3, 4, 5]
    assert pick([0, 0, 0, 0, 0, 1, 1], 6) == [0, 1, 2, 3, 5, 6]
    assert pick([0, 0, 0, 0, 1], 4) == [0, 1, 2, 3]
    assert pick([0, 1, 0], 3) == [0, 1, 2]


def test_patterns_and_gaussian_error(spark):
    share = lambda kind: G.signature_pattern(spark, 200, kind).agg(F.avg((F.col("a") % 64 == F.col("b") % 64).cast("double"))).first()[0]
    assert share("all") == 1 and share("none") == 0 and 0 <= share("random") < 0.1
    rows = spark.createDataFrame([(0.0,), (1.96,), (None,)], "z double").select(R.gaussian_error("z").alias("e")).collect()
    assert rows[0].e == 0.5 and rows[1].e == pytest.approx(0.0249979, abs=1e-6) and rows[2].e is None


def test_indicator_takes_no_element_outside(spark):
    from kinset.operators import protocols as M

    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    for outside in (10, -1, None):
        s = spark.createDataFrame([(1, 1), (2, 1), (2, outside)], "set_id long, element long")
        with pytest.raises(Exception, match="outside the universe"):
            M.indicator(10)(s, pairs).collect()


def test_t_interval_beyond_the_table(spark):
    # 97.5 % points from printed tables, for 31, 40, 60 and 120 degrees of freedom
    points = {32: 2.0395134, 41: 2.0210754, 61: 2.0002978, 121: 1.9799304}
    rows = spark.createDataFrame([(n, float(i)) for n in (1, 31, *points) for i in range(n)], "g long, x double")
    got = {r.g: r for r in stats.t_interval(rows, ["g"], "x", beyond=True).collect()}
    assert len(got) == 6 and got[1].low is None
    for n, t in ({31: stats.STUDENT_T[29]} | points).items():
        assert got[n].n == n and (got[n].high - got[n].mean) * math.sqrt(n) / got[n].sd == pytest.approx(t, abs=2e-6)


def test_t_interval_query_keeps_large_groups(spark, tmp_path):
    import duckdb

    from kinset.plans import catalogue

    rows = [(1, float(i)) for i in range(40)] + [(2, 1.0), (2, 4.0), (3, 5.0)]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["ag18_t_interval"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(con.execute(catalogue.ORACLES["ag18_t_interval"]).fetchall())
    assert [r[:2] for r in got] == [r[:2] for r in want] == [(1, 40), (2, 2), (3, 1)]
    assert got[0][2:] == pytest.approx(want[0][2:]) and got[1][2:] == pytest.approx(want[1][2:])


def test_recomputed_rows(spark):
    a = spark.createDataFrame([(1, 0.5, "x"), (2, 1.0, "y"), (3, float("nan"), None), (4, 2.0, "z")], "k int, v double, t string")
    b = spark.createDataFrame([(1, 0.5 + 1e-13, "x"), (2, 1.1, "q"), (3, float("nan"), None), (5, 2.0, "z")], "k int, v double, t string")
    got = sorted((r.k, r.field) for r in V.recomputed(a, b, ["k"], 1e-12).collect())
    assert got == [(2, "t"), (2, "v"), (4, "row"), (5, "row")]


def test_decisions_follow_their_thresholds(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.5, True), (2, 0.5, 0.5, False), (3, 0.4, 0.5, True), (4, 0.6, 0.5, False), (5, None, 0.5, True), (6, 0.6, 1.5, True)], "k int, s double, tau double, d boolean")
    assert sorted(r.k for r in V.inconsistent_decisions(rows, "s", "tau", "d").collect()) == [3, 4, 5, 6]


@pytest.mark.parametrize("few", [0, 10_000])
def test_running_totals_over_ranges(spark, few, monkeypatch):
    from kinset.operators import ordered

    monkeypatch.setattr(ordered.cuts, "__defaults__", (ordered.RANGES, few))
    monkeypatch.setattr(ordered.running, "__defaults__", (None, 7, few))
    rows = [(g, v, v % 5) for g in ("a", None, "b") for v in range(0, 300, 3 if g == "a" else 7)] + [("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, v long, n long")
    got = {(r.g, r.v): (r.to, r.to_all, r.below) for r in ordered.running(df, ["g"], "v", {"n": "to"}, "below").collect()}
    for g in ("a", None, "b"):
        mine = sorted(v for h, v, _ in rows if h == g)
        for i, v in enumerate(mine):
            assert got[g, v] == (sum(x % 5 for x in mine[: i + 1]), sum(x % 5 for x in mine), mine[i - 1] if i else None)
    assert len(got) == len(rows) - 1
    again = spark.createDataFrame([(g, float(v)) for g, v, _ in rows[:-1] for _ in range(v % 3 + 1)] + [("c", None)], "g string, v double")
    got = {r.g: r for r in ordered.ranks(again, ["g"], "v", {"mid": 0.5, "low": 0.1}, {"p95": 95}).collect()}
    for g in ("a", None, "b"):
        mine = sorted(float(v) for h, v, _ in rows if h == g for _ in range(v % 3 + 1))
        assert got[g].p95 == mine[math.ceil(95 * len(mine) / 100) - 1]
        at = 0.1 * (len(mine) - 1)
        low = mine[math.floor(at)] + (mine[math.ceil(at)] - mine[math.floor(at)]) * (at - math.floor(at))
        assert got[g].low == pytest.approx(low) and got[g].mid == pytest.approx(float(__import__("statistics").median(mine)))
    empty = ordered.ranks(again.where("v < 0"), [], "v", {"mid": 0.5}, {"p95": 95}).collect()
    assert [tuple(r) for r in empty] == [(None, None)]


def test_split_ranks_are_those_of_one_order(spark):
    rows = spark.createDataFrame([(i, (None, 0, 1)[i % 3]) for i in range(300)], "id long, label int")
    got = P.split_by_rank(rows, "label", F.col("id").cast("string")).collect()
    for label in (None, 0, 1):
        mine = [r for r in got if r.label == label]
        assert sorted(r["rank"] for r in mine) == list(range(100))
        assert all((r.split == "calibration") == (r["rank"] % 2 == 0) for r in mine)


def test_residual_gate(spark):
    good = [("good", float(x), 2.0 * x + 1 + e) for x in (1, 2, 3, 10) for e in (-0.1, 0, 0.1)]
    bad = [("bad", float(x), float(x * x)) for x in (1, 2, 3, 10)]
    other = [("one", 1.0, 5.0), ("one", 10.0, 5.0), ("zero", 1.0, 0.0), ("zero", 2.0, 0.0), ("zero", 10.0, 0.0), ("none", 1.0, 1.0), ("none", 2.0, 2.0), ("none", None, 3.0)]
    df = spark.createDataFrame(good + bad + other, "g string, x double, y double")
    got = {r.g: r for r in stats.extrapolated(stats.residual_gate(df, ["g"], "x", "y", 10.0), 20.0).collect()}
    assert {g: r.gate for g, r in got.items()} == {"good": "PASS", "bad": "FAIL", "one": "FAIL", "zero": "FAIL", "none": "FAIL"}
    assert got["good"].extrapolated == pytest.approx(41.0) and got["bad"].extrapolated is None
    assert got["zero"].residual == got["none"].residual == 1.0


def test_lookup_by_keys_and_capacity(spark):
    table = spark.createDataFrame([("a", 1, 1, 1, 10, 5.0, "x"), ("a", 1, 1, 1, 20, 6.0, "y"), ("a", 1, 1, 1, 20, 7.0, "z"), (None, 1, 1, 1, 90, 1.0, "n")], "c string, d int, e int, f int, cap int, cost double, need string")
    wanted = spark.createDataFrame([(1, "a", 1, 1, 1, 5), (2, "a", 1, 1, 1, 15), (3, "a", 1, 1, 1, 30), (4, "b", 1, 1, 1, 1), (5, None, 1, 1, 1, 1), (6, "a", 1, 1, 1, 15), (7, "a", 1, 1, 1, None)], "id int, c string, d int, e int, f int, at_least int")
    got = {r.id: (r.status, r.best_capacity, r.chosen and r.chosen.need) for r in P.looked_up(table, wanted, list("cdef"), "cap", "at_least", ["cost", "need"]).collect()}
    assert got == {1: ("found", 20, "x"), 2: ("found", 20, "y"), 3: ("infeasible", 20, None), 4: ("missing", None, None), 5: ("missing", None, None), 6: ("found", 20, "y"), 7: ("infeasible", 20, None)}
    with pytest.raises(ValueError):
        P.looked_up(table, wanted, list("cde"), "cap", "at_least", ["cost"])


def test_lookup_at_hot_keys_against_plain_search(spark, monkeypatch):
    rng = random.Random(4)
    key = lambda: ("h", 1, 1, 1) if rng.random() < 0.5 else (rng.choice("hx"), rng.randrange(2), 1, rng.choice([1, None]))
    offers = [(*key(), rng.choice([None, *range(40)]), rng.randrange(9), i) for i in range(400)]
    wishes = [(i, *key(), rng.choice([None, *range(45)])) for i in range(300)]
    table = spark.createDataFrame(offers, "c string, d int, e int, f int, cap int, cost int, n int")
    wanted = spark.createDataFrame(wishes, "id int, c string, d int, e int, f int, at_least int")
    monkeypatch.setattr(P.ordered.cuts, "__defaults__", (16, 10))
    got = {r.id: (r.status, r.best_capacity, r.chosen and r.chosen.n) for r in P.looked_up(table, wanted, list("cdef"), "cap", "at_least", ["cost", "n"]).collect()}
    for i, *k, need in wishes:
        same = [o for o in offers if None not in k and list(o[:4]) == k]
        most = max((o[4] for o in same if o[4] is not None), default=None)
        fits = [o for o in same if o[4] is not None and need is not None and o[4] >= need]
        assert got[i] == (("found", most, min(fits, key=lambda o: o[5:])[6]) if fits else ("infeasible" if same else "missing", most, None)), (i, k, need)


def test_trials_are_signatures_under_their_seeds(spark):
    rng = random.Random(1)
    s = spark.createDataFrame([(k, rng.randrange(60)) for k in range(9) for _ in range(20)] + [(9, rng.randrange(900)) for _ in range(90)], "set_id long, element long").distinct()
    got = {(r.set_id, r.trial, r.coord): r["rank"] for r in K.minhash_trials(s, 5, 3).collect()}
    want = {(r.set_id, t, r.coord): r["rank"] for t in range(3) for r in K.minhash(s, 5, t).collect()}
    assert got == want
    with pytest.raises(ValueError):
        K.minhash_trials(s, 33, 1)
    # more slots than stand side by side
    wide = {(r.set_id, r.coord): r["rank"] for r in K.minhash(s, 70).collect()}
    assert len(wide) == 700 and wide == {(r.set_id, r.coord): r["rank"] for r in K.minhash(s, 70, shared=False).collect()}
    assert {k: v for k, v in wide.items() if k[1] < 5} == {(r.set_id, r.coord): r["rank"] for r in K.minhash(s, 5).collect()}
    least = {(r.set_id, r.coord): r["rank"] for r in K.element_ranks(s.select("element").distinct(), 70).join(s, "element").groupBy("set_id", "coord").agg(F.min("rank").alias("rank")).collect()}
    assert wide == least


def test_failures_counted_and_outlived(spark):
    times = [r.failure for r in D.simulate(spark, 20, 2, 3, 80).collect()]
    got = {r.failure: (r.n, r.survivors) for r in D.failure_histogram(D.simulate(spark, 20, 2, 3, 80)).collect()}
    assert got == {t: (times.count(t), sum(x > t for x in times)) for t in times}


def test_chunked_vectors_against_sets(spark):
    """A set with a third of all rows, repeated and negative elements, nulls and both ends of a chunk."""
    rng = random.Random(6)
    rows = [(0, k) for k in range(2000)] + [(rng.randrange(1, 12), rng.choice([rng.randrange(3000), -rng.randrange(200), 63, 64, -1, -64, -65, (1 << 63) - 1, -(1 << 63)])) for _ in range(2500)] + [(3, None), (20, None)]
    sets, plain = spark.createDataFrame(rows, "set_id long, element long"), {}
    for s, e in rows:
        plain.setdefault(s, set()).update([] if e is None else [e])
    pairs = spark.createDataFrame([(a, b) for a in [*range(12), 20, 99] for b in (0, 1, 5, 20, 98)], "a long, b long")
    got = {(r.a, r.b): (r.inter, r.size_a, r.size_b) for r in B.overlaps(B.chunked(sets), pairs).collect()}
    of = lambda s: plain.get(s, set())
    assert got == {(a, b): (len(of(a) & of(b)), len(of(a)), len(of(b))) for a, b in got}
    assert {r.set_id: (r.n, r.chunks) for r in B.sizes(B.chunked(sets)).collect()} == {s: (len(e), len({x // 64 for x in e})) for s, e in plain.items() if e}
    with pytest.raises(Exception, match="outside the universe of 3000"):
        B.chunked(sets, 3000).collect()


def test_cheapest_row_and_conflicts(spark):
    rows = [("a", 2, 1.0, "x", None), ("a", 2, 1.0, "x", None), ("a", 2, 3.0, "y", 1), ("b", 1, 5.0, "z", 2), ("b", None, 0.0, "w", 3), (None, 7, 7.0, "n", 4)] + [("hot", 9, 9.0, "h", 9)] * 500
    df = spark.createDataFrame(rows, "g string, cost int, second double, name string, n int")
    got = {r.g: tuple(r)[1:] for r in stats.cheapest(df, ["g"], ["cost", "second"]).collect()}
    assert got == {"a": (2, 1.0, "x", None), "b": (1, 5.0, "z", 2), None: (7, 7.0, "n", 4), "hot": (9, 9.0, "h", 9)}
    planted = df.unionAll(spark.createDataFrame([("b", 1, 5.0, "z", None)], df.schema))
    with pytest.raises(Exception, match="unlike rows of least cost in group"):
        stats.cheapest(planted, ["g"], ["cost", "second"]).collect()
    # a tie that is not of the least cost is none
    assert stats.cheapest(df.unionAll(spark.createDataFrame([("a", 2, 3.0, "other", 1)], df.schema)), ["g"], ["cost", "second"]).count() == 4


def test_cells_stand_once(spark):
    assert [r.cell_id for r in G.cell_matrix(spark, {"f": {"a": ("1", "2")}}, "v").collect()] == ["v::f::a=1", "v::f::a=2"]
    for bad in ({"f": {"a": ("1", "1")}}, {"f": {"a=b": ("1",)}}, {"f": {"": ("1",)}}):
        with pytest.raises(ValueError):
            G.cell_matrix(spark, bad, "v")

"""Queries over summaries, thresholds, survival, generators, state and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.functions import hashing as H
from kinset.operators import deletion as D
from kinset.operators import generators as G
from kinset.operators import ordered
from kinset.operators import similarity as S
from kinset.operators import sketch as K
from kinset.operators import stats
from kinset.operators import threshold as R
from kinset.plans.function_queries import be64, minhash, sha, top
from kinset.plans.registry import query, table
from kinset.plans.similarity_queries import _EXACT, PAIRS, SETS, SLOTS, pairs, rounded, sets
from kinset.sources import workspace
from kinset.sources.workspace import stored
from kinset.streaming import dynamic, stateful, store


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 9) AS mean, round(stddev_samp(c_acctbal), 9) AS sd, round(quantile_cont(c_acctbal, 0.5), 9) AS median FROM customer GROUP BY 1")
def ag14_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = "c_acctbal"
    rows = table(spark, sf_dir, "customer")
    out = rows.groupBy("c_mktsegment").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    return rounded(ordered.attach(out, ordered.ranks(rows, ["c_mktsegment"], v, {"median": 0.5}), ["c_mktsegment"]), "mean", "sd", "median")


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 95)) + ", max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) AS iqr FROM lineitem GROUP BY 1")
def ag15_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear interpolation at p * (n - 1)."""
    v = "l_extendedprice"
    q = ordered.ranks(table(spark, sf_dir, "lineitem"), ["l_returnflag"], v, {f"p{p}": p / 100 for p in (25, 50, 75, 95)}, {"max": 100})
    return q.select("l_returnflag", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (25, 50, 75, 95)], "max", F.round(F.col("p75") - F.col("p25"), 6).alias("iqr"))


_T = "[" + ", ".join(map(str, stats.STUDENT_T)) + "]"
_T_SERIES = f"{stats.NORMAL_Z!r}::DOUBLE + " + " + ".join(f"{c!r}::DOUBLE / power((count(*) - 1)::DOUBLE, {k})" for k, c in enumerate(stats.STUDENT_SERIES, 1))


@query(f"SELECT o_custkey, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - t * sd / sqrt(n), 6) AS low, round(mean + t * sd / sqrt(n), 6) AS high FROM (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd, CASE WHEN count(*) > 31 THEN {_T_SERIES} WHEN count(*) > 1 THEN ({_T})[count(*) - 1]::DOUBLE END AS t FROM orders GROUP BY 1)")
def ag18_t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group, of any size."""
    out = stats.t_interval(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", beyond=True)
    return out.select("o_custkey", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "low", "high")])


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2, count(*) AS n, CASE WHEN regr_r2(l_extendedprice, l_quantity) > 0.5 THEN 'PASS' ELSE 'FAIL' END AS gate, CASE WHEN regr_r2(l_extendedprice, l_quantity) > 0.5 THEN round(regr_slope(l_extendedprice, l_quantity) * 100 + regr_intercept(l_extendedprice, l_quantity), 3) END AS at_100 FROM lineitem GROUP BY 1")
def ag19_linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit, and where its gate passes, the extrapolation to 100 (ag31)."""
    f = stats.linear_fit(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    passes = F.col("r2") > 0.5
    return f.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 9).alias("r2"), "n", F.when(passes, "PASS").otherwise("FAIL").alias("gate"), F.when(passes, F.round(F.col("slope") * 100 + F.col("intercept"), 3)).alias("at_100"))


_MEDIANS = "m AS (SELECT l_linestatus, l_quantity AS x, quantile_cont(l_extendedprice, 0.5) AS y FROM lineitem GROUP BY ALL), f AS (SELECT l_linestatus, regr_slope(y, x) FILTER (x <> 50) AS slope, regr_intercept(y, x) FILTER (x <> 50) AS intercept, regr_r2(y, x) FILTER (x <> 50) AS r2, count(*) FILTER (x <> 50) AS points, max(y) FILTER (x = 50) AS measured FROM m GROUP BY 1), g AS (SELECT *, slope * 50 + intercept AS predicted FROM f), h AS (SELECT *, CASE WHEN measured > 0 THEN abs(measured - predicted) / measured ELSE 1.0::DOUBLE END AS residual FROM g)"


@query(f"WITH {_MEDIANS} SELECT l_linestatus, points, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(measured, 4) AS measured, round(predicted, 4) AS predicted, round(residual, 9) AS residual, CASE WHEN residual < 0.1 THEN 'PASS' ELSE 'FAIL' END AS gate, CASE WHEN residual < 0.1 THEN round(slope * 100 + intercept, 3) END AS extrapolated FROM h")
def ag19_residual_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by quantity, held out at 50 (ag19); beyond it only where the gate passes (ag31)."""
    fit = stats.residual_gate(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice", 50.0)
    out = stats.extrapolated(fit, 100.0)
    places = {"slope": 6, "intercept": 4, "measured": 4, "predicted": 4, "residual": 9, "extrapolated": 3}
    return out.select("l_linestatus", "points", "gate", *[F.round(c, n).alias(c) for c, n in places.items()])


# A value per labelled document to decide on: its words per character, in hundredths.
_VALUE = "v AS (SELECT doc_id, quality, floor(100.0 * length(regexp_replace(coalesce(text, ''), '[^ ]', '', 'g')) / greatest(1, length(coalesce(text, '')))) / 100 AS j FROM documents JOIN labels USING (doc_id))"
_CAND = "d AS (SELECT DISTINCT j AS threshold FROM v), c AS (SELECT DISTINCT threshold FROM (SELECT threshold FROM d UNION ALL SELECT (threshold + lag(threshold) OVER (ORDER BY threshold)) / 2 FROM d) WHERE threshold IS NOT NULL), cal AS (SELECT threshold, count(*) FILTER (j >= threshold AND quality = 1) AS tp, count(*) FILTER (j >= threshold AND quality = 0) AS fp, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM c, v GROUP BY 1), e AS (SELECT threshold, tp, fp, fp / n AS fpr, (p - tp) / p AS fnr, (fp / n + (p - tp) / p) / 2 AS balanced FROM cal)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    share = F.floor(100.0 * F.length(F.regexp_replace(text, "[^ ]", "")) / F.greatest(F.lit(1), F.length(text))) / 100
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", share.alias("j"))


@query(f"WITH {_VALUE}, {_CAND} SELECT round(threshold, 9) AS threshold, tp, fp, round(fpr, 9) AS fpr, round(fnr, 9) AS fnr, round(balanced, 9) AS balanced FROM e")
def ag20_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.calibrate(_values(spark, sf_dir), "j", "quality"), "threshold", "fpr", "fnr", "balanced")


@query(f"WITH {_VALUE}, {_CAND} SELECT round(threshold, 9) AS threshold, tp, fp, round(balanced, 9) AS balanced FROM e ORDER BY round(balanced, 12), threshold DESC LIMIT 1")
def ag20_select_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.best(R.calibrate(_values(spark, sf_dir), "j", "quality")).select("threshold", "tp", "fp", "balanced"), "threshold", "balanced")


_RATE = "round(n / d, 9) AS rate, round(greatest(0.0, n / d - 1.96 * sqrt(n / d * (1 - n / d) / d)), 9)::DOUBLE AS low, round(least(1.0, n / d + 1.96 * sqrt(n / d * (1 - n / d) / d)), 9)::DOUBLE AS high"


@query(f"WITH {_VALUE}, o AS (SELECT CASE WHEN j >= 0.15 THEN CASE WHEN quality = 1 THEN 'TP' ELSE 'FP' END ELSE CASE WHEN quality = 1 THEN 'FN' ELSE 'TN' END END AS outcome, quality FROM v), k AS (SELECT unnest(['TP', 'FN', 'FP', 'TN']) AS outcome), c AS (SELECT k.outcome, count(o.outcome) AS n FROM k LEFT JOIN o USING (outcome) GROUP BY 1), s AS (SELECT outcome, n, sum(n) OVER (PARTITION BY outcome IN ('TP', 'FN'))::BIGINT AS d FROM c) SELECT outcome, n, d, {_RATE} FROM s")
def ag11_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with class-conditional denominators and clipped binomial intervals."""
    from pyspark.sql import Window

    rows = _values(spark, sf_dir).select(stats.outcome(F.col("j") >= 0.15, F.col("quality") == 1).alias("outcome"))
    every = spark.createDataFrame([(o,) for o in ("TP", "FN", "FP", "TN")], "outcome string")
    counts = every.join(rows.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", "left").na.fill(0, ["n"])
    counts = counts.withColumn("d", F.sum("n").over(Window.partitionBy(F.col("outcome").isin("TP", "FN"))))
    rate, low, high = stats.binomial_interval(F.col("n"), F.col("d"))
    return rounded(counts.select("outcome", "n", "d", rate.alias("rate"), low.alias("low"), high.alias("high")), "rate", "low", "high")


@query(f"WITH {_VALUE}, x AS (SELECT DISTINCT doc_id, quality, CASE WHEN j < 0.1 THEN 'b00_10' WHEN j < 0.3 THEN 'b10_30' WHEN j < 0.6 THEN 'b30_60' ELSE 'b60_100' END AS bucket FROM v), g AS (SELECT DISTINCT quality, b AS bucket FROM x, (SELECT unnest(['b00_10', 'b10_30', 'b30_60', 'b60_100']) AS b)) SELECT g.quality, g.bucket, count(x.doc_id) AS n FROM g LEFT JOIN x ON x.quality = g.quality AND x.bucket = g.bucket GROUP BY ALL")
def ag12_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, sf_dir).dropDuplicates(["doc_id"]).select("quality", S.bucket_label(F.col("j")).alias("bucket"))
    return stats.scaffold(rows.groupBy("quality", "bucket").agg(F.count("*").alias("n")), rows.select("quality"), "bucket", S.BUCKETS)


@query("SELECT n_regionkey, sha256(string_agg(n_nationkey || ':' || n_name, chr(10) ORDER BY n_nationkey)) AS digest FROM nation GROUP BY 1")
def ag24_ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.col("n_nationkey").cast("string"), F.lit(":"), "n_name")
    return stats.ordered_digest(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], row)


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part WHERE p_size >= 10) WHERE r = 1")
def ag25_cheapest_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where("p_size >= 10")
    return rows.groupBy("p_brand").agg(F.min_by(F.struct("p_partkey", "p_retailprice"), F.struct("p_retailprice", "p_partkey")).alias("r")).select("p_brand", "r.*")


@query("SELECT l_suppkey, l_extendedprice, l_discount, l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_discount, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def ag25_cheapest_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's cheapest line, all lines standing twice; equal rows are no conflict."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_discount", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return stats.cheapest(line.unionAll(line), ["l_suppkey"], ["l_extendedprice", "l_discount", "l_orderkey", "l_linenumber"])


@query("SELECT c_nationkey, round(avg(CASE WHEN c_acctbal > 0 THEN abs(c_acctbal - 4500) / c_acctbal END), 9) AS rel, count(*) FILTER (c_acctbal > 0) AS eligible FROM customer GROUP BY 1")
def ag29_eligible_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean over eligible rows only; null where a group has none."""
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.avg(F.when(b > 0, F.abs(b - 4500) / b)), 9).alias("rel"), F.count_if(b > 0).alias("eligible"))




@query(f"WITH t AS (SELECT (64 * 2 ** (l_linenumber % 4))::BIGINT AS k, l_quantity::BIGINT AS tau, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT *, (tau / k - 1.0::DOUBLE / 64) / (1.0::DOUBLE - 1.0::DOUBLE / 64) AS j FROM t) SELECT k, tau, n, round(j, 9) AS j, least(k, greatest(1, ceil(k * (1.0::DOUBLE / 64 + (1.0::DOUBLE - 1.0::DOUBLE / 64) * round(j, 4)))::BIGINT)) AS back, round(sqrt(greatest((1.0::DOUBLE / 64 + (1.0::DOUBLE - 1.0::DOUBLE / 64) * j) * (1 - (1.0::DOUBLE / 64 + (1.0::DOUBLE - 1.0::DOUBLE / 64) * j)), 0) / k) / (1.0::DOUBLE - 1.0::DOUBLE / 64), 9) AS sigma FROM g")
def ma1_threshold_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each number of matches that lines have for a quantity stands for, among 64 to 512 slots."""
    slots = (64 * F.pow(F.lit(2), F.col("l_linenumber") % 4)).cast("bigint").alias("k")
    rows = table(spark, sf_dir, "lineitem").groupBy(slots, F.col("l_quantity").cast("bigint").alias("tau")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("j", R.jaccard_of_tau(F.col("tau"), F.col("k"), 64))
    return rounded(rows.withColumn("back", R.tau_of_jaccard(F.round("j", 4), F.col("k"), 64)).withColumn("sigma", R.sigma(F.col("j"), F.col("k"), 64)), "j", "sigma")


@query("WITH g AS (SELECT (64 * 2 ** (l_linenumber % 3))::BIGINT AS k, l_quantity::BIGINT AS tau, (1 + round(l_discount * 100)::BIGINT) / 16.0::DOUBLE AS p, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + i * ln(p) + (k - i) * ln(1 - p) AS l FROM g, range(0, 257) r(i) WHERE i <= k) SELECT k, tau, p, n, round(coalesce(sum(exp(l)) FILTER (i >= tau), 0), 7) AS survival FROM t GROUP BY ALL")
def ma4_binomial_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of as many matches as a line's quantity, at a chance made of its discount."""
    slots = (64 * F.pow(F.lit(2), F.col("l_linenumber") % 3)).cast("bigint").alias("k")
    chance = ((F.round(F.col("l_discount") * 100).cast("bigint") + 1) / 16.0).alias("p")
    rows = table(spark, sf_dir, "lineitem").groupBy(slots, F.col("l_quantity").cast("bigint").alias("tau"), chance).agg(F.count("*").alias("n"))
    return rows.withColumn("survival", F.round(R.binomial_survival(F.col("k"), F.col("tau"), F.col("p")), 7))


_SIZES = "z AS (SELECT DISTINCT n FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1))"
_CURVE = f"{_SIZES}, c AS (SELECT n, r, CASE WHEN r < 5 THEN 0.0::DOUBLE WHEN n <= 5 THEN CASE WHEN r >= n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (r / n) * ((r - 1) / (n - 1)) * ((r - 2) / (n - 2)) * ((r - 3) / (n - 3)) * ((r - 4) / (n - 4)) END AS q FROM (SELECT n, unnest(range(n + 1)) AS r FROM z)), s AS (SELECT n, r, q, CASE WHEN q >= 1 THEN 0.0::DOUBLE ELSE exp(128 * ln(1 - q)) END AS survival FROM c)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n): the sizes that suppliers' sets of parts have."""
    return sets(spark, sf_dir).groupBy("set_id").agg(F.count("*").alias("n")).select("n").distinct()


@query(f"WITH {_CURVE} SELECT n, r, round(q, 9) AS exhaustion, round(survival, 9) AS survival, round(greatest(0.0, 1 - 128 * q), 9)::DOUBLE AS bound FROM s")
def ma6_survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of sketches of suppliers' sets, by the deletions that they saw."""
    return rounded(D.survival_curves(_sizes(spark, sf_dir), 5, 128), "exhaustion", "survival", "bound")


@query(f"WITH {_CURVE} SELECT n, max(r) FILTER (survival >= 0.99) AS max_safe, round(sum(survival) FILTER (r < n), 6) AS expected_first_failure FROM s GROUP BY n")
def ma7_deletion_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = D.deletion_limits(D.survival_curves(_sizes(spark, sf_dir), 5, 128), 0.99, ("n",))
    return limits.withColumn("expected_first_failure", F.round("expected_first_failure", 6))


@query(f"WITH {_SIZES}, g AS (SELECT n, k, tau, i AS grid_index, least(1.0, greatest(0.0, (tau / k - 1.0::DOUBLE / 64) / (1.0::DOUBLE - 1.0::DOUBLE / 64) + 0.01::DOUBLE * i))::DOUBLE AS target FROM z, (VALUES (64::BIGINT, 38::BIGINT), (128, 76), (256, 153), (512, 307)) v(k, tau), (SELECT unnest(range(-10, 11))::INT AS i)), h AS (SELECT *, floor(n * (2.0::DOUBLE * target / (1.0 + target)))::BIGINT AS inter FROM g) SELECT n, k, tau, grid_index, round(target, 9) AS target, inter, 2 * n - inter AS uni FROM h")
def gen4_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps round each threshold for sets as large as suppliers' sets are."""
    return rounded(G.threshold_grids(_sizes(spark, sf_dir)), "target")


@query(f"WITH {_SIZES}, g AS (SELECT k, k * 6 // 10 AS tau, i AS point, ((k * 6 // 10) / k - 1.0::DOUBLE / 64) / (1.0::DOUBLE - 1.0::DOUBLE / 64) AS j FROM (SELECT unnest([16, 32, 64, 128, 256, 512])::BIGINT AS k), (SELECT unnest(range(21))::INT AS i)), s AS (SELECT *, 1.0::DOUBLE / 64 + (1.0::DOUBLE - 1.0::DOUBLE / 64) * j AS p FROM g), t AS (SELECT *, greatest(0.02, least(0.98, j + 3.0::DOUBLE * (2.0::DOUBLE * point / 20 - 1.0) * sqrt(p * (1 - p) / k) / (1.0::DOUBLE - 1.0::DOUBLE / 64)))::DOUBLE AS target FROM s) SELECT n, k, tau, point, round(target, 9) AS target, round(2.0 * target / (1.0 + target), 9) AS overlap, floor(round(2.0 * target / (1.0 + target), 9) * n)::BIGINT AS inter FROM t, z")
def gen9_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps within three deviations of each threshold for sets as large as suppliers' sets are."""
    points = rounded(G.threshold_sweep(spark), "target", "overlap")
    return _sizes(spark, sf_dir).crossJoin(F.broadcast(points)).withColumn("inter", F.floor(F.col("overlap") * F.col("n")))


#: Axes of a sweep beside its default cell, their names and values (fixed values).
_SWEEP = {"k": ("16", "32", "64", "128", "256", "512"), "m": ("16", "32", "64", "128", "256"), "n": ("100", "1000", "10000", "100000")}
FAMILIES = {
    **{f: {"control": ("default",), **_SWEEP} for f in ("dynamic_timing", "dynamic_accuracy")},
    **{f: {"control": ("default",)} for f in ("dynamic_refresh", "deletion_exact", "deletion_mc")},
    "estimator_accuracy": {"j": tuple(f"{i / 10:.1f}" for i in range(11)), "k": _SWEEP["k"]},
    **{f: {"k": _SWEEP["m"]} for f in ("threshold_timing", "threshold_spec", "threshold_agreement")},
    "threshold_synthetic_fpfn": {"point": tuple(f"k{k}_j{i}" for k in (64, 128, 256, 512) for i in range(-10, 11))},
}


def gen6_cell_matrix(spark: SparkSession) -> DataFrame:
    """The cells of the families that have a plaintext result; no query, as it reads no table."""
    return G.cell_matrix(spark, FAMILIES, "v1")


@query(f"SELECT i AS element, {top(sha(H.DOCUMENT, be64('9'), be64('i')))} AS rank FROM (SELECT o_orderkey AS i FROM orders) ORDER BY rank, i LIMIT 100")
def tk6_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a hundred orders without replacement."""
    return G.sampled_rows(table(spark, sf_dir, "orders"), F.col("o_orderkey"), 100, 9)


@query(f"WITH {_SIZES}, r AS (SELECT n, j, 2.0 * n * j / (1.0 + j) AS x FROM z, (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.9, 1.0])::DOUBLE AS j)) SELECT n, j, ceil(x - 0.5)::BIGINT AS half_down, floor(x)::BIGINT AS floor, floor(x + 0.5)::BIGINT AS half_up, floor(x)::BIGINT AS truncate FROM r")
def gen1_target_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sizes(spark, sf_dir).select("n", F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)))).alias("j"))
    return rows.select("n", "j", *[G.target_intersection(F.col("n"), F.col("j"), r).alias(r) for r in G.ROUNDING])


@query("SELECT o_orderkey AS trial, [(['a', 'b', 'c', 'd'])[((o_orderkey * 31) % 4 + i) % 4 + 1] for i in range(4)] AS methods FROM orders")
def wn9_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of four methods for each order's key."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("trial"), G.rotation(F.array(*map(F.lit, "abcd")), key * 31).alias("methods"))


def estimator_trials(spark: SparkSession, n: int, inter: int, k: int, m: int, trials: int) -> DataFrame:
    """(trial, exact, raw, bucket, corrected): estimates of one pair under a seed per trial.

    A shared element is hashed once for both sets: a side's minimum is a conditional min.
    """
    rows = spark.range(2 * n - inter).withColumnRenamed("id", "element")
    in_a, in_b = F.col("element") < n, (F.col("element") < inter) | (F.col("element") >= n)
    rows = rows.select("element", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trials - 1).cast("bigint"))).alias("trial")).select("element", "trial", K.coordinates(k))
    rank = H.hex_to_ordered(H.rank_hex(H.MINHASH, H.be64(F.col("trial")), H.be32(F.col("coord")), H.be64(F.col("element"))))
    least = rows.withColumn("rank", rank).groupBy("trial", "coord").agg(F.min(F.when(in_a, F.col("rank"))).alias("a"), F.min(F.when(in_b, F.col("rank"))).alias("b"))
    v = least.groupBy("trial").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("raw"), F.count_if(H.ordered_mod(F.col("a"), m) == H.ordered_mod(F.col("b"), m)).alias("v"))
    return v.select("trial", F.lit(inter / (2 * n - inter)).alias("exact"), "raw", (F.col("v") / k).alias("bucket"), S.corrected(F.col("v"), F.lit(k), m).alias("corrected"))


def pair_trials(members: DataFrame, of: DataFrame, k: int, m: int, trials: int) -> DataFrame:
    """(a, b, trial, exact, raw, bucket, corrected): estimates of each pair under each trial's seed."""
    signature = K.minhash_trials(members, k, trials)
    side = lambda s: signature.select(F.col("set_id").alias(s), "trial", "coord", F.col("rank").alias(f"r_{s}"))
    both = of.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "trial", "coord"])
    same = H.ordered_mod(F.col("r_a"), m) == H.ordered_mod(F.col("r_b"), m)
    v = both.groupBy("a", "b", "trial").agg(F.avg((F.col("r_a") == F.col("r_b")).cast("double")).alias("raw"), F.count_if(same).alias("v"))
    exact = S.overlaps(members, of).select("a", "b", S.jaccard(F.col("inter"), F.col("size_a"), F.col("size_b")).alias("exact"))
    return v.join(exact, ["a", "b"]).select("a", "b", "trial", "exact", "raw", (F.col("v") / k).alias("bucket"), S.corrected(F.col("v"), F.lit(k), m).alias("corrected"))


def diagnose(trials: DataFrame) -> DataFrame:
    """(estimator, n, mean, bias, mae, sd, se, passes): passes if |bias| <= max(0.01, 4 se)."""
    rows = trials.select("exact", F.explode(F.create_map(*[x for c in ("raw", "bucket", "corrected") for x in (F.lit(c), F.col(c))])).alias("estimator", "e"))
    out = rows.groupBy("estimator").agg(F.count("*").alias("n"), F.avg("e").alias("mean"), F.avg(F.col("e") - F.col("exact")).alias("bias"), F.avg(F.abs(F.col("e") - F.col("exact"))).alias("mae"), F.stddev_samp("e").alias("sd"))
    return out.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("passes", F.abs("bias") <= F.greatest(F.lit(0.01), 4 * F.col("se")))


#: Seeds under which estimators are looked at.
TRIALS = 8
_RANK = top(f"sha256(encode({H.MINHASH!r}) || {be64('trial')} || unhex(printf('%08x', c::BIGINT)) || {be64('element')})")


@query(f"WITH {SETS}, {PAIRS}, {_EXACT}, x AS (SELECT element, trial, c, {_RANK} AS rank FROM (SELECT DISTINCT element FROM sets), range({TRIALS}) t(trial), range({SLOTS}) s(c)), l AS (SELECT set_id, trial, c, min(rank) AS rank FROM sets JOIN x USING (element) GROUP BY ALL), v AS (SELECT a, b, l.trial, avg((l.rank = r.rank)::INT) AS raw, count(*) FILTER (('0x' || l.rank)::UBIGINT % 64::UBIGINT = ('0x' || r.rank)::UBIGINT % 64::UBIGINT) / {SLOTS} AS bucket FROM pairs JOIN l ON l.set_id = a JOIN l r ON r.set_id = b AND r.trial = l.trial AND r.c = l.c GROUP BY ALL), w AS (SELECT v.*, exact FROM v JOIN j USING (a, b)), e AS (SELECT 'raw' AS estimator, exact, raw AS e FROM w UNION ALL SELECT 'bucket', exact, bucket FROM w UNION ALL SELECT 'corrected', exact, least(1.0, greatest(0.0, (bucket - 1.0::DOUBLE / 64) / (1.0::DOUBLE - 1.0::DOUBLE / 64)))::DOUBLE FROM w), s AS (SELECT estimator, count(*) AS n, avg(e) AS mean, avg(e - exact) AS bias, avg(abs(e - exact)) AS mae, stddev_samp(e) AS sd FROM e GROUP BY 1) SELECT estimator, n, round(mean, 9) AS mean, round(bias, 9) AS bias, round(mae, 9) AS mae, round(sd, 9) AS sd, round(sd / sqrt(n), 9) AS se, abs(bias) <= greatest(0.01, 4 * sd / sqrt(n)) AS passes FROM s")
def ag17_estimator_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias of three estimators over all pairs of suppliers' sets, under several seeds."""
    return rounded(diagnose(pair_trials(sets(spark, sf_dir), pairs(spark, sf_dir), SLOTS, 64, TRIALS)), "mean", "bias", "mae", "sd", "se")


_OPS = f"e AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'insert' END AS op, {minhash('event_id % 40', '0')} AS rank, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"
_FOLD = "f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, []::VARCHAR[] AS ranks, false AS rebuild, 0::BIGINT AS refused FROM e UNION ALL SELECT f.user_id, f.i + 1, CASE WHEN f.rebuild THEN f.ranks WHEN op = 'delete' THEN [x for x in f.ranks if x <> rank] WHEN NOT list_contains(f.ranks, rank) AND (len(f.ranks) < 5 OR rank < f.ranks[-1]) THEN list_sort(list_append(f.ranks, rank))[1:5] ELSE f.ranks END, f.rebuild OR (op = 'delete' AND f.ranks = [rank]), f.refused + f.rebuild::BIGINT FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)"


def _bottom_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, seq, op, rank) of the event stream."""
    op = F.when(F.col("event_id") % 3 == 0, "delete").otherwise("insert")
    rank = H.minhash_rank(F.col("event_id") % 40, F.lit(0))
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), op.alias("op"), rank.alias("rank"))


@query(f"WITH RECURSIVE {_OPS}, {_FOLD} SELECT user_id, ranks, rebuild, refused FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1")
def st1_bottom_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts and deletes of the event stream, folded per user."""
    return dynamic.folded(_bottom_ops(spark, sf_dir), ["user_id"], 5)


@query(f"WITH RECURSIVE {_OPS}, {_FOLD} SELECT user_id, ranks, rebuild, refused, 0::BIGINT AS late, i AS ops FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1")
def st2_bottom_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as keyed state of a stream that is stopped in the middle and started again."""
    return stateful.replayed(_bottom_ops(spark, sf_dir), ["user_id"], 5)


_FOLD_ONE = _FOLD.replace("< 5", "< 1").replace("[1:5]", "[1:1]")


@query(f"WITH RECURSIVE {_OPS}, {_FOLD_ONE}, z AS (SELECT user_id, ranks, rebuild, refused FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1), m AS (SELECT user_id, min(rank) AS least FROM e WHERE op = 'insert' GROUP BY 1) SELECT user_id, CASE WHEN rebuild THEN CASE WHEN least IS NULL THEN []::VARCHAR[] ELSE [least] END ELSE ranks END AS ranks, rebuild AND least IS NULL AS rebuild, CASE WHEN rebuild THEN 0 ELSE refused END AS refused FROM z LEFT JOIN m USING (user_id)")
def st4_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of one rank: those that a deletion emptied are made anew from the members."""
    ops = stored(_bottom_ops(spark, sf_dir), "ops")
    members = ops.where("op = 'insert'").select("user_id", "rank")
    return dynamic.rebuilt(dynamic.folded(ops, ["user_id"], 1), members, ["user_id"], 1)


_UPDATES = "u AS (SELECT user_id AS owner, event_id AS seq, floor(event_id / 400)::BIGINT % 4 AS expected, expected + CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS successor, 'v' || event_id AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"
_STATUS = "CASE WHEN f.epoch IS NULL THEN 'unknown_owner' WHEN successor <> expected + 1 THEN 'not_successor' WHEN expected < f.epoch THEN 'stale_epoch' WHEN expected > f.epoch THEN 'future_epoch' ELSE 'applied' END"
_STORE = f"f AS (SELECT DISTINCT owner, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS status, CASE WHEN owner % 11 <> 0 THEN 0 END::BIGINT AS epoch, CASE WHEN owner % 11 <> 0 THEN 'start' END AS payload FROM u UNION ALL SELECT f.owner, f.i + 1, u.seq, {_STATUS}, CASE WHEN {_STATUS} = 'applied' THEN successor ELSE f.epoch END, CASE WHEN {_STATUS} = 'applied' THEN text ELSE f.payload END FROM f JOIN u ON u.owner = f.owner AND u.i = f.i + 1)"


def _owners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A store of users and updates made of the event stream."""
    e = table(spark, sf_dir, "events")
    store = e.select(F.col("user_id").alias("owner")).distinct().where("owner % 11 <> 0").select("owner", F.lit(0).cast("bigint").alias("epoch"), F.lit("start").alias("payload"))
    expected = F.floor(F.col("event_id") / 400) % 4
    updates = e.select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), expected.alias("expected"), (expected + F.when(F.col("event_id") % 13 == 0, 2).otherwise(1)).alias("epoch"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("payload"))
    return store, updates


@query(f"WITH RECURSIVE {_UPDATES}, {_STORE} SELECT owner, seq, status, epoch, payload FROM f WHERE i > 0")
def st6_epoch_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare-and-set updates per owner in order."""
    store, updates = _owners(spark, sf_dir)
    return dynamic.replace_versions(store, updates)


@query(f"WITH RECURSIVE {_UPDATES}, {_STORE}, z AS (SELECT owner, count(*) FILTER (status = 'applied') AS versions, max(epoch) AS epoch FROM f GROUP BY owner) SELECT z.owner, z.epoch, any_value(f.payload) AS payload, versions FROM z JOIN f ON f.owner = z.owner AND f.epoch = z.epoch GROUP BY ALL")
def st7_committed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same updates as batches committed to a store, each of them twice, as after a failure."""
    initial, updates = _owners(spark, sf_dir)
    kept = store.VersionStore(spark, workspace.folder(spark, "versions"))
    kept.create(initial)
    # four batches in order of seq, open at both ends; one where there is no seq to cut at
    cuts = updates.agg(F.percentile_approx("seq", [0.25, 0.5, 0.75], 10_000)).first()[0] or []
    number_of = sum((F.coalesce(F.col("seq") > c, F.lit(True)).cast("int") for c in cuts), F.lit(0))
    for number in range(len(cuts) + 1):
        batch = updates.where(number_of == number)
        for _ in range(2):
            kept.apply(batch, number)
    applied = kept.log().where(F.col("status") == "applied").groupBy("owner").agg(F.count("*").alias("versions"))
    return kept.read().join(applied, "owner", "left").select("owner", "epoch", "payload", F.coalesce("versions", F.lit(0)).alias("versions"))


@query("SELECT 'orders_without_customer' AS rule, count(*) AS offending FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'repeated_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'status_outside_enum', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'part_in_two_brands', count(*) FROM (SELECT 1 FROM part GROUP BY p_partkey HAVING count(DISTINCT p_brand) > 1) UNION ALL SELECT 'unordered_lines', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING list(l_linenumber ORDER BY l_linenumber) <> range(1, count(*) + 1))")
def val3_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, enumerations, one-to-one mappings and complete sequences, as counts of offenders."""
    from kinset.operators import validate as V

    orders, line, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return V.report(
        orders_without_customer=V.dangling(orders, customers, "o_custkey"),
        repeated_line=V.repeated(line, "l_orderkey", "l_linenumber"),
        status_outside_enum=V.outside(orders, "o_orderstatus", ("F", "O")),
        part_in_two_brands=V.one_to_many(part, "p_partkey", "p_brand"),
        unordered_lines=V.incomplete(line, "l_orderkey", "l_linenumber", 1),
    )

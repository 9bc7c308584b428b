"""Queries over sketches and similarity: the parts of suppliers as sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.functions import hashing as H
from kinset.operators import ordered
from kinset.operators import similarity as S
from kinset.operators import sketch as K
from kinset.operators import stats
from kinset.plans.function_queries import minhash
from kinset.plans.registry import query, table
from kinset.sources.workspace import stored

SETS = "sets AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS element FROM lineitem)"
PAIRS = "pairs AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_suppkey > a.s_suppkey AND b.s_suppkey <= a.s_suppkey + 6)"
#: Slots and buckets of the queries' sketches.
SLOTS, M = 16, 64


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("element")).distinct()


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier with the six next ones: an equi-join on the shifted key."""
    s = table(spark, sf_dir, "supplier")
    left = s.select(F.col("s_suppkey").alias("a"), F.explode(F.array(*[F.col("s_suppkey") + i for i in range(1, 7)])).alias("b"))
    return left.join(s.select(F.col("s_suppkey").alias("b")), "b", "left_semi").select("a", "b")


def _sig(k: int = SLOTS) -> str:
    return f"{SETS}, {PAIRS}, el AS (SELECT element, c, {minhash('element', 'c')} AS rank FROM (SELECT DISTINCT element FROM sets), range({k}) t(c)), sig AS (SELECT set_id, c AS coord, min(rank) AS rank FROM sets JOIN el USING (element) GROUP BY ALL)"


_MATCH = f"mt AS (SELECT a, b, count(*) AS k, count(*) FILTER (x.rank = y.rank) AS raw, count(*) FILTER (('0x' || x.rank)::UBIGINT % {M}::UBIGINT = ('0x' || y.rank)::UBIGINT % {M}::UBIGINT) AS v FROM pairs JOIN sig x ON x.set_id = a JOIN sig y ON y.set_id = b AND y.coord = x.coord GROUP BY ALL)"
_EXACT = "inter AS (SELECT a, b, count(*) AS inter FROM pairs JOIN sets x ON x.set_id = a JOIN sets y ON y.set_id = b AND y.element = x.element GROUP BY ALL), sz AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1), ex AS (SELECT a, b, coalesce(inter, 0) AS inter, coalesce(x.n, 0) AS size_a, coalesce(y.n, 0) AS size_b FROM pairs LEFT JOIN inter USING (a, b) LEFT JOIN sz x ON x.set_id = a LEFT JOIN sz y ON y.set_id = b), j AS (SELECT *, CASE WHEN size_a + size_b > inter THEN inter / (size_a + size_b - inter) ELSE 0 END AS exact FROM ex)"
_EST = f"e AS (SELECT j.*, k, v, least(1.0, greatest(0.0, (v / k - 1.0::DOUBLE / {M}) / (1.0::DOUBLE - 1.0::DOUBLE / {M})))::DOUBLE AS estimate FROM j JOIN mt USING (a, b)), f AS (SELECT *, abs(estimate - exact) AS abs_error, CASE WHEN exact <> 0 THEN abs(estimate - exact) / exact END AS rel_error, CASE WHEN exact < 0.1 THEN 'b00_10' WHEN exact < 0.3 THEN 'b10_30' WHEN exact < 0.6 THEN 'b30_60' ELSE 'b60_100' END AS bucket FROM e)"


@query(f"WITH {_sig(8)} SELECT set_id, coord::BIGINT AS coord, rank FROM sig")
def ag1_minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.minhash(sets(spark, sf_dir), 8).withColumn("rank", H.ordered_to_hex(F.col("rank")))


@query(f"SELECT p_partkey AS element, c::BIGINT AS coord, {minhash('p_partkey', 'c')} AS rank FROM part, range(8) t(c)")
def ag2_element_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.element_ranks(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("element")), 8).withColumn("rank", H.ordered_to_hex(F.col("rank")))


@query(f"WITH {_sig()}, {_MATCH} SELECT a, b, raw / k AS estimate FROM mt")
def ag3_raw_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.matches(K.minhash(sets(spark, sf_dir), SLOTS), pairs(spark, sf_dir), "rank")
    return m.select("a", "b", (F.col("v") / F.col("k")).alias("estimate"))


@query(f"WITH {_sig()}, {_MATCH} SELECT a, b, k, v FROM mt")
def ag4_bucket_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.matches(K.bucketed(K.minhash(sets(spark, sf_dir), SLOTS), M), pairs(spark, sf_dir), "bucket")


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and estimated similarity of each pair, with errors and class."""
    s, p = sets(spark, sf_dir), pairs(spark, sf_dir)
    v = S.matches(K.bucketed(K.minhash(s, SLOTS), M), p, "bucket")
    rows = S.overlaps(s, p).withColumn("exact", S.jaccard(F.col("inter"), F.col("size_a"), F.col("size_b"))).join(v, ["a", "b"])
    rows = rows.withColumn("estimate", S.corrected(F.col("v"), F.col("k"), M))
    return rows.withColumn("abs_error", S.absolute_error(F.col("estimate"), F.col("exact"))).withColumn("rel_error", S.relative_error(F.col("estimate"), F.col("exact"))).withColumn("bucket", S.bucket_label(F.col("exact")))


@query(f"WITH {_sig()}, {_MATCH}, {_EXACT}, {_EST} SELECT a, b, inter, size_a, size_b, k, v, round(exact, 9) AS exact, round(estimate, 9) AS estimate, round(abs_error, 9) AS abs_error, round(rel_error, 9) AS rel_error, bucket FROM f")
def ag5_corrected_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accuracy(spark, sf_dir)
    return rows.select("a", "b", "inter", "size_a", "size_b", "k", "v", *[F.round(c, 9).alias(c) for c in ("exact", "estimate", "abs_error", "rel_error")], "bucket")


@query(f"WITH {SETS}, {PAIRS}, {_EXACT} SELECT a, b, inter, size_a + size_b - inter AS uni, exact FROM j")
def ag6_exact_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element equi-join form."""
    o = S.overlaps(sets(spark, sf_dir), pairs(spark, sf_dir))
    return o.select("a", "b", "inter", (F.col("size_a") + F.col("size_b") - F.col("inter")).alias("uni"), S.jaccard(F.col("inter"), F.col("size_a"), F.col("size_b")).alias("exact"))


@query(f"WITH {SETS}, {PAIRS}, {_EXACT} SELECT a, b, inter, size_a + size_b - inter AS uni FROM ex WHERE size_a > 0 AND size_b > 0")
def jn7_array_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array form: each set once as a sorted array, then set functions."""
    arrays = sets(spark, sf_dir).groupBy("set_id").agg(F.array_sort(F.collect_list("element")).alias("e"))
    rows = pairs(spark, sf_dir).join(arrays.select(F.col("set_id").alias("a"), F.col("e").alias("ea")), "a").join(arrays.select(F.col("set_id").alias("b"), F.col("e").alias("eb")), "b")
    inter = F.size(F.array_intersect("ea", "eb")).cast("bigint")
    return rows.select("a", "b", inter.alias("inter"), (F.size("ea") + F.size("eb") - inter).alias("uni"))


@query(f"WITH {SETS}, el AS (SELECT element, c, {minhash('element', 'c')} AS rank FROM (SELECT DISTINCT element FROM sets), range(4) t(c)), r AS (SELECT set_id, c AS coord, rank, row_number() OVER (PARTITION BY set_id, c ORDER BY rank) AS pos FROM sets JOIN el USING (element)) SELECT set_id, coord::BIGINT AS coord, pos, rank FROM r WHERE pos <= 5")
def ag7_bottom_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bottom(sets(spark, sf_dir), 4, 5).withColumn("rank", H.ordered_to_hex(F.col("rank"))).withColumn("pos", F.col("pos").cast("bigint"))


_P95 = "CASE WHEN count(x) > 0 THEN list_sort(list(x))[ceil(count(x) * 95 / 100)::BIGINT] END"
_SUMMARY = "count(*) AS n, round(avg(x), 9) AS mae, round(CASE WHEN count(*) > 1 THEN stddev_samp(x) END, 9) AS sample_sd, round(quantile_cont(x, 0.5), 9) AS median, round(list_sort(list(x))[ceil(count(x) * 95 / 100)::BIGINT], 9) AS p95, round(max(x), 9) AS max, round(avg(x) - 1.96 * CASE WHEN count(*) > 1 THEN stddev_samp(x) END / sqrt(count(*)), 9) AS ci95_low, round(avg(x) + 1.96 * CASE WHEN count(*) > 1 THEN stddev_samp(x) END / sqrt(count(*)), 9) AS ci95_high"
_ROUNDED = ("mae", "sample_sd", "median", "p95", "max", "ci95_low", "ci95_high")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"SELECT o_orderstatus, {_SUMMARY} FROM (SELECT o_orderstatus, o_totalprice / 1000 AS x FROM orders) GROUP BY 1")
def ag8_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_totalprice") / 1000).alias("x"))
    return rounded(stats.error_summary(rows, ["o_orderstatus"], "x"), *_ROUNDED)


@query(f"WITH {_sig()}, {_MATCH}, {_EXACT}, {_EST}, g AS (SELECT DISTINCT a % 3 AS variant FROM f), bk AS (SELECT unnest(['b00_10', 'b10_30', 'b30_60', 'b60_100']) AS bucket), s AS (SELECT a % 3 AS variant, bucket, {_SUMMARY} FROM (SELECT *, abs_error AS x FROM f) GROUP BY 1, 2) SELECT variant, bucket, coalesce(n, 0) AS n, mae, sample_sd, median, p95, max, ci95_low, ci95_high FROM g CROSS JOIN bk LEFT JOIN s USING (variant, bucket)")
def ag9_bucket_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(accuracy(spark, sf_dir).select((F.col("a") % 3).alias("variant"), "bucket", "abs_error"), "accuracy")
    summary = stats.error_summary(rows, ["variant", "bucket"], "abs_error")
    return rounded(stats.scaffold(summary, rows.select("variant"), "bucket", S.BUCKETS), *_ROUNDED)


@query("SELECT min(n) AS min, quantile_cont(n, 0.5) AS median, list_sort(list(n))[ceil(count(n) * 95 / 100)::BIGINT] AS p95, max(n) AS max FROM (SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY l_suppkey)")
def ag13_set_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sets(spark, sf_dir).groupBy("set_id").agg(F.count("*").alias("n"))
    ranks = ordered.ranks(sizes, [], "n", {"median": 0.5}, {"p95": 95})
    return sizes.agg(F.min("n").alias("min"), F.max("n").alias("max")).crossJoin(F.broadcast(ranks)).select("min", "median", "p95", "max")


@query(f"WITH {_sig()}, d AS (SELECT set_id, coord, (('0x' || rank)::UBIGINT % {M}::UBIGINT)::BIGINT AS x FROM sig), q AS (SELECT a, b, count(*) FILTER (x.x % 8 = y.x % 8 AND x.x // 8 = y.x // 8) AS v FROM pairs JOIN d x ON x.set_id = a JOIN d y ON y.set_id = b AND y.coord = x.coord GROUP BY ALL) SELECT * FROM q")
def ma11_sqrt_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both digits equal: the same count as bucket matches."""
    low, high = K.digits(F.col("bucket"), M)
    rows = K.bucketed(K.minhash(sets(spark, sf_dir), SLOTS), M).select("set_id", "coord", F.struct(low, high).alias("digits"))
    return S.matches(rows, pairs(spark, sf_dir), "digits").select("a", "b", "v")


@query("SELECT s_suppkey, s_suppkey % 8 AS x, (s_suppkey * 7) % 8 AS y, [((s_suppkey % 8) = i)::INT for i in range(8)] || [((s_suppkey * 7) % 8 = i)::INT for i in range(8)] AS onehot, CASE WHEN s_suppkey % 8 = (s_suppkey * 7) % 8 THEN 2 ELSE 0 END::BIGINT AS product FROM supplier")
def ma9_onehot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode again, and the inner product with the digits swapped."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", K.onehot(F.array(k % 8, (k * 7) % 8), 8).alias("onehot"), K.onehot(F.array((k * 7) % 8, k % 8), 8).alias("other"))
    back = K.onehot_decoded(F.col("onehot"), 8)
    return rows.select("s_suppkey", back[0].cast("bigint").alias("x"), back[1].cast("bigint").alias("y"), "onehot", S.inner_product(F.col("onehot"), F.col("other")).alias("product"))

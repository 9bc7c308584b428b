"""Queries over joins, selection, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.functions import hashing as H
from kinset.functions import text as T
from kinset.operators import bitmaps as B
from kinset.operators import pairing as P
from kinset.operators import similarity as S
from kinset.plans.function_queries import be8, be64, prefixed, sha
from kinset.plans.registry import query, table
from kinset.plans.similarity_queries import _EXACT, PAIRS, SETS, pairs, sets

_CAST = "CAST({} AS VARCHAR)"


def _neg(a: str, b: str) -> str:
    return sha(H.NEGATIVE_PAIR, be64("7"), prefixed(_CAST.format(a)), prefixed(_CAST.format(b)))


def _pair(a: str, b: str) -> str:
    return sha(H.PAIR, be64("7"), prefixed(_CAST.format(a)), prefixed(_CAST.format(b)), zero=True)


@query(f"WITH x AS (SELECT s_suppkey AS a, p_partkey AS b FROM supplier, part), n AS (SELECT a, b, {_neg('a', 'b')} AS digest FROM x ANTI JOIN (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem) m USING (a, b)) SELECT * FROM n ORDER BY digest, a, b LIMIT 200")
def jn2_jn3_negative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross product minus known matches, the least 200 by hash."""
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"))
    right = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("b"))
    known = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return P.nonmatches(left, right, known, 200)


_REC = "rec AS (SELECT s_suppkey AS id, n_name AS subject FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_CLOSE = f"close AS (SELECT x.id AS a, y.id AS b, {_pair('x.id', 'y.id')} AS digest FROM rec x JOIN rec y ON x.subject = y.subject AND x.id < y.id)"
_FAR = f"far AS (SELECT x.id AS a, y.id AS b, {_pair('x.id', 'y.id')} AS digest FROM rec x JOIN rec y ON x.subject <> y.subject AND x.id < y.id)"
_THREADS = "rec AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS subject FROM conversations)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records, their nation as the topic."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("subject"))


@query(f"WITH {_THREADS}, {_CLOSE} SELECT * FROM close")
def jn4_related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns of one conversation."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("subject"))
    return P.related(turns, "subject")


@query(f"WITH {_THREADS}, {_CLOSE} SELECT x.subject, x.members, count(*) AS links FROM (SELECT subject, count(*) AS members FROM rec GROUP BY 1) x JOIN rec y ON y.subject = x.subject JOIN close ON close.a = y.id GROUP BY ALL")
def jn4_related_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their numbers of turns and of pairs of turns."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("subject"))
    return P.related_classes(turns, "subject")


@query(f"WITH {_REC}, {_FAR} SELECT * FROM far ORDER BY digest, a, b LIMIT 300")
def jn5_unrelated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unrelated(_records(spark, sf_dir), "subject", 300)


@query(f"WITH {_REC}, {_CLOSE}, {_FAR} (SELECT a, b, 'thread_related' AS kind, -1 AS label FROM close ORDER BY digest, a, b LIMIT 40) UNION ALL (SELECT a, b, 'cross_thread', -1 FROM far ORDER BY digest, a, b LIMIT 60)")
def tk3_pair_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return P.pair_union(P.least_related(r, "subject", 40), P.unrelated(r, "subject", 60), 40, 100, fill=True)


@query("SELECT count(*) AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def jn6_endpoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left_anti").agg(F.count("*").alias("missing"))


_TAG = sha("kinset-tag-v1", be8(1), be64("{}"))


@query(f"WITH {SETS}, {PAIRS}, t AS (SELECT set_id, {_TAG.format('element')} AS tag FROM sets) SELECT a, b, count(*) AS inter FROM pairs JOIN t x ON x.set_id = a JOIN t y ON y.set_id = b AND y.tag = x.tag GROUP BY ALL")
def jn9_tag_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection cardinality over hashed tags only, as private set intersection gives it."""
    # tags as 32 bytes, half of their digits
    tagged = sets(spark, sf_dir).select("set_id", F.unhex(H.digest("kinset-tag-v1", H.item_encoding(F.col("element")))).alias("element"))
    return S.common(tagged, pairs(spark, sf_dir))


@query(f"WITH {SETS}, {PAIRS} SELECT a, b, sum(x.bit * y.bit)::BIGINT AS inter FROM pairs JOIN (SELECT set_id, element % 512 AS u, 1 AS bit FROM sets GROUP BY ALL) x ON x.set_id = a JOIN (SELECT set_id, element % 512 AS u, 1 AS bit FROM sets GROUP BY ALL) y ON y.set_id = b AND y.u = x.u GROUP BY ALL")
def jn10_indicator_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner product of indicator vectors over a universe of 512, in chunks of 64 bits."""
    bits = sets(spark, sf_dir).select("set_id", (F.col("element") % 512).alias("element"))
    return B.products(B.chunked(bits, 512), pairs(spark, sf_dir)).select("a", "b", "inter")


@query(f"WITH {SETS}, {PAIRS}, {_EXACT}, c AS (SELECT set_id, count(DISTINCT element // 64) AS n FROM sets GROUP BY 1) SELECT a, b, inter, size_a, size_b, c.n AS chunks_a FROM ex LEFT JOIN c ON c.set_id = a")
def jn10_chunked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact overlaps of all pairs from chunks of the universe, and how many chunks a set has."""
    chunks = B.chunked(sets(spark, sf_dir))
    n = B.sizes(chunks).select(F.col("set_id").alias("a"), F.col("chunks").alias("chunks_a"))
    return B.overlaps(chunks, pairs(spark, sf_dir)).join(n, "a", "left").select("a", "b", "inter", "size_a", "size_b", "chunks_a")


@query("WITH e AS (SELECT DISTINCT n_nationkey AS nation, m AS kind FROM nation, (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'MACHINERY', 'NONE']) AS m)), a AS (SELECT c_nationkey AS nation, c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY ALL) SELECT coalesce(e.nation, a.nation) AS nation, coalesce(e.kind, a.kind) AS kind, CASE WHEN a.n IS NULL THEN 'missing' WHEN e.kind IS NULL THEN 'extra' ELSE 'present' END AS status FROM e FULL JOIN a ON e.nation = a.nation AND e.kind = a.kind")
def jn11_expected_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected rows against actual ones: missing, extra, present."""
    expected = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "MACHINERY", "NONE")))).alias("kind")).withColumn("e", F.lit(True))
    actual = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind")).count()
    status = F.when(F.col("count").isNull(), "missing").when(F.col("e").isNull(), "extra").otherwise("present")
    return expected.join(actual, ["nation", "kind"], "full").select("nation", "kind", status.alias("status"))


_SPLIT = sha(H.SPLIT, "encode('doc:' || doc_id)", zero=True)


@query(f"SELECT doc_id, quality, r::INT AS rank, CASE WHEN r % 2 = 0 THEN 'calibration' ELSE 'evaluation' END AS split FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_SPLIT}, doc_id) - 1 AS r FROM labels)")
def wn1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return P.split_by_rank(rows, "quality", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).select("doc_id", "quality", F.col("rank").cast("int").alias("rank"), "split")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
def wn2_first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return P.first_of(rows, ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query(f"WITH {SETS}, {PAIRS}, z AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1), s AS (SELECT a, b, x.n + y.n AS size FROM pairs JOIN z x ON x.set_id = a JOIN z y ON y.set_id = b) SELECT a, b, size FROM s ORDER BY abs(size - (SELECT quantile_cont(size, 0.5) FROM s)), a * 1000 + b LIMIT 1")
def wn8_median_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.overlaps(sets(spark, sf_dir), pairs(spark, sf_dir)).where("size_a > 0 AND size_b > 0")
    rows = o.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("size"), (F.col("a") * 1000 + F.col("b")).alias("key"))
    return P.nearest_to_median(rows, "size", "key").select("a", "b", "size")


@query(f"SELECT doc_id, {sha(H.DOCUMENT, be64('7'), 'encode(source || doc_id)')} AS digest FROM documents ORDER BY digest, source || doc_id LIMIT 50")
def tk2_top_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return P.top_by_hash(docs, F.concat("source", F.col("doc_id").cast("string")), 50).select("doc_id", "digest")


_MSG = f"m AS (SELECT conv_id * 1000 + turn AS path, {sha(H.COPY, prefixed('role'), prefixed(chr(39) * 2 + ' || coalesce(text, ' + chr(39) * 2 + ')'), zero=True)} AS fingerprint, CASE WHEN conv_id % 3 = 0 THEN 'id' || (conv_id // 6) || role END AS message_id, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) END::BIGINT AS n_tokens FROM conversations)"
_DEDUP = f"WITH {_MSG}, c AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY path) > 1 AS copy FROM m), i AS (SELECT *, message_id IS NOT NULL AND NOT copy AND row_number() OVER (PARTITION BY message_id, copy ORDER BY path) > 1 AS twice FROM c), s AS (SELECT *, CASE WHEN copy THEN 'duplicate_copy' WHEN twice THEN 'duplicate_id' WHEN n_tokens = 0 THEN 'empty' WHEN n_tokens < 5 THEN 'short' ELSE 'kept' END AS status FROM i)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    ids = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("id"), F.floor(F.col("conv_id") / 6).cast("string"), "role"))
    words = F.when(F.col("conv_id") % 7 == 0, 0).otherwise(F.size(T.tokens(text))).cast("bigint")
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("path"), H.copy_fingerprint(F.col("role"), text).alias("fingerprint"), ids.alias("message_id"), words.alias("n_tokens"))


@query(f"{_DEDUP} SELECT path, fingerprint, message_id, n_tokens FROM s WHERE status = 'kept'")
def flt2_dedup_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dedup_messages(_messages(spark, sf_dir))[0]


@query(f"{_DEDUP} SELECT v.status, count(s.status) AS n FROM (SELECT unnest(['duplicate_copy', 'duplicate_id', 'empty', 'short', 'kept']) AS status) v LEFT JOIN s ON s.status = v.status GROUP BY 1")
def ag22_drop_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dedup_messages(_messages(spark, sf_dir))[1]


@query("(SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 10 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def so1_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity")
    return line.where("l_quantity < 10").select("k").intersect(line.where("l_quantity > 40").select("k"))


@query("SELECT count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_quantity < 3 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def so2_union_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_quantity < 3 OR l_quantity > 48")
    return line.agg(F.countDistinct("l_partkey").alias("n"))


@query("SELECT count(*) AS differing FROM ((SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) UNION ALL (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders))")
def so6_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that one side has and the other lacks, both ways."""
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return left.exceptAll(right).unionAll(right.exceptAll(left)).agg(F.count("*").alias("differing"))

"""Queries over the scalar functions: hashes, texts, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.functions import hashing as H
from kinset.functions import text as T
from kinset.functions.expressions import once
from kinset.plans.registry import query, spread, table


def be64(x: str) -> str:
    """SQL for the eight big-endian bytes of a non-negative BIGINT."""
    return f"unhex(printf('%016x', ({x})::BIGINT))"


def be32(x: str) -> str:
    return f"unhex(printf('%08x', ({x})::BIGINT))"


def prefixed(x: str) -> str:
    return f"{be32(f'octet_length(encode({x}))')} || encode({x})"


def sha(domain: str, *fields: str, zero: bool = False) -> str:
    """SQL for the 64 digits that hashing.digest gives."""
    return f"sha256({' || '.join([f'encode({domain!r})', *([be8(0)] if zero else []), *fields])})"


def be8(n: int) -> str:
    return f"unhex('{n:02x}')"


def top(x: str) -> str:
    return f"substr({x}, 1, 16)"


def minhash(element: str, coord: str, seed: int = 42) -> str:
    """SQL for hashing.minhash_rank."""
    return top(sha(H.MINHASH, be64(str(seed)), be32(coord), be64(element)))


@query(f"SELECT c_custkey, coord::BIGINT AS coord, {minhash('c_custkey', 'coord')} AS rank, (('0x' || {minhash('c_custkey', 'coord')})::UBIGINT % 100::UBIGINT)::BIGINT AS rank_mod_100 FROM customer, range(4) t(coord)")
def hs1_minhash_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("coord"))
    rows = rows.withColumn("rank", H.minhash_rank(F.col("c_custkey"), F.col("coord")))
    return rows.withColumn("rank_mod_100", H.hex_mod(F.col("rank"), 100))


@query(f"SELECT p_partkey, {top(sha(H.FEATURE, 'encode(p_name)', zero=True))} AS feature FROM part")
def hs2_feature_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", H.feature_hash(F.col("p_name")).alias("feature"))


@query(f"""SELECT s_suppkey, {sha(H.NEGATIVE_PAIR, be64('7'), prefixed('s_name'), prefixed('n_name'))} AS negative_rank,
 {sha(H.DOCUMENT, be64('7'), 'encode(s_name)')} AS document_rank, {sha(H.PAIR, be64('7'), prefixed('s_name'), prefixed('n_name'), zero=True)} AS pair_rank,
 'pair:' || sha256(encode('same-nation') || {be8(0)} || encode(least(s_name, n_name)) || {be8(0)} || encode(greatest(s_name, n_name))) AS pair_id,
 'nation:' || lower(hex(encode(n_name))) AS hex_id, 'supplier:' || sha256(encode(s_name)) AS digest_id
 FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def hs3_record_and_pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("s_name"), F.col("n_name")
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", H.negative_rank(s, n).alias("negative_rank"), H.document_rank(s).alias("document_rank"), H.pair_rank(s, n).alias("pair_rank"), H.pair_id("same-nation", s, n).alias("pair_id"), H.hex_record_id(n, "nation:").alias("hex_id"), H.digest_record_id(s, "supplier:").alias("digest_id"))


@query(f"""SELECT conv_id, turn, {sha(H.COPY, prefixed('role'), prefixed("coalesce(text, '')"), zero=True)} AS fingerprint FROM conversations""")
def hs8_copy_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", H.copy_fingerprint(F.col("role"), F.coalesce("text", F.lit(""))).alias("fingerprint"))


@query(f"""SELECT s_suppkey, trial::BIGINT AS trial, {top(sha(H.TRIAL, be64('20260729'), prefixed('s_name'), be64('trial'), zero=True))} AS seed,
 {top(sha(H.TRIAL, be64('20260729'), be32('s_suppkey'), be64('trial'), zero=True))} AS grid_seed, {sha(H.SPLIT, 'encode(s_name)', zero=True)} AS split_rank FROM supplier, range(3) t(trial)""")
def hs9_trial_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("trial"))
    return rows.select("s_suppkey", "trial", H.trial_seed(F.col("s_name"), F.col("trial")).alias("seed"), H.indexed_seed(20260729, F.col("s_suppkey"), F.col("trial")).alias("grid_seed"), H.split_rank(F.col("s_name")).alias("split_rank"))


_M = "18446744073709551616::HUGEINT"


@query(f"""WITH a AS (SELECT i::BIGINT AS trial, ((i + 1)::HUGEINT * (11400714819323198485::HUGEINT % 4294967296) + (((i + 1)::HUGEINT * (11400714819323198485::HUGEINT // 4294967296)) % 4294967296) * 4294967296 + 42) % {_M} AS z FROM (SELECT o_orderkey AS i FROM orders) t),
b AS (SELECT trial, xor(z::UBIGINT, z::UBIGINT >> 30)::HUGEINT AS z FROM a),
c AS (SELECT trial, ((z % 4294967296) * 484763065 + (((z // 4294967296) * 484763065 + (z % 4294967296) * 3210233709) % 4294967296) * 4294967296) % {_M} AS z FROM b),
d AS (SELECT trial, xor(z::UBIGINT, z::UBIGINT >> 27)::HUGEINT AS z FROM c),
e AS (SELECT trial, ((z % 4294967296) * 321982955 + (((z // 4294967296) * 321982955 + (z % 4294967296) * 2496678331) % 4294967296) * 4294967296) % {_M} AS z FROM d)
SELECT trial, printf('%016x', xor(z::UBIGINT, z::UBIGINT >> 31)) AS seed FROM e""")
def hs15_mixed_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed for each order's key."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial"), H.mixed_seed(42, F.col("o_orderkey")).alias("seed"))


@query(f"SELECT p_partkey, lower(hex({be8(1)} || {be64('p_partkey')})) AS item, lower(hex({be8(2)} || {be64('p_partkey')} || {be32('p_size')})) AS indexed_item FROM part")
def hs17_item_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.hex(H.item_encoding(p))).alias("item"), F.lower(F.hex(H.item_encoding(p, 2, F.col("p_size")))).alias("indexed_item"))


NORMAL = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT p_partkey, {NORMAL.format(x='p_name')} AS name, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def str1_normalize_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_ascii(F.col("p_name")).alias("name"), T.slug(F.col("p_type")).alias("slug"))


@query(f"SELECT p_partkey, gram, count(*) AS n FROM (SELECT p_partkey, unnest([substr(t, i, 3) for i in range(1, length(t) - 1)]) AS gram FROM (SELECT p_partkey, {NORMAL.format(x='p_name')} AS t FROM part)) GROUP BY ALL")
def str2_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(T.grams(T.normalize_ascii(F.col("p_name")))).alias("gram"))
    return rows.groupBy("p_partkey", "gram").agg(F.count("*").alias("n"))


def _tagged(name: str, column: str) -> str:
    return f"SELECT p_partkey, '{name}=' || unnest([substr(t, i, 3) for i in range(1, length(t) - 1)]) AS feature FROM (SELECT p_partkey, {NORMAL.format(x=f'coalesce({column}, {chr(39) * 2})')} AS t FROM part)"


@query(f"SELECT p_partkey, feature, {top(sha(H.FEATURE, 'encode(feature)', zero=True))} AS hash FROM (SELECT DISTINCT * FROM ({_tagged('name', 'p_name')} UNION ALL {_tagged('brand', 'p_brand')} UNION ALL {_tagged('type', 'p_type')}))")
def str3_field_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(T.field_features(name=F.col("p_name"), brand=F.col("p_brand"), type=F.col("p_type")))).alias("feature"))
    return rows.withColumn("hash", H.feature_hash(F.col("feature")))


# case folding differs from lower case by ß in these texts, which have no compatibility signs
FOLDED = "replace(lower(coalesce(text, '')), 'ß', 'ss')"
WORDS = f"regexp_extract_all({FOLDED}, '[a-z0-9]+')"


@query(f"SELECT doc_id, len({WORDS})::BIGINT AS n_tokens, len(list_distinct({WORDS}))::BIGINT AS n_distinct FROM documents")
def str4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(T.folded_ascii(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"))


@query(f"""SELECT doc_id, count(*) AS n_shingles, count(DISTINCT s) AS n_distinct, min({top(sha(H.FEATURE, 'encode(s)', zero=True))}) AS least_feature
FROM (SELECT doc_id, array_to_string(w[i:i + 4], chr(31)) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents))) GROUP BY doc_id""")
def str5_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.shingles(T.tokens(T.folded_ascii(F.coalesce("text", F.lit("")))))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = once(once(docs, "s", s).select("doc_id", "s").where(F.size("s") > 0), "d", F.array_distinct("s"))
    return rows.select("doc_id", F.size("s").cast("bigint").alias("n_shingles"), F.size("d").cast("bigint").alias("n_distinct"), F.array_min(F.transform("d", lambda x: H.feature_hash(x))).alias("least_feature"))


def _canonical(subject: str) -> str:
    return f"SELECT conv_id, turn, array_to_string(regexp_extract_all(regexp_replace(trim(replace(lower({subject}), 'ß', 'ss')), '^(?:(?:re(?:\\[[0-9]+\\])?|fw|fwd):[ \\t]*)+', ''), '[a-z0-9]+'), ' ') AS subject FROM conversations"


_SUBJECT = "(CASE turn % 4 WHEN 0 THEN 'Re: ' WHEN 1 THEN 'RE[2]: Fwd: ' WHEN 2 THEN 'fw:' ELSE '' END || coalesce(text, ''))"


@query(_canonical(_SUBJECT))
def str6_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.canonical_subject(F.expr(_SUBJECT)).alias("subject"))


_BODY = """(coalesce(text, '') || chr(10) || '> quoted' || chr(13) || chr(10) || 'see my original message below' || chr(10) || '  > -----Original Message-----' || chr(10) || 'after' || chr(10)
  || CASE turn % 3 WHEN 0 THEN ' ----- ORIGINAL  Message_--' WHEN 1 THEN 'On Monday, Ann wrote: ' ELSE 'no tail' END || chr(10) || 'tail' || CASE turn % 2 WHEN 0 THEN chr(10) || chr(10) ELSE '' END)"""


@query(f"""WITH b AS (SELECT conv_id, turn, {_BODY} AS body FROM conversations),
l AS (SELECT *, [x for x in string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) if NOT regexp_matches(x, '^\\s*>')] AS lines FROM b),
p AS (SELECT *, list_position([regexp_matches(x, '(?i)^\\s*([-_ \\t]*original[ \\t]+message[-_ \\t]*|on[ \\t].+[ \\t]+wrote:[ \\t]*)\\s*$') for x in lines], true) AS stop FROM l),
c AS (SELECT *, rtrim(array_to_string(CASE WHEN stop > 0 THEN lines[1:stop - 1] ELSE lines END, chr(10)), chr(10)) AS text FROM p)
SELECT conv_id, turn, CASE WHEN text <> '' AND (ends_with(body, chr(10)) OR ends_with(body, chr(13))) THEN text || chr(10) ELSE text END AS body FROM c""")
def str7_quote_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr(_BODY.replace("chr(13)", "'\\r'").replace("chr(10)", "'\\n'"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_quotes(body).alias("body"))


_ID = "CASE c_custkey % 4 WHEN 0 THEN ' <' || c_name || '@x> ' WHEN 1 THEN '<a b>' WHEN 2 THEN c_name ELSE '<' || replace(c_name, ' ', '') || '>' END"


@query(f"SELECT c_custkey, nullif(regexp_extract(trim({_ID}), '^<([^<>\\s]+)>$', 1), '') AS message_id, CASE WHEN regexp_matches(v, '^(0|[1-9][0-9]{{0,19}})$') AND lpad(v, 20, '0') <= '18446744073709551615' THEN v END AS number FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN '18446744073709551615' WHEN 1 THEN '18446744073709551616' WHEN 2 THEN '0' || c_custkey ELSE c_custkey::VARCHAR END AS v FROM customer)")
def str9_strict_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE c_custkey % 5 WHEN 0 THEN '18446744073709551615' WHEN 1 THEN '18446744073709551616' WHEN 2 THEN '0' || c_custkey ELSE string(c_custkey) END")
    return table(spark, sf_dir, "customer").select("c_custkey", T.message_id(F.expr(_ID)).alias("message_id"), T.strict_unsigned(value).cast("string").alias("number"))


@query("SELECT o_custkey, list_sort(list_distinct([(x % 64)::BIGINT for x in list(o_orderkey)])) AS buckets, len(list(o_orderkey))::BIGINT AS n FROM orders GROUP BY o_custkey")
def prj1_bucket_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature bucketing: the distinct features modulo the universe, ascending."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.col("o_orderkey") % 64)).alias("buckets"), F.count("*").alias("n"))
    return rows

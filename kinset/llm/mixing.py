"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``. Sources, ordered by code
point with null last, weigh 5, 2, 1, repeating. Together they are to give ``SHARE`` times
all words; a source's target stops at ``CAP`` times its size and the excess is shared anew
by weight. Every document of a source is expected target / size times. Within a source the
documents stand in order of size, then of a hash; their expected copies are summed up in
that order, one offset (a hash of the source) is added, and a document is emitted once for
each whole number that its step crosses. In order of size, the words taken miss the target
by no more than about one longest document.

The prefix sum is not one long window: documents are counted by (source, size) and by 4096
hash buckets in each; the sums over these counts give each bucket its begin, and only a
bucket is numbered row by row. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinset.llm.common import fresh, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"


def _number(text: Column) -> Column:
    """A number in [0, 1) from a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _name(source: Column) -> Column:
    """The source as a text that is never null and keeps its order, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(name, source_size, target, rate, start) of each source, from rows (name, size)."""
    spark = sizes.sparkSession
    sums = sizes.groupBy("name").agg(F.sum("size").alias("source_size"))
    # a global rank without one global window: ranges in order, then each range's rows
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(sums.repartitionByRange(ranges, "name").withColumn("range", F.spark_partition_id()), "sources")
    # one row for each of the session's shuffle partitions, so one window over them is small
    begins = ranged.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    rank = F.col("begin") + F.row_number().over(Window.partitionBy("range").orderBy("name")) - 1
    kinds = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    weighed = stored(ranged.join(F.broadcast(begins), "range").select("name", "source_size", kinds.cast("long").alias("weight")), "weights")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        over = F.col("source_size") * CAP < F.lit(level) * F.col("weight")
        s = weighed.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("source_size") * CAP)), F.lit(0)).alias("used"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if s.n == capped or not s.w:
            break
        capped, level = s.n, (SHARE * total - s.used) / s.w
    limit = (F.col("source_size") * CAP).cast("double")
    share = F.lit(level) * F.col("weight")
    target = F.when(limit < share, limit).otherwise(share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return weighed.withColumn("target", target).withColumn("rate", rate).withColumn("start", _number(F.concat(F.lit(SEED), F.col("name")))).select("name", "source_size", "target", "rate", "start")


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: str = "__mix") -> DataFrame:
    """docs with one column more, mix: struct(size, source_size, target, copies).

    A null or empty text has size 0; a null source is a source of its own. Where all sizes
    of a source are 0 it gives no copies. Equal rows may get different numbers of copies,
    any way round. An empty table stays empty. Columns of docs stay, whatever they are called.
    """
    at, key, first, source, k = fresh(docs, "at", "key", "first", "source", "k")
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(docs[id_col].cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    placed = F.struct(_name(docs[source_col]).alias("name"), size.alias("size"), F.substring(digest, 1, 3).alias("bucket"))
    counts = stored(docs.select(placed.alias("p")).groupBy("p").count().select("p.*", "count"), "counts")
    targets = source_targets(counts.select("name", (F.col("size") * F.col("count")).alias("size")))
    before = lambda *by: F.coalesce(F.sum("count").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = counts.groupBy("name", "size").agg(F.sum("count").alias("count")).withColumn("first", before("name", "size")).select("name", "size", "first")
    buckets = counts.withColumn("inner", before("name", "size", "bucket")).drop("count")
    begins = buckets.join(sizes, ["name", "size"]).join(targets, "name").select(F.struct("name", "size", "bucket").alias(key), (F.col("first") + F.col("inner")).alias(first), F.struct("source_size", "target", "rate", "start").alias(source))
    rows = docs.select("*", placed.alias(key), digest.alias(at)).join(begins, key)
    rank = F.col(first) + F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1
    step = lambda n: F.floor(F.col(source)["rate"] * n + F.col(source)["start"])
    copies = step(F.col(k) + 1) - step(F.col(k))
    out = F.struct(F.col(key)["size"].alias("size"), F.col(source)["source_size"].alias("source_size"), F.col(source)["target"].alias("target"), copies.alias("copies"))
    return rows.withColumn(k, rank).select(*[F.col(f"`{c}`") for c in docs.columns], out.alias(mix))


def query(docs: DataFrame) -> DataFrame:
    """The digest of op3: doc_id, size, source_size, target, taken, copies."""
    m = with_copies(docs.select("doc_id", "text", "source")).select("doc_id", "__mix.*")
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with every row as often as the mix takes it; columns are those of docs."""
    mix, copy = fresh(docs, "mix", "copy")
    rows = with_copies(docs, id_col, text_col, source_col, mix)
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(mix)["copies"].cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(documents: str = "documents", columns: str = "doc_id, size, source_size, target, copies * size AS taken, copies") -> str:
    """The same result in SQL, over a relation with doc_id, text, source."""
    return f"""
WITH d AS (SELECT *, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, coalesce('s' || source, 't') AS name, md5('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS k FROM {documents}),
s AS (SELECT name, sum(size)::BIGINT AS source_size FROM d GROUP BY name),
w AS (SELECT *, (ARRAY[{', '.join(map(str, WEIGHTS))}])[(row_number() OVER (ORDER BY name) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s),
p AS (SELECT *, coalesce(sum({CAP} * source_size) OVER o, 0) AS used, sum(weight) OVER (ORDER BY {CAP}::DOUBLE * source_size / weight DESC, name DESC) AS w, row_number() OVER o2 AS r FROM w
  WINDOW o AS (ORDER BY {CAP}::DOUBLE * source_size / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o2 AS (ORDER BY {CAP}::DOUBLE * source_size / weight, name)),
lv AS (SELECT *, ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - used::DOUBLE) / w::DOUBLE AS level FROM p),
l AS (SELECT level FROM lv WHERE ({CAP} * source_size)::DOUBLE >= level * weight ORDER BY r LIMIT 1),
t AS (SELECT name, source_size, least(({CAP} * source_size)::DOUBLE, level * weight) AS target, ('0x' || substr(md5('{SEED}' || name), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM w, l),
n AS (SELECT d.*, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY name ORDER BY size, k) - 1 AS i FROM d JOIN t USING (name)),
c AS (SELECT *, (floor(rate * (i + 1) + start) - floor(rate * i + start))::BIGINT AS copies FROM n)
SELECT {columns} FROM c
"""


ORACLE = oracle()

"""Importance resampling of documents towards a target distribution.

Features are all runs of one to three words of a text, words being runs of letters, digits
and non-ASCII characters with A-Z in lower case; a feature's bucket is its bytes' CRC-32
modulo ``BUCKETS``. One pass over all documents and all target texts counts the buckets: each
task gives one array of counts, so what is shuffled is bounded by tasks x buckets. The gain of
a bucket, a whole number, is the logarithm of how much likelier the target has it. A second
pass sums the gains of each document's features from an array of ``BUCKETS`` numbers, and adds
Gumbel noise that is a hash of the id: the highest scores are a draw without replacement with
chances in proportion to the importance weights.

Scores are whole numbers, so the draw needs no global sort: documents are counted by score,
the counts are summed up from the top over ranges of scores, and the score at which the draw
is full is found. Only rows from that score on are numbered, by id within each score. Rows of
equal id, score and features count as one row with a number of copies until they are
numbered, and noise depends on the id, so no score holds a share of all rows: however many
documents are alike, at most one in 2,700 of the different ids is expected at one score.

Texts are read as bytes. A text longer than a slab is taken in pieces that end between
words and carry the last two words' checksums, so memory follows the slab, not the text.

Edge cases. A null or empty text has no features, weight 0 and is never drawn, being shorter
than ``LEAST_WORDS``; it still gets a score. A null id is hashed as empty and comes last among
ties; equal ids tie by number of features. An empty table gives an empty result, an empty
target gains from t = T = 0. Columns of docs stay, whatever they are called.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinset.llm import bytetext as bt
from kinset.llm.common import fresh, ship, stored

BUCKETS = 10_000
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
#: Copies of one row that a task makes at once.
COPIES = 1 << 16

#: CRC-32 of one byte, by the rule of its reflected polynomial.
_ONE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _ONE = np.where(_ONE & 1, (_ONE >> 1) ^ np.uint32(0xEDB88320), _ONE >> 1).astype(np.uint32)

#: Words of up to so many bytes are summed side by side, longer ones one by one.
_SHORT = 64


def _shifts() -> np.ndarray:
    """[n, k, v]: what byte v at place k of a checksum becomes when n bytes follow."""
    out = np.empty((_SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(_SHORT):
        out[n + 1] = _ONE[out[n] & 255] ^ (out[n] >> 8)
    return out


_SHIFT = _shifts()


def _with_space(crc: np.ndarray) -> np.ndarray:
    """Checksums of the texts of crc with a space behind."""
    state = ~crc
    return ~(_ONE[(state ^ np.uint32(32)) & 255] ^ (state >> 8))


class _Words:
    """The words of a slab and checksums of what ends with each of them."""

    def __init__(self, slab: bt.Slab):
        self.buf = bt.LOWER[slab.buf]
        self.start, self.end, self.first = slab.words(bt.ALNUM, self.buf)
        self.size = self.end - self.start
        self.long = np.flatnonzero(self.size > _SHORT)
        self.one = self._alone()

    def _alone(self) -> np.ndarray:
        out = np.full(len(self.start), 0xFFFFFFFF, np.uint32)
        left, k = np.flatnonzero(self.size <= _SHORT), 0
        while len(left := left[self.size[left] > k]):
            out[left] = _ONE[(out[left] ^ self.buf[self.start[left] + k]) & 255] ^ (out[left] >> 8)
            k += 1
        out = ~out
        for i in self.long.tolist():
            out[i] = zlib.crc32(self.buf[self.start[i] : self.end[i]])
        return out

    def after(self, before: np.ndarray) -> np.ndarray:
        """Checksums of the texts of before, each with its word behind."""
        n = np.minimum(self.size, _SHORT)
        out = self.one ^ _SHIFT[n, 0, before & 255] ^ _SHIFT[n, 1, (before >> 8) & 255] ^ _SHIFT[n, 2, (before >> 16) & 255] ^ _SHIFT[n, 3, before >> 24]
        for i in self.long.tolist():
            out[i] = zlib.crc32(self.buf[self.start[i] : self.end[i]], int(before[i]))
        return out


def _pieces(column: pa.Array) -> Iterator[tuple[bt.Slab, bool]]:
    """Slabs, and whether one goes on with the text of the last; cuts fall between words."""
    for slab in bt.slabs(column):
        if len(slab.buf) <= bt.SLAB_BYTES:
            yield slab, False
            continue
        at, goes_on = 0, False
        while at < len(slab.buf):
            to = at + bt.SLAB_BYTES
            while to < len(slab.buf):
                gap = np.flatnonzero(~bt.ALNUM[bt.LOWER[slab.buf[to : to + bt.SLAB_BYTES]]])
                if len(gap):
                    to += int(gap[0])
                    break
                to += bt.SLAB_BYTES
            to = min(to, len(slab.buf))
            yield bt.Slab(slab.lo, slab.hi, slab.buf[at:to], np.array([0, to - at])), goes_on
            at, goes_on = to, True


def _features(column: pa.Array, buckets: int) -> Iterator[tuple[bt.Slab, np.ndarray, list[np.ndarray]]]:
    """(slab, each text's first word, [bucket of the run of k words that ends with each word, -1 where there is none])."""
    carried, one, two = 0, np.uint32(0), np.uint32(0)
    for slab, goes_on in _pieces(column):
        w = _Words(slab)
        n = len(w.start)
        place = np.arange(n) - np.repeat(w.first[:-1], np.diff(w.first))
        carried = carried if goes_on else 0
        place[: w.first[1]] += carried
        spaced = _with_space(w.one)
        pairs = w.after(np.concatenate([[one], spaced[:-1]])) if n else w.one
        pairs_spaced = _with_space(pairs)
        triples = w.after(np.concatenate([[two], pairs_spaced[:-1]])) if n else w.one
        yield slab, w.first, [np.where(place >= k, crc.astype(np.int64) % buckets, -1) for k, crc in enumerate((w.one, pairs, triples))]
        if n:
            carried, one, two = int(min(place[-1] + 1, 2)), spaced[-1], pairs_spaced[-1]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (the only column) fall into each bucket."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, runs in _features(batch.column(0), buckets):
                for found in runs:
                    total += np.bincount(found[found >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    # at most one row for each bucket
    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log of each bucket's smoothed target share to its share."""
    m = len(all_counts)
    s, t = float(all_counts.sum()), float(target_counts.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + m) / ((x + 1.0) * (t + m)))) for x, y in zip(all_counts.tolist(), target_counts.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str = "text", out: str = "__features") -> DataFrame:
    """docs with one column more: struct(n_words, n_features, weight)."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    # by number, as a column's name may hold anything
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    fields = ("n_words", "n_features", "weight")
    schema = numbered.select("*", F.struct(*[F.lit(0).cast("long").alias(f) for f in fields]).alias("w")).schema

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.zeros((3, batch.num_rows), np.int64)
            for slab, first, runs in _features(batch.column(at), len(gain)):
                here = slice(slab.lo, slab.hi)
                got[0, here] += np.diff(first)
                for found in runs:
                    got[1, here] += bt.segment_sums((found >= 0).astype(np.int64), first)
                    got[2, here] += bt.segment_sums(np.where(found >= 0, gain[found], 0), first)
            new = pa.StructArray.from_arrays([pa.array(x) for x in got], fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, "w"])

    return numbered.mapInArrow(weigh, schema).toDF(*docs.columns, out)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandths of a Gumbel number from the id's SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def learned_gains(docs: DataFrame, targets: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from all texts of docs and of targets."""
    return gains(bucket_counts(docs.select(text_col), buckets), bucket_counts(targets.select(text_col), buckets))


def cut(scored: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, int | None, int]:
    """((score, before) of the scores that reach the draw, the least of them, its size).

    scored has score and eligible; before is how many eligible rows have a higher score.
    """
    spark = scored.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    histogram = scored.where("eligible").groupBy("score").count().repartitionByRange(ranges, F.desc("score"))
    histogram = stored(histogram.withColumn("range", F.spark_partition_id()), "histogram")
    totals = histogram.groupBy("range").agg(F.sum("count").alias("n"))
    size = (totals.agg(F.sum("n")).first()[0] or 0) * percent // 100
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each of the session's shuffle partitions
    begins = totals.select("range", earlier("n", Window.orderBy("range")).alias("begin"))
    inner = earlier("count", Window.partitionBy("range").orderBy(F.desc("score")))
    reached = histogram.withColumn("inner", inner).join(F.broadcast(begins), "range")
    reached = stored(reached.select("score", (F.col("begin") + F.col("inner")).alias("before")).where(F.col("before") < size), "reached")
    return reached, reached.agg(F.min("score")).first()[0], size


def ranked(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of a stored (doc_id, n_features, weight, score, eligible)."""
    reached, least, size = cut(scored, percent)
    names = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    alike = scored.where(F.col("eligible") & (F.col("score") >= least)).groupBy(*names).count().join(reached, "score")
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features").rowsBetween(Window.unboundedPreceding, -1)
    numbered = alike.withColumn("first", F.col("before") + F.coalesce(F.sum("count").over(order), F.lit(0)) + 1)
    # copies in two steps, so that no array is longer than COPIES
    spans = numbered.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / COPIES))))
    left = F.least(F.col("count") - F.col("span") * COPIES, F.lit(COPIES).cast("long"))
    copies = spans.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), left - 1)))
    rank = F.col("first") + F.col("span") * COPIES + F.col("k")
    drawn = copies.select(*names, F.when(rank <= size, rank).alias("rank"))
    rest = scored.where(~(F.col("eligible") & (F.col("score") >= least)))
    return drawn.unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, eligible), stored."""
    w = weighed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), gain, "text", "w")
    # the text ends here, in the task that reads it
    score = F.col("w")["weight"] + noise(F.col("doc_id"), seed)
    return stored(w.select("doc_id", F.col("w")["n_features"].alias("n_features"), F.col("w")["weight"].alias("weight"), score.alias("score"), (F.col("w")["n_words"] >= LEAST_WORDS).alias("eligible")), "scored")


def drawn(docs: DataFrame, targets: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of docs that the draw takes, with the columns of docs.

    Rows above the least score that is reached are taken as they are read; only rows of that
    one score are put in order.
    """
    gain = learned_gains(docs, targets, text_col)
    reached, least, size = cut(scored(docs, gain, id_col, text_col, seed), percent)
    if least is None:
        return docs.limit(0)
    w, score, place = fresh(docs, "w", "score", "place")
    rows = weighed(docs, gain, text_col, w).withColumn(score, F.col(w)["weight"] + noise(F.col(id_col), seed)).where(F.col(w)["n_words"] >= LEAST_WORDS)
    left = size - reached.where(F.col("score") == least).first()["before"]
    last = rows.where(F.col(score) == least).withColumn(place, F.row_number().over(Window.partitionBy(score).orderBy(F.asc_nulls_last(id_col), F.col(w)["n_features"])))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.where(F.col(score) > least).select(*names).union(last.where(F.col(place) <= left).select(*names))


def query(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """The digest of op11: doc_id, n_features, weight, score, rank."""
    return ranked(scored(docs, learned_gains(docs, targets)))


def crc_sql(text: str) -> str:
    """DuckDB expression of a text's CRC-32."""
    steps = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::BIGINT + 1, 2))::UINTEGER)"
    one = "[" + ", ".join(f"{int(v)}::UINTEGER" for v in _ONE) + "]"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, {one}[(xor(c, b) & 255) + 1]), 4294967295::UINTEGER), 4294967295::UINTEGER)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
e AS (SELECT {_WORDS} AS w FROM benchmark),
fd AS (SELECT r, unnest({_RUNS}) AS f FROM d),
fe AS (SELECT unnest({_RUNS}) AS f FROM e),
k AS (SELECT f, {crc_sql("f")}::BIGINT % {BUCKETS} AS k FROM (SELECT f FROM fd UNION SELECT f FROM fe)),
gd AS (SELECT r, k, count(*) AS n FROM fd JOIN k USING (f) GROUP BY ALL),
s AS (SELECT k, sum(n)::DOUBLE AS s FROM gd GROUP BY k),
t AS (SELECT k, count(*)::DOUBLE AS t FROM fe JOIN k USING (f) GROUP BY k),
st AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (k), st),
x AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM gd JOIN g USING (k) GROUP BY r),
y AS (SELECT d.doc_id, len(w) AS words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (r)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM y),
o AS (SELECT *, CASE WHEN words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place, count(*) FILTER (words >= {LEAST_WORDS}) OVER () AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM o
"""

"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a fixed lexicon of insults and of a learned one, insults near words
that address the reader, capitals, punctuation, disguised and masked words. The learned
lexicon holds words and word beginnings that go with the label; it makes the lexicon
densities cover languages that the fixed list lacks.

Labels are read from at most ``MAX_ROWS`` rows, chosen by a hash of the id; half of them
(by another hash) make the lexicon, the other half the trees, which are calibrated on
scores that each row gets from trees it was not in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.llm import bytetext as bt
from kinset.llm import features
from kinset.llm.common import fold_of, ship, stored
from kinset.llm.learn import BoostedTrees, Isotonic

#: Labelled rows that a fit uses at most.
MAX_ROWS = 24_000
#: Log odds from which a word is an entry of the learned lexicon.
LEAST_WEIGHT = 1.2
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2


def labelled_sample(labels: DataFrame, label: str, folds: int = FOLDS, held_out: int = HELD_OUT, max_rows: int = MAX_ROWS) -> DataFrame:
    """(label_id, label, part): at most about max_rows training rows, by a hash of the id.

    A row with a null label or id is no training row; of several rows of one id the larger
    label counts. part is 0 or 1, by another hash.
    """
    rows = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).where("label_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.where(fold_of(F.col("label_id"), folds) != held_out).groupBy("label_id").agg(F.max("label").alias("label"))
    n = rows.count()
    if n > max_rows:
        # 40 bits of the hash, so that the share stays exact for any number of labels
        h, part = F.xxhash64("label_id", F.lit(11)), F.lit(1 << 20)
        rows = rows.where(F.pmod(h, part) * part + F.pmod(F.shiftright(h, 20), part) < int((1 << 40) * max_rows / n))
    return rows.withColumn("part", F.pmod(F.xxhash64("label_id", F.lit(12)), F.lit(2)).cast("int"))


def training_texts(docs: DataFrame, sample: DataFrame, id_col: Column, text_col: Column) -> DataFrame:
    """(text, label, part) of the sample's documents; the sample is bounded, so it is broadcast."""
    got = docs.select(id_col.alias("id"), text_col.alias("text")).join(F.broadcast(sample), F.col("id") == F.col("label_id")).select("text", "label", "part")
    # few rows of many files: dealt out evenly before the work on their texts
    return got.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, clean): texts with each word or stem, by label; key 0 counts texts."""
    keys, bad = [], []
    for b in batches:
        label = b.column(1).to_numpy()
        for slab in bt.slabs(b.column(0)):
            first, stems, words = features.stem_hashes(slab)
            text = np.repeat(np.arange(slab.n), np.diff(first))
            one = np.unique(np.stack([np.concatenate([words, *stems]), np.tile(text, 1 + len(stems)).astype(np.uint64)], axis=1), axis=0)
            one = one[one[:, 0] != 0]
            keys += [one[:, 0], np.zeros(slab.n, np.uint64)]
            bad += [label[slab.lo : slab.hi][one[:, 1].astype(np.int64)], label[slab.lo : slab.hi]]
    if not keys:
        return
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    y = np.concatenate(bad)
    toxic = np.bincount(at, y, len(key)).astype(np.int64)
    clean = np.bincount(at, 1 - y, len(key)).astype(np.int64)
    for k in range(0, len(key), 50_000):
        yield pa.record_batch([pa.array(x[k : k + 50_000]) for x in (key.view(np.int64), toxic, clean)], names=["key", "toxic", "clean"])


def learn_lexicon(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, weights) of all words and stems whose log odds for label 1 are high.

    Each stands in at least `least` texts of the bounded sample, which bounds their number.
    """
    counts = texts.select("text", "label").mapInArrow(_word_counts, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    whole = counts.where("key = 0").first()
    if whole is None or not whole.toxic or not whole.clean:
        return np.zeros(0, np.uint64), np.zeros(0)
    least = max(3, whole.toxic // 250)
    odds = F.log((F.col("toxic") + 0.5) / (whole.toxic + 1)) - F.log((F.col("clean") + 1.0) / (whole.clean + 1))
    kept = counts.where((F.col("key") != 0) & (F.col("toxic") >= least)).withColumn("weight", odds).where(F.col("weight") > LEAST_WEIGHT).select("key", "weight").collect()
    key = np.array([r.key for r in kept], np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.array([r.weight for r in kept])[order]


#: Statistics that the trees read beside the lexicon features.
SURFACE = ["log_words", "capitals", "exclaim", "question", "comma_stop", "symbols", "pipes", "other_punctuation", "digits"]


def surface(slab: bt.Slab) -> np.ndarray:
    """One row of SURFACE for each text: rates over its bytes and words."""
    buf, per = slab.buf, slab.per_text
    _, _, first = slab.words(bt.NOT_SPACE)
    words = np.diff(first)
    kinds = [features._UPPER[buf], buf == 33, buf == 63, (buf == 44) | (buf == 46), features._SYMBOL[buf], buf == 124, features._OTHER[buf], features._DIGIT[buf]]
    letters = per(features._LETTER[buf]) + per(buf >= 0xC0)
    cols = [np.log1p(words)] + [features._shares(per(k), letters if i == 0 else words) for i, k in enumerate(kinds)]
    return np.stack(cols, axis=1).astype(np.float32)


class ToxicityModel:
    """Fitted lexicon, trees and calibration; scores Arrow columns of texts."""

    def __init__(self, table: np.ndarray, weight: np.ndarray):
        self.table, self.weight = table, weight
        self.trees, self.scale = BoostedTrees(), Isotonic.fit(np.zeros(0), np.zeros(0))

    def features(self, column: pa.Array) -> np.ndarray:
        rows = [np.hstack([surface(s), features.lexicon_features(s, self.table, self.weight)]) for s in bt.slabs(column)]
        return np.concatenate([*rows, np.zeros((0, len(SURFACE) + len(features.LEXICON)), np.float32)])

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> ToxicityModel:
        """fold: 0..4 for each row; its score for the calibration comes from the other folds."""
        raw = np.zeros(len(x))
        for k in range(5):
            raw[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
        self.scale = Isotonic.fit(raw, y)
        self.trees = BoostedTrees().fit(x, y)
        return self

    def score(self, column: pa.Array) -> np.ndarray:
        return self.scale(self.trees.raw(self.features(column)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Fit on the labelled training rows of docs.

    Without training rows every score is 0.5; with one label only, that label's share.
    """
    ship(docs.sparkSession)
    sample = labelled_sample(labels, label, max_rows=max_rows)
    # at most max_rows texts, read twice: the documents are read once for them
    texts = stored(training_texts(docs, sample, F.col(id_col), F.col(text_col)), "training")
    model = ToxicityModel(*learn_lexicon(texts.where("part = 0")))
    width = len(SURFACE) + len(features.LEXICON)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.features(b.column(0))
            h = np.concatenate([bt.Hasher(s.buf)(s.off[:-1], s.off[1:]) for s in bt.slabs(b.column(0))]) if b.num_rows else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float32())), b.column(1), pa.array((h % np.uint64(5)).astype(np.int64))], names=["x", "label", "fold"])

    got = texts.where("part = 1").select("text", "label").mapInArrow(rows, "x array<float>, label int, fold long").toArrow().to_pydict()
    x = np.array(got["x"], np.float32).reshape(-1, width)
    # the order of rows does not depend on how the input was dealt out
    order = np.lexsort([*x.T, np.array(got["label"], np.int64)])
    return model.fit(x[order], np.array(got["label"], np.float64)[order], np.array(got["fold"], np.int64)[order])


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, null and empty texts included; rows repeat as given."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(model.score(b.column(1)))], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op1: doc_id, held_out, score, predicted (score >= 0.3)."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs without those whose score reaches threshold; columns are those of docs."""
    model = fit(docs, labels, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)

"""Quality: random Fourier features over document statistics, ridge scores, calibration.

The features' inner products approximate a Gaussian kernel over the standardised statistics
of ``features.STATISTICS``. Ridge regression needs only sums over rows: every partition adds
up its own normal equations (and, before, its own means and squares), partitions are added
up in a tree, and one small system is solved. Scores of rows that the system has not seen
are put into bins and calibrated by isotonic regression on the bins' counts.

All labelled training rows are used; by a hash of the id, a fifth of them calibrates. What
reaches the driver has the size of the map, not of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.llm import bytetext as bt
from kinset.llm import features
from kinset.llm.common import fold_of, release, ship, stored
from kinset.llm.learn import FourierMap, Isotonic

THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
FEATURES = 384
GAMMA = 0.02
RIDGE = 1.0
BINS = 2000
SEED = 6
#: Partial sums that are added up in one step.
FAN_IN = 32
WIDTH = len(features.STATISTICS)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) for every row, x the statistics as an array; a null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features.statistics(s) for s in bt.slabs(b.column(1))]
            if rows:
                x = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(rows).ravel()), WIDTH)
                yield pa.record_batch([b.column(0), x.cast(pa.list_(pa.float32()))], names=["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH).astype(np.float64)


def partition_sums(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows (x, label) of what `of` gives for a batch of them, size numbers.

    Each partition writes its own sum; FAN_IN of them at a time are added up in a task, in as
    many rounds as it takes until there are no more than FAN_IN, which the driver adds up.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                c = b.slice(k, 4096)
                total += of(_matrix(c.column(0)), c.column(1).to_numpy().astype(np.float64))
        yield pa.record_batch([pa.array([total.tobytes()])], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += np.frombuffer(raw)
        yield pa.record_batch([pa.array([total.tobytes()])], names=["sums"])

    sums = stored(rows.select("x", "label").mapInArrow(part, "sums binary"), "sums")
    while (count := sums.count()) > FAN_IN:
        slots = -(-count // FAN_IN)
        after = stored(sums.repartition(slots).mapInArrow(add, "sums binary"), "sums")
        release(sums)
        sums = after
    total = np.sum([np.frombuffer(r.sums) for r in sums.collect()] or [np.zeros(size)], axis=0)
    release(sums)
    return total


class QualityModel:
    """Random features, ridge weights and calibration."""

    def __init__(self, map_: FourierMap, weights: np.ndarray, scale: Isotonic):
        self.map, self.weights, self.scale = map_, weights, scale

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scale(self.map(x) @ self.weights)


def training_rows(stats: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(x, label, calibrates) of the labelled training rows; of repeated ids the larger label."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).where("label_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(fold_of(F.col("label_id"), FOLDS) != HELD_OUT).groupBy("label_id").agg(F.max("label").alias("label"))
    rows = stats.join(known, F.col("doc_id") == F.col("label_id"))
    return rows.select("x", "label", (F.pmod(F.xxhash64("label_id", F.lit(13)), F.lit(5)) == 0).alias("calibrates"))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Fit on rows (doc_id, x). Without training rows every score is 0.5."""
    rows = stored(training_rows(stats, labels, label), "training")
    train = rows.where("NOT calibrates")
    moments = partition_sums(train, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]), 1 + 2 * WIDTH)
    n = max(moments[0], 1)
    mean = moments[1 : WIDTH + 1] / n
    scale = np.sqrt(np.maximum(moments[WIDTH + 1 :] / n - mean**2, 0))
    scale[scale < 1e-6] = 1.0
    fourier = FourierMap.of(mean, scale, FEATURES, GAMMA, SEED)
    d = FEATURES + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = partition_sums(train, equations, d * d + d)
    a, b = sums[: d * d].reshape(d, d), sums[d * d :]
    # the constant is not shrunk
    weights = np.linalg.solve(a + np.diag([RIDGE] * (d - 1) + [1e-6]), b)
    # isotonic regression on counts by bins of the raw score; 0.5 +- 1 holds all but outliers
    edges = np.linspace(-0.5, 1.5, BINS + 1)[1:-1]

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.searchsorted(edges, fourier(x) @ weights)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    counts = partition_sums(rows.where("calibrates"), binned, 2 * BINS)
    n, ones = counts[:BINS], counts[BINS:]
    centre = np.linspace(-0.5, 1.5, BINS + 1)[:-1] + 1 / BINS
    some = n > 0
    return QualityModel(fourier, weights, Isotonic.fit(centre[some], (ones / np.maximum(n, 1))[some], n[some]))


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for every row of (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op6: doc_id, held_out, score, predicted (score >= 0.7).

    One row for each row of docs, null and empty texts included; rows repeat as given.
    """
    stats = stored(with_statistics(docs), "statistics")
    out = scored(stats, fit(stats, labels))
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

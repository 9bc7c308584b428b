"""Threshold decisions: geometry, error probabilities, calibration and evaluation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinset.operators import ordered


def jaccard_of_tau(tau: Column, k: Column, m: int) -> Column:
    """The Jaccard value at which tau of k matches are expected; not clamped."""
    return (tau / k - F.lit(1.0 / m)) / F.lit(1.0 - 1.0 / m)


def match_probability(j: Column, m: int) -> Column:
    return F.lit(1.0 / m) + F.lit(1.0 - 1.0 / m) * j


def tau_of_jaccard(j: Column, k: Column, m: int) -> Column:
    """The least number of matches that reaches j, within 1..k."""
    return F.least(k, F.greatest(F.lit(1).cast("bigint"), F.ceil(k * match_probability(j, m)).cast("bigint")))


def sigma(j: Column, k: Column, m: int) -> Column:
    """Standard deviation of the corrected estimate."""
    p = match_probability(j, m)
    return F.sqrt(p * (1 - p) / k) / F.lit(1.0 - 1.0 / m)


def binomial_survival(k: Column, tau: Column, p: Column) -> Column:
    """P[X >= tau] for X of k trials at p, by the ascending recurrence of its terms in logs."""
    log_p, log_q = F.ln(p), F.ln(1 - p)
    start = F.struct((k * log_q).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = F.when(i == 0, acc["term"]).otherwise(acc["term"] + F.ln((k - i + 1) / i) + log_p - log_q)
        return F.struct(term.alias("term"), (acc["sum"] + F.when(i >= tau, F.exp(term)).otherwise(0.0)).alias("sum"))

    whole = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), start, step, lambda acc: F.least(F.lit(1.0), acc["sum"]))
    return F.when(tau <= 0, 1.0).when(tau > k, 0.0).when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(whole)


@F.pandas_udf(DoubleType())
def gaussian_error(z: pd.Series) -> pd.Series:
    """0.5 * erfc(z / sqrt(2)), for which Spark has no function."""
    return z.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(x / math.sqrt(2)))


def candidates(values: DataFrame, j: str) -> DataFrame:
    """Distinct values and the midpoints of neighbours, as threshold."""
    one = ordered.running(values.select(F.col(j).alias("threshold")).distinct(), [], "threshold", {}, "below")
    marks = one.select(F.explode(F.array("threshold", (F.col("threshold") + F.col("below")) / 2)).alias("threshold"))
    return marks.where("threshold IS NOT NULL").distinct()


def calibrate(rows: DataFrame, j: str, label: str) -> DataFrame:
    """(threshold, tp, fp, fpr, fnr, balanced) of each candidate, deciding j >= threshold.

    Instead of a candidates x rows join, rows are counted by value and summed in order: what
    a threshold accepts are all rows but those below it. A midpoint accepts what its upper
    neighbour does. Rows without a value are not accepted by any threshold.
    """
    counts = rows.groupBy(F.col(j).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    total = counts.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    marks = ordered.running(counts, [], "threshold", {"p": "to_p", "n": "to_n"}, "below").crossJoin(F.broadcast(total))
    marks = marks.select("*", (F.col("to_p_all") - F.col("to_p") + F.col("p")).alias("tp"), (F.col("to_n_all") - F.col("to_n") + F.col("n")).alias("fp"))
    both = F.explode(F.array_distinct(F.array("threshold", (F.col("threshold") + F.col("below")) / 2)))
    out = marks.select(both.alias("threshold"), "tp", "fp", "all_p", "all_n").where("threshold IS NOT NULL")
    out = out.withColumn("fpr", F.try_divide("fp", "all_n")).withColumn("fnr", F.try_divide(F.col("all_p") - F.col("tp"), "all_p"))
    return out.select("threshold", "tp", "fp", "fpr", "fnr", ((F.col("fpr") + F.col("fnr")) / 2).alias("balanced"))


def best(calibrated: DataFrame) -> DataFrame:
    """The candidate of least balanced error; of several, the largest threshold."""
    return calibrated.orderBy(F.round("balanced", 12), F.desc("threshold")).limit(1)

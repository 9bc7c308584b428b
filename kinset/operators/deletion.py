"""How long bottom-d sketches survive deletions: exact, bounded and simulated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.operators import ordered


def exhaustion(n: Column, d: int, r: Column) -> Column:
    """Probability that r of n deletions take all d members of one coordinate."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: (r - i) / (n - i))
    whole = F.aggregate(steps, F.lit(1.0), lambda a, x: a * x)
    return F.when(r < d, 0.0).when(n <= d, F.when(r >= n, 1.0).otherwise(0.0)).otherwise(whole)


def survival(q: Column, k: int) -> Column:
    """All of k coordinates survive, each failing with probability q."""
    return F.when(q >= 1, 0.0).otherwise(F.exp(F.lit(float(k)) * F.log1p(-q)))


def survival_curves(sizes: DataFrame, d: int, k: int) -> DataFrame:
    """(n, r, exhaustion, survival, bound) for 0..n deletions from sets of each size n in sizes.

    bound is the union bound.
    """
    rows = sizes.select("n").withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint"))))
    rows = rows.withColumn("exhaustion", exhaustion(F.col("n"), d, F.col("r")))
    return rows.withColumn("survival", survival(F.col("exhaustion"), k)).withColumn("bound", F.greatest(F.lit(0.0), 1 - k * F.col("exhaustion")))


def survival_curve(spark: SparkSession, n: int, d: int, k: int) -> DataFrame:
    """(r, exhaustion, survival, bound) of one size."""
    return survival_curves(spark.range(n, n + 1).withColumnRenamed("id", "n"), d, k).drop("n")


def deletion_limits(curve: DataFrame, required: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., max_safe, expected_first_failure) of survival curves, in one pass.

    The last point of a curve, all members gone, is not counted.
    """
    safe = F.max(F.when(F.col("survival") >= required, F.col("r"))).alias("max_safe")
    return curve.groupBy(*by).agg(safe, (F.sum("survival") - F.max_by("survival", "r")).alias("expected_first_failure"))


def simulate(spark: SparkSession, n: int, d: int, k: int, trials: int, seed: int = 42) -> DataFrame:
    """(trial, failure): deletions until some coordinate has lost its d least members.

    Members go in a random order, so the times at which a coordinate's d members go are d
    different numbers of 1..n, drawn here by keyed hashes without the members themselves. A
    coordinate fails at the greatest of them, a trial at the least of its coordinates. Trials
    are independent rows, which are made and reduced in the same task.
    """
    cells = spark.range(trials * k).select(F.floor(F.col("id") / k).alias("trial"), F.col("id").alias("cell"))

    def take(times: Column, i: Column) -> Column:
        # the i-th draw is among the n - i numbers that are left, which the taken ones shift
        left = F.pmod(F.xxhash64(F.lit(seed), F.col("cell"), i), F.lit(n) - i) + 1
        one = F.aggregate(times, left, lambda x, t: x + F.when(x >= t, 1).otherwise(0))
        return F.array_sort(F.concat(times, F.array(one)))

    times = F.aggregate(F.sequence(F.lit(0), F.lit(min(d, n) - 1)), F.array().cast("array<bigint>"), take)
    return cells.select("trial", F.element_at(times, -1).alias("gone")).groupBy("trial").agg(F.min("gone").cast("int").alias("failure"))


def failure_histogram(failures: DataFrame) -> DataFrame:
    """(failure, n, survivors): trials that fail at a count of deletions, and those that outlive it."""
    counts = failures.groupBy("failure").agg(F.count("*").alias("n"))
    return ordered.running(counts, [], "failure", {"n": "to"}).select("failure", "n", (F.col("to_all") - F.col("to")).alias("survivors"))

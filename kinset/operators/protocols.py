"""What the similarity protocols compute, as methods with one signature.

Each takes sets (set_id, element) and pairs (a, b) and gives (a, b, jaccard); they differ in
how they treat empty sets and duplicates, as their originals do. None hides anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.operators import bitmaps as B
from kinset.operators import similarity as S
from kinset.operators import sketch as K

Method = Callable[[DataFrame, DataFrame], DataFrame]


def exact(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact set intersection; duplicates do not count, two empty sets are equal."""
    o = S.overlaps(sets.select("set_id", "element").distinct(), pairs)
    return o.select("a", "b", S.jaccard(F.col("inter"), F.col("size_a"), F.col("size_b"), 1.0).alias("jaccard"))


def indicator(universe: int) -> Method:
    """Indicator vectors over a universe; sizes are those of the lists, duplicates included.

    The vectors are made and multiplied in chunks. An element outside the universe is an error.
    """

    def method(sets: DataFrame, pairs: DataFrame) -> DataFrame:
        o = B.overlaps(B.chunked(sets, universe), pairs).select("a", "b", "inter")
        n = sets.groupBy("set_id").agg(F.count("element").alias("n"))
        for side in "ab":
            o = o.join(n.select(F.col("set_id").alias(side), F.col("n").alias(f"n_{side}")), side, "left")
        sizes = [F.coalesce(f"n_{s}", F.lit(0)) for s in "ab"]
        return o.select("a", "b", S.jaccard(F.col("inter"), *sizes, 1.0).alias("jaccard"))

    return method


def minhash_intersection(k: int, seed: int = 42) -> Method:
    """Intersection of (rank, coordinate) items over k; no bucket correction."""

    def method(sets: DataFrame, pairs: DataFrame) -> DataFrame:
        m = S.matches(K.minhash(sets.select("set_id", "element").distinct(), k, seed), pairs, "rank")
        return m.select("a", "b", (F.col("v") / F.col("k")).alias("jaccard"))

    return method


def bucketed(k: int, m: int, seed: int = 42) -> Method:
    """One-hot buckets, corrected for chance matches."""

    def method(sets: DataFrame, pairs: DataFrame) -> DataFrame:
        v = S.matches(K.bucketed(K.minhash(sets.select("set_id", "element").distinct(), k, seed), m), pairs, "bucket")
        return v.select("a", "b", S.corrected(F.col("v"), F.col("k"), m).alias("jaccard"))

    return method


def at_least(k: int, m: int, tau: int, seed: int = 42) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """(a, b, decision): whether at least tau buckets match."""

    def method(sets: DataFrame, pairs: DataFrame) -> DataFrame:
        v = S.matches(K.bucketed(K.minhash(sets.select("set_id", "element").distinct(), k, seed), m), pairs, "bucket")
        return v.select("a", "b", (F.col("v") >= tau).alias("decision"))

    return method

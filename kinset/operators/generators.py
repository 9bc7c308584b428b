"""Synthetic set pairs of a target similarity, with the rounding rules in use.

The intersection of two sets of n elements at Jaccard J has 2nJ/(1+J) elements; rules
differ in how that is made whole, so the rule is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.functions import hashing as H
from kinset.operators.threshold import jaccard_of_tau, sigma

ROUNDING = ("half_down", "floor", "half_up", "truncate")


def target_intersection(n: Column, j: Column, rounding: str) -> Column:
    x = 2.0 * n * j / (1.0 + j)
    whole = {"half_down": F.ceil(x - 0.5), "floor": F.floor(x), "half_up": F.floor(x + 0.5), "truncate": F.floor(x)}[rounding]
    return whole.cast("bigint")


def set_pair(spark: SparkSession, n: int, inter: int) -> DataFrame:
    """(side, element): two sets of n elements that share inter; elements count up from 0."""
    rows = spark.range(2 * n - inter).withColumnRenamed("id", "element")
    side = F.array_compact(F.array(F.when(F.col("element") < n, F.lit("a")), F.when((F.col("element") < inter) | (F.col("element") >= n), F.lit("b"))))
    return rows.select(F.explode(side).alias("side"), "element")


def sampled_rows(df: DataFrame, element: Column, keep: int, seed: int) -> DataFrame:
    """(element, rank) of keep rows of df, the least by the element's hash: sampling without replacement."""
    rank = H.rank_hex(H.DOCUMENT, F.lit(seed.to_bytes(8, "big")), H.be64(F.col("element")))
    return df.select(element.cast("bigint").alias("element")).withColumn("rank", rank).orderBy("rank", "element").limit(keep)


def sampled(spark: SparkSession, universe: int, keep: int, seed: int) -> DataFrame:
    """keep elements of 0..universe-1."""
    return sampled_rows(spark.range(universe), F.col("id"), keep, seed)


#: Matches that decide, by number of slots (fixed values).
GRID_TAU = {64: 38, 128: 76, 256: 153, 512: 307}


def threshold_grids(sizes: DataFrame, m: int = 64) -> DataFrame:
    """(n, k, tau, grid_index, target, inter, uni): for sets of each size n, 21 points within 0.10 of each k's boundary."""
    points = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(t).cast("bigint").alias("tau"), F.lit(i).alias("grid_index")) for k, t in GRID_TAU.items() for i in range(-10, 11)])
    rows = sizes.select("n", F.explode(points).alias("p")).select("n", "p.*")
    centre = (F.col("tau") / F.col("k") - 1.0 / m) / (1.0 - 1.0 / m)
    rows = rows.withColumn("target", F.least(F.lit(1.0), F.greatest(F.lit(0.0), centre + 0.01 * F.col("grid_index"))))
    inter = F.floor(F.col("n") * (2.0 * F.col("target") / (1.0 + F.col("target")))).cast("bigint")
    return rows.withColumn("inter", inter).withColumn("uni", 2 * F.col("n") - F.col("inter"))


def threshold_grid(spark: SparkSession, n: int = 1000, m: int = 64) -> DataFrame:
    """(k, tau, grid_index, target, inter, uni) of one size."""
    return threshold_grids(spark.range(n, n + 1).withColumnRenamed("id", "n"), m).drop("n")


def rotation(methods: Column, seed: Column) -> Column:
    """methods in the cyclic order that a trial's seed gives."""
    n = F.size(methods)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(methods, ((seed % n + i) % n + 1).cast("int")))


def threshold_sweep(spark: SparkSession, slots: tuple[int, ...] = (16, 32, 64, 128, 256, 512), m: int = 64, points: int = 21) -> DataFrame:
    """(k, tau, point, target, overlap): points evenly within three deviations of the boundary.

    tau is 0.6 k, cut; targets stay in 0.02..0.98; overlap is the share of a set in both.
    """
    rows = spark.createDataFrame([(k, k * 6 // 10) for k in slots], "k bigint, tau bigint").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    centre = jaccard_of_tau(F.col("tau"), F.col("k"), m)
    z = 3.0 * (2.0 * F.col("point") / (points - 1) - 1.0)
    target = F.greatest(F.lit(0.02), F.least(F.lit(0.98), centre + z * sigma(centre, F.col("k"), m)))
    return rows.withColumn("target", target).withColumn("overlap", 2.0 * F.col("target") / (1.0 + F.col("target")))


def signature_pattern(spark: SparkSession, k: int, kind: str, seed: int = 42) -> DataFrame:
    """(coord, a, b): two signatures that match everywhere ('all'), nowhere ('none') or by hash ('random')."""
    rank = lambda side: H.hex_to_signed(H.rank_hex(H.TRIAL, F.lit(seed.to_bytes(8, "big")), H.be64(F.col("id")), F.lit(side))).bitwiseAND(F.lit((1 << 62) - 1))
    a = rank(b"a")
    b = {"all": a, "none": a.bitwiseXOR(F.lit(1)), "random": rank(b"b")}[kind]
    return spark.range(k).select(F.col("id").alias("coord"), a.alias("a"), b.alias("b"))


def cell_matrix(spark: SparkSession, families: dict[str, dict[str, tuple[str, ...]]], version: str) -> DataFrame:
    """(cell_id, family, axis, value): every value of every axis of every family, once.

    An id is version::family::axis=value. A cell named twice, and a name or value that holds
    a separator, are errors.
    """
    rows = [(f"{version}::{family}::{axis}={value}", family, axis, value) for family, axes in families.items() for axis, values in axes.items() for value in values]
    twice = {r[0] for r in rows if sum(r[0] == o[0] for o in rows) > 1}
    odd = {x for r in rows for x in (version, *r[1:]) if not x or "::" in x or "=" in x}
    if twice or odd:
        raise ValueError(f"cells that stand twice: {sorted(twice)}, names with separators: {sorted(odd)}")
    return spark.createDataFrame(rows, "cell_id string, family string, axis string, value string")

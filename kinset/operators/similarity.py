"""Similarity of sets and of sketches, exact and estimated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sets up to which an element's holders are compared with each other in place.
HOLDERS = 256
#: Sets up to which their partners are sent to every task.
SENT = 1 << 20


def overlaps(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ..) with inter, size_a, size_b, joined on elements; sets has distinct rows."""
    sizes = sets.groupBy("set_id").agg(F.count("*").alias("n"))
    left = pairs.select("a", "b").join(sets.select(F.col("set_id").alias("a"), "element"), "a")
    common = left.join(sets.select(F.col("set_id").alias("b"), "element"), ["b", "element"]).groupBy("a", "b").agg(F.count("*").alias("inter"))
    out = pairs.join(common, ["a", "b"], "left")
    for side in "ab":
        out = out.join(sizes.select(F.col("set_id").alias(side), F.col("n").alias(f"size_{side}")), side, "left")
    return out.select(*pairs.columns, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("inter", "size_a", "size_b")])


def common(sets: DataFrame, pairs: DataFrame, holders: int = HOLDERS) -> DataFrame:
    """(a, b, inter) of the distinct pairs that share elements; sets has distinct rows.

    For sets with few partners each and long elements. Rows move to their element's task once, not
    once for each pair; there an element's holders are compared with each other and with
    their partners. Elements of more holders than that are joined pair by pair (`overlaps`).
    """
    partners = pairs.groupBy(F.col("a").alias("set_id")).agg(F.collect_set("b").alias("partners"))
    partners = F.broadcast(partners) if partners.count() <= SENT else partners
    held = sets.select("set_id", "element").withColumn("holders", F.count("*").over(Window.partitionBy("element")))
    few, many = held.where(F.col("holders") <= holders), held.where(F.col("holders") > holders)
    side = lambda rows, s: rows.select(F.col("set_id").alias(s), "element")
    near = few.join(partners, "set_id").select(F.col("set_id").alias("a"), "element", "partners").join(side(few, "b"), "element").where(F.array_contains("partners", F.col("b"))).select("a", "b")
    far = pairs.select("a", "b").join(side(many, "a"), "a").join(side(many, "b"), ["b", "element"]).select("a", "b")
    return near.unionByName(far).groupBy("a", "b").agg(F.count("*").alias("inter"))


def jaccard(inter: Column, size_a: Column, size_b: Column, on_empty: float | None = 0.0) -> Column:
    """Exact Jaccard; on_empty is its value for two empty sets (None: null)."""
    union = size_a + size_b - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(on_empty).cast("double"))


def matches(signature: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """pairs with k and v: slots that both sets have, and those in which value is equal."""
    side = lambda s: signature.select(F.col("set_id").alias(s), "coord", F.col(value).alias(f"v_{s}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "coord"])
    return rows.groupBy("a", "b").agg(F.count("*").alias("k"), F.count_if(F.col("v_a") == F.col("v_b")).alias("v"))


def corrected(v: Column, k: Column, m: int) -> Column:
    """Jaccard from bucket matches, corrected for chance matches, clamped to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v / k - F.lit(1.0 / m)) / F.lit(1.0 - 1.0 / m)))


def bucket_label(j: Column) -> Column:
    """The half-open class of a Jaccard value."""
    return F.when(j < 0.1, "b00_10").when(j < 0.3, "b10_30").when(j < 0.6, "b30_60").otherwise("b60_100")


BUCKETS = ("b00_10", "b10_30", "b30_60", "b60_100")


def absolute_error(estimate: Column, exact: Column) -> Column:
    return F.abs(estimate - exact)


def relative_error(estimate: Column, exact: Column) -> Column:
    """Null where the exact value is 0."""
    return F.when(exact != 0, F.abs(estimate - exact) / exact)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)

"""Sets as indicator vectors over a universe of whole numbers, cut into chunks of 64.

A chunk is one BIGINT, a bit for each element; chunks without an element have no row. Each
set's chunks are made once by an aggregate that sums bits up before rows move; after it no
element is a row any more. Two sets meet chunk by chunk: an equi-join on (set, chunk), a
bit-and and a count of bits, all in generated code. A set that fills its universe has a
64th of its elements as rows, a sparse one never more rows than elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64


def chunked(sets: DataFrame, universe: int | None = None) -> DataFrame:
    """(set_id, chunk, bits) of (set_id, element); repeated elements count once.

    With a universe, an element outside 0..universe - 1, or null, is an error; without one any
    BIGINT has its place and null is no element.
    """
    element, rows = F.col("element"), sets
    if universe is None:
        rows = sets.where(element.isNotNull())
    else:
        outside = F.raise_error(F.concat(F.lit(f"an element outside the universe of {universe}: "), F.coalesce(element.cast("string"), F.lit("null")))).cast(sets.schema["element"].dataType)
        element = F.when((element >= 0) & (element < universe), element).otherwise(outside)
    at = rows.select("set_id", element.cast("bigint").alias("e"))
    # floor and the low six bits agree on negative numbers, too
    chunk, bit = F.shiftright("e", 6), F.col("e").bitwiseAND(F.lit(CHUNK - 1)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    return at.select("set_id", chunk.alias("chunk"), one.alias("bit")).groupBy("set_id", "chunk").agg(F.bit_or("bit").alias("bits"))


def sizes(chunks: DataFrame) -> DataFrame:
    """(set_id, n, chunks): each set's elements and the chunks that hold them."""
    return chunks.groupBy("set_id").agg(F.sum(F.bit_count("bits")).alias("n"), F.count("*").alias("chunks"))


def products(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, inter) of the pairs whose vectors have a product above zero."""
    side = lambda s: chunks.select(F.col("set_id").alias(s), "chunk", F.col("bits").alias(f"bits_{s}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "chunk"])
    common: Column = F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b"))).cast("bigint")
    return both.groupBy("a", "b").agg(F.sum(common).alias("inter")).where("inter > 0")


def overlaps(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with inter, size_a and size_b, zero where a set is empty or unknown."""
    n = sizes(chunks)
    out = pairs.join(products(chunks, pairs), ["a", "b"], "left")
    for s in "ab":
        out = out.join(n.select(F.col("set_id").alias(s), F.col("n").alias(f"size_{s}")), s, "left")
    return out.select(*pairs.columns, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("inter", "size_a", "size_b")])

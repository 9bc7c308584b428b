"""MinHash signatures, bottom-d sketches and their encodings.

Sets are long tables (set_id, element); a set without rows does not exist. An element that
many sets share is hashed once: ranks are made per distinct element and coordinate, joined
back and reduced by a partial and final min, all on BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinset.functions import hashing as H
from kinset.sources.workspace import stored


#: Slots that are made side by side in one aggregate at most; more would outgrow generated code.
WIDE_SLOTS = 32
#: Digests of a set that are read as numbers for one minimum, on average; one set in 10 million has none that low.
READ = 16
#: Sketches with such a minimum that are broadcast at most.
FEW = 10_000


def coordinates(k: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias("coord")


def rank_array(element: Column, k: int, seed: int = 42, domain: str = H.MINHASH) -> Column:
    """The k ranks of an element, one for each coordinate, as one array of ordered BIGINTs.

    One expression over the coordinates: k of them side by side take longer to compile than
    many elements take to hash.
    """
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: H.hex_to_ordered(H.minhash_rank(element, c, seed, domain)))


def element_ranks(elements: DataFrame, k: int, seed: int = 42, domain: str = H.MINHASH) -> DataFrame:
    """(element, coord, rank) with rank an ordered BIGINT, for every element of elements."""
    spread = elements.select("element", coordinates(k))
    return spread.select("element", "coord", H.hex_to_ordered(H.minhash_rank(F.col("element"), F.col("coord"), seed, domain)).alias("rank"))


def _distinct(sets: DataFrame) -> DataFrame:
    """The elements of all sets, once each.

    As a column of its own: a lambda over a column that both sides of a join share is bound to
    the wrong side by the planner.
    """
    return sets.groupBy(F.col("element").alias("__e")).agg(F.first("element").alias("element")).select("element")


def _joined(sets: DataFrame, elements: DataFrame) -> DataFrame:
    """sets with what elements says of each element."""
    named = elements.withColumnRenamed("element", "__element")
    return sets.join(named, F.col("element") == F.col("__element")).drop("__element")


def _ranked(sets: DataFrame, k: int, seed: int, domain: str, shared: bool) -> DataFrame:
    """(set_id, block, ranks): each row of sets once for each block of coordinates, with its ranks there."""
    blocks = [(c, min(WIDE_SLOTS, k - c)) for c in range(0, k, WIDE_SLOTS)]
    if len(blocks) == 1:
        ranks = rank_array(F.col("element"), k, seed, domain)
        if not shared:
            return sets.select("set_id", F.lit(0).alias("block"), ranks.alias("ranks"))
        return _joined(sets, _distinct(sets).select("element", ranks.alias("ranks"))).select("set_id", F.lit(0).alias("block"), "ranks")
    # more coordinates than stand side by side: a row for each block, not for each coordinate
    each = lambda df: df.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("at"), F.lit(n).alias("n")) for c, n in blocks])).alias("b"))
    ranks = F.transform(F.sequence(F.col("b.at"), F.col("b.at") + F.col("b.n") - 1), lambda c: H.hex_to_ordered(H.minhash_rank(F.col("element"), c, seed, domain)))
    made = lambda df: each(df).withColumn("ranks", ranks).withColumn("block", F.col("b.at"))
    if not shared:
        return made(sets).select("set_id", "block", "ranks")
    return _joined(sets, made(_distinct(sets)).select("element", "block", "ranks")).select("set_id", "block", "ranks")


def minhash(sets: DataFrame, k: int, seed: int = 42, domain: str = H.MINHASH, shared: bool = True) -> DataFrame:
    """(set_id, coord, rank): the least rank of each set at each of k coordinates.

    shared: hash distinct elements once and join. Without it every row is hashed where it
    stands, which moves less where few sets share elements. Either way an element's ranks are
    one array and a set's minima stand side by side, so no row is multiplied by k.
    """
    rows = _ranked(sets, k, seed, domain, shared)
    least = [F.min(F.get("ranks", F.lit(c))).alias(f"r{c}") for c in range(min(k, WIDE_SLOTS))]
    wide = rows.groupBy("set_id", "block").agg(*least)
    slots = F.posexplode(F.array(*[F.col(f"r{c}") for c in range(min(k, WIDE_SLOTS))])).alias("at", "rank")
    return wide.select("set_id", "block", slots).where("rank IS NOT NULL").select("set_id", (F.col("block") + F.col("at")).cast("bigint").alias("coord"), "rank")


def array_minima(sets: DataFrame, k: int, seed: int = 42, domain: str = H.MINHASH, read: int = READ) -> DataFrame:
    """(set_id, sketch): the k least ranks of each set (set_id, elements) among those below a bound.

    To read a digest as a number takes longer than to make it. The bound lets read of a set's
    digests pass, on average; where none is below it, the rank is null. A set stands in one
    row, so only minima move.
    """
    if k > WIDE_SLOTS:
        raise ValueError(f"at most {WIDE_SLOTS} slots")
    bounded = sets.select("set_id", "elements", H.share_bound(F.size("elements"), read).alias("bound"))
    rows = bounded.select("set_id", "bound", F.explode("elements").alias("element")).select("set_id", "bound", H.be64(F.col("element")).alias("raw"))

    def least(c: int) -> Column:
        made = H.digest(domain, F.lit(seed.to_bytes(8, "big") + c.to_bytes(4, "big")), F.col("raw"))
        return F.min(F.when(made < F.col("bound"), H.hex_to_ordered(F.substr(made, F.lit(1), F.lit(16)))))

    wide = rows.groupBy("set_id").agg(*[least(c).alias(f"r{c}") for c in range(k)])
    return wide.select("set_id", F.array(*[F.col(f"r{c}") for c in range(k)]).alias("sketch"))


def array_minhash(sets: DataFrame, k: int, seed: int = 42, domain: str = H.MINHASH, read: int = READ) -> DataFrame:
    """(set_id, sketch): the k least ranks of each set (set_id, elements), as one array.

    Ranks that `array_minima` leaves null are made from all elements of their sets.
    """
    found = stored(array_minima(sets, k, seed, domain, read), "minima")
    lacking = F.exists("sketch", F.isnull)
    rest = found.where(lacking)
    count = rest.count()
    if not count:
        return found
    if count <= FEW:
        rest = F.broadcast(rest)  # so few need not move all sets
    least = lambda c: F.array_min(F.transform("elements", lambda e: H.hex_to_ordered(H.minhash_rank(e, c, seed, domain))))
    whole = sets.join(rest, "set_id").select("set_id", F.transform("sketch", lambda r, c: F.coalesce(r, least(c))).alias("sketch"))
    return found.where(~lacking).unionByName(whole)


def minhash_trials(sets: DataFrame, k: int, trials: int, domain: str = H.MINHASH) -> DataFrame:
    """(set_id, trial, coord, rank): signatures under the seeds 0..trials - 1, k slots each.

    An element's ranks of one trial are one array, so a row is multiplied by the trials but not
    by the slots, whose minima stand side by side; k is at most WIDE_SLOTS.
    """
    if k > WIDE_SLOTS:
        raise ValueError(f"at most {WIDE_SLOTS} slots")
    seed = H.be64(F.col("trial"))
    ranks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: H.hex_to_ordered(H.rank_hex(domain, seed, H.be32(c), H.be64(F.col("element")))))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trials - 1).cast("bigint"))).alias("trial")
    elements = _distinct(sets).select("element", every).withColumn("ranks", ranks)
    wide = _joined(sets, elements).groupBy("set_id", "trial").agg(*[F.min(F.get("ranks", F.lit(c))).alias(f"r{c}") for c in range(k)])
    return wide.select("set_id", "trial", F.posexplode(F.array(*[F.col(f"r{c}") for c in range(k)])).alias("coord", "rank")).withColumn("coord", F.col("coord").cast("bigint"))


def bucketed(signature: DataFrame, m: int) -> DataFrame:
    """(set_id, coord, bucket): the one-hot position of each slot of a signature."""
    return signature.select("set_id", "coord", H.ordered_mod(F.col("rank"), m).alias("bucket"))


def bottom(sets: DataFrame, k: int, d: int, seed: int = 42, domain: str = H.MINHASH) -> DataFrame:
    """(set_id, coord, pos, rank): the d least distinct ranks of each set at each coordinate."""
    order = Window.partitionBy("set_id", "coord").orderBy("rank")
    ranks = _distinct(sets).select("element", rank_array(F.col("element"), k, seed, domain).alias("ranks"))
    rows = _joined(sets, ranks).select("set_id", F.posexplode("ranks").alias("coord", "rank"))
    # the rank limit goes below the exchange; equal ranks share a place and are one row after it
    placed = rows.withColumn("pos", F.dense_rank().over(order)).where(F.col("pos") <= d)
    return placed.select("set_id", F.col("coord").cast("bigint").alias("coord"), "pos", "rank").distinct()


def onehot(buckets: Column, m: int) -> Column:
    """The 0/1 vector of length k * m of an array of k buckets."""
    return F.flatten(F.transform(buckets, lambda b: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: (i == b).cast("int"))))


def onehot_decoded(vector: Column, m: int) -> Column:
    """The buckets of a one-hot vector; a block without a one gives 0."""
    k = (F.size(vector) / m).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda c: F.greatest(F.lit(0), F.array_position(F.slice(vector, c * m + 1, F.lit(m)), 1).cast("int") - 1))


def digits(bucket: Column, m: int) -> tuple[Column, Column]:
    """(low, high) digits of a bucket to base sqrt(m); m is a power of four, 4 at least."""
    base = int(m**0.5)
    if m < 4 or base * base != m or m & (m - 1):
        raise ValueError("m must be a power of four, at least 4")
    return bucket % base, F.floor(bucket / base)

"""SimHash near-duplicates: fingerprints, a binary-trie self-join, connected groups.

Fingerprint: texts are lower-cased (A-Z), words are ``[^\\x20\\x09-\\x0D]+``, shingles are
3 consecutive words joined by a space (a shorter text is one shingle; no words: fingerprint
zero). A bit is set where more than half of the shingles' XXH64 (seed 42) have it set.

Self-join: two fingerprints within 2 differing bits agree on one of three blocks of bits,
so the trie is entered three times, each time below a block on which no error is spent.
The subtries below all values of a block are dealt out by that value, and in a task all of
them are traversed together: a frontier of node pairs descends bit by bit, adding up
differing bits, and a pair goes when its sum passes the budget. A subtrie with very many
leaves is entered by more bits: the whole error budget is carried to the bits that are left,
these are cut into three blocks again, and one of them is free of errors. Each such level
takes three rows of each fingerprint that is crowded, no matter how many share its value,
and after four levels so few bits are left that no unit can be crowded. A unit reports a
spanning forest of its links, not the links: connectivity stays whole while rows stay linear.

Groups: large-star/small-star rounds over the forests, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.llm.common import fresh, partitions_for, release, ship, stored

SHINGLE = 3
SEED = 42
BUDGET = 2
#: (first bit from the top, bits) of the blocks; one more than the budget.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Leaves of one unit of the traversal; a unit with more is entered by more bits. Fewer
#: bits than this has are never cut.
UNIT_LEAVES = 8192
#: Node pairs that descend together.
FRONTIER = 1 << 19
_BITS_AT_ONCE = 1 << 17


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every shingle of a text, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start[: 1 - SHINGLE].tolist(), end[SHINGLE - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a text, as a signed integer."""
    h = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), _BITS_AT_ONCE):
        part = h[k : k + _BITS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def text_hash(text: Column) -> Column:
    """Tells texts of one id apart; null and empty count as the same text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.large_binary())
        out = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.int64, len(texts))
        yield pa.record_batch([b.column(0), pa.array(out), b.column(2)], names=["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash) of every row; a null text counts as empty, rows repeat as given."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash(F.col(text_col)).alias("text_hash"))
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, fp long, text_hash long")


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the ends of links: every member gets the least label of its group."""
    while True:
        x, y = labels[a], labels[b]
        odd = x != y
        if not odd.any():
            return
        a, b, x, y = a[odd], b[odd], x[odd], y[odd]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            nxt = labels[labels]
            if np.array_equal(nxt, labels):
                break
            labels[:] = nxt


def trie_forest(fps: np.ndarray, bounds: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Labels of the linked groups inside each unit.

    fps: unsigned, ascending and distinct within each unit; bounds: where units begin, and
    the end. Traverses the tries of all units together. The label is the position of a
    group's first fingerprint.
    """
    labels = np.arange(len(fps))
    ones = np.zeros(len(fps) + 1, np.int64)
    lo, hi = bounds[:-1], bounds[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    # frontier columns: node a (lo, hi), node b (lo, hi), bits that differ so far; a node
    # paired with itself stands for all pairs inside it
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack.append((depth, alo[half:], ahi[half:], blo[half:], bhi[half:], diff[half:]))
            stack.append((depth, alo[:half], ahi[:half], blo[:half], bhi[:half], diff[:half]))
            continue
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            x, y = alo[leaf], blo[leaf]
            near = np.bitwise_count(fps[x] ^ fps[y]) <= budget
            join_labels(labels, x[near], y[near])
            rest = ~leaf
            alo, ahi, blo, bhi, diff = alo[rest], ahi[rest], blo[rest], bhi[rest], diff[rest]
        if not len(alo) or depth == 64:
            continue
        np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1), out=ones[1:], dtype=np.int64)
        amid = ahi - (ones[ahi] - ones[alo])
        bmid = bhi - (ones[bhi] - ones[blo])
        same = alo == blo
        parts = [
            (alo, amid, blo, bmid, diff),  # 0 with 0
            (amid, ahi, bmid, bhi, diff),  # 1 with 1
            (alo, amid, bmid, bhi, diff + 1),  # 0 with 1
            tuple(x[~same] for x in (amid, ahi, blo, bmid, diff + 1)),  # 1 with 0
        ]
        cols = [np.concatenate(c) for c in zip(*parts)]
        alo, ahi, blo, bhi, diff = cols
        keep = (diff <= budget) & (ahi > alo) & (bhi > blo) & ~((alo == blo) & (ahi - alo == 1))
        stack.append((depth + 1, alo[keep], ahi[keep], blo[keep], bhi[keep], diff[keep]))
    return labels


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    mask, fps = (np.concatenate(c).view(np.uint64) for c in zip(*got))
    value = mask & fps
    order = np.lexsort((fps, value, mask))
    mask, value, fps = mask[order], value[order], fps[order]
    # two crowded units can lead to one finer unit, by different blocks
    once = np.ones(len(fps), bool)
    once[1:] = (mask[1:] != mask[:-1]) | (fps[1:] != fps[:-1])
    mask, value, fps = mask[once], value[once], fps[once]
    new = np.flatnonzero((np.diff(mask) != 0) | (np.diff(value) != 0)) + 1
    labels = trie_forest(fps, np.concatenate([[0], new, [len(fps)]]))
    linked = np.flatnonzero(labels != np.arange(len(fps)))
    pairs = np.unique(np.stack([fps[labels[linked]], fps[linked]], axis=1), axis=0) if len(linked) else np.zeros((0, 2), np.uint64)
    yield pa.record_batch([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"])


def finer(mask: int) -> list[int]:
    """The masks of one level more: mask and one of the blocks of the bits it leaves."""
    rest = [b for b in range(64) if not mask >> b & 1]
    n = len(BLOCKS)
    parts = [rest[len(rest) * i // n : len(rest) * (i + 1) // n] for i in range(n)]
    return [mask | sum(1 << b for b in part) for part in parts]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, n: int) -> DataFrame:
    """(a, b): spanning links among n distinct fingerprints (column fp) at 2 or fewer bits."""
    spark = fps.sparkSession
    ship(spark)
    levels, masks = [], [((1 << bits) - 1) << (64 - first - bits) for first, bits in BLOCKS]
    level = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    value = F.col("mask").bitwiseAND(F.col("fp"))
    # a unit of few bits holds at most their power of two of distinct fingerprints
    while 64 - min(m.bit_count() for m in masks) > max(UNIT_LEAVES.bit_length() - 1, 3):
        crowded = stored(level.groupBy("mask", value.alias("value")).count().where(F.col("count") > UNIT_LEAVES).select("mask", "value"), "crowded")
        if crowded.isEmpty():
            break
        unit = ["mask", "value"]
        levels.append(level.withColumn("value", value).join(crowded, unit, "left_anti").select("fp", "mask"))
        below = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in finer(m)]))])
        inside = level.withColumn("value", value).join(crowded, unit, "left_semi")
        level = stored(inside.select("fp", F.explode(F.element_at(below, F.col("mask"))).alias("mask")), "finer")
        masks = sorted({f for m in masks for f in finer(m)})
    for other in levels:
        level = level.unionByName(other)
    parts = partitions_for(spark, 3 * n, 2_000_000)
    return level.select("mask", "fp").repartition(parts, "mask", value).mapInArrow(_forests, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): the least node that it reaches."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    before = None
    while True:
        # large star: each node's larger neighbours move to its least neighbour
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: each node and its smaller neighbours move to the least of these
        large = stored(large.distinct(), "large")
        release(now)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(moved.union(small).distinct(), "small")
        release(large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = state


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash, component_id) for every row: the least id that links reach.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and
    repeated ids stay; a null id is never a component's id unless the group has no other.
    An empty table gives an empty result. Other columns are not looked at.
    """
    fp = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(firsts, firsts.count()))
    rooted = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fp.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """The digest of op10: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicate_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near-copies: of each group the row with the least id stays.

    Of several such rows the one with the least text hash stays, and one of equal rows; a
    null id comes last. Columns are those of docs, whatever they are called.
    """
    groups = near_duplicate_groups(docs, id_col, text_col)
    id_, text_ = fresh(docs, "id", "text")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("k"))
    best = stored(best.select(F.col("k.doc_id").alias(id_), F.col("k.text_hash").alias(text_)), "kept")
    same = docs[id_col].eqNullSafe(F.col(id_)) & (text_hash(docs[text_col]) == F.col(text_))
    kept = docs.join(best, same, "left_semi")
    rows = stored(groups.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(text_)), "repeated")
    if rows.isEmpty():
        return kept
    same = kept[id_col].eqNullSafe(F.col(id_)) & (text_hash(kept[text_col]) == F.col(text_))
    return kept.join(rows, same, "left_anti").unionByName(kept.join(rows, same, "left_semi").dropDuplicates([id_col, text_col]))

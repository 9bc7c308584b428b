"""LM scoring by a weighted backoff automaton.

Model: word n-grams of up to ``ORDER`` words with Dirichlet smoothing of each order towards
the next lower one, P(w | u v) = (c(u v w) + K P(w | v)) / (c(u v) + K), down to word
probabilities that absolute discounting smooths. All words that training lacks are one symbol,
so probabilities of the known words and that symbol sum to one after every context. As an
automaton: a state for each context that training holds, of up to ORDER - 1 words, and a
root; an arc for each seen n-gram, to the state of its longest suffix that is a context; a
failure arc of weight K / (c + K) from each state to that of the context without its first
word; root arcs of weight P(w).

The whole automaton grows with the corpus and is never in one place. The rows of each input
partition are cut into blocks of a bounded number of bytes, which are stored; a block states
which n-grams its texts hold and how often its training texts do, packed by ranges of the
n-grams' 64-bit keys, for the ranges that it has keys in. For each range the blocks' counts
are added up and each block gets back the totals of its own n-grams. With these a block builds
the slice of the automaton that its texts can reach and runs its texts through it from left
to right: each walker carries its state and adds up log probabilities. (A long text has many
walkers; all but the first begin in the state in which the words before leave it.) No count is
pruned, capped or sampled, and rows that are equal may stand in different blocks.

Rows that are shuffled: at most one for each block and range that share a key, so never more
than there are distinct n-grams in blocks. Words are told apart by 62 bits of a non-linear hash, longer n-grams by 58,
whatever the size of the corpus: of 10^11 n-grams less than one in a million would share a key
with another and have its count added to that one's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinset.llm import bytetext as bt
from kinset.llm.common import fold_of, ship, stored

FOLDS, HELD_OUT = 7, 2
ORDER = 3
#: Weight (K above) of the lower order in the probability of an n-gram of two, three, .. words.
#: Chosen among 30 pairs on training rows alone: learned from those of remainder 0, 1, 4, 5 and
#: 6 by crc32 of the id modulo 7, scored on those of remainder 3.
PRIORS = (3000.0, 3.0)
#: Bytes of text in a block and n-grams in a range, on average.
BLOCK_BYTES = 6 << 20
RANGE_KEYS = 1_500_000
#: Tokens that a walker takes.
WALK = 256

END = np.uint64(0x6A09E667F3BCC909)
#: Keys of words stand below this one, which counts the texts; n-grams stand from twice it on.
_BEGIN = np.uint64(1 << 62)
_TWO = np.uint64(2)
#: Bits of the 62 that keys of two and more words leave out, at every size.
_CUT = np.uint64(4)


def _pack(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): every text's words and its end, and where each text begins (n+1)."""
    parts, counts = [], []
    for slab in bt.slabs(column):
        lower = bt.LOWER[slab.buf]
        start, end, first = slab.words(bt.NOT_SPACE, lower)
        parts.append(np.insert(bt.Hasher(lower)(start, end), first[1:], END))
        counts.append(np.diff(first) + 1)
    first = np.concatenate([[0], *counts]).cumsum()
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), first


class Block:
    """The n-grams of a block's texts, by local numbers, and the keys they are sent by.

    Level 1 are words, level k n-grams of k words, those at a text's begin led by a begin
    sign. word: each token's word; gram[k]: each token's n-gram of level k, -1 where the text
    begins too late for one; parent[k], last[k]: of each n-gram the one (of a level less) that
    it begins with, and its last word; suffix[k]: the n-gram of a level less that it ends in.
    """

    def __init__(self, column: pa.ChunkedArray, train: np.ndarray, order: int):
        h, self.first = tokens(column)
        n = len(h)
        keys, self.word = np.unique(h >> _TWO, return_inverse=True)
        self.word = self.word.astype(np.int32)  # local numbers of a block's n-grams are small
        self.words, self.order = len(keys), order
        used = np.repeat(train, np.diff(self.first)).astype(np.float64)
        at = np.arange(n) - np.repeat(self.first[:-1], np.diff(self.first))
        begin = at == 0
        # level-1 contexts: 0 the begin of a text, 1 + k after word k
        context = np.concatenate([[0], self.word[:-1] + 1])[:n]
        context[begin] = 0
        ends = np.concatenate([[_BEGIN], keys]).astype(np.uint64)
        self.gram, self.parent, self.last, self.suffix = {1: self.word}, {}, {}, {}
        self.keys, counts = [keys, np.array([_BEGIN])], [np.bincount(self.word, used, len(keys)), np.array([train.sum()])]
        some = np.arange(n)
        for k in range(2, order + 1):
            if k > 2:
                some = np.flatnonzero(at >= k - 2)
                context = self.gram[k - 1][some - 1]
            pairs, first, inverse = np.unique(context.astype(np.int64) * self.words + self.word[some], return_index=True, return_inverse=True)
            self.parent[k], self.last[k] = (x.astype(np.int32) for x in np.divmod(pairs, max(self.words, 1)))
            self.suffix[k] = self.gram[k - 1][some[first]]
            self.gram[k] = np.full(n, -1, np.int32)
            self.gram[k][some] = inverse
            ends = (bt.chain(ends[self.parent[k]], keys[self.last[k]]) >> (_TWO + _CUT) << _CUT) | np.uint64((2 if k == 2 else 3) << 62)
            self.keys.append(ends)
            counts.append(np.bincount(inverse, used[some], len(pairs)))
        self.cut = np.cumsum([0, *map(len, self.keys)])
        flat = np.concatenate(self.keys)
        self.sorted = np.argsort(flat)
        self.keys, self.counts = flat[self.sorted], np.concatenate(counts).astype(np.uint64)[self.sorted]

    def totals(self, got: np.ndarray) -> list[np.ndarray]:
        """Totals of the sorted keys as one array for each level, the begin sign's second."""
        flat = np.empty(len(got), np.float64)
        flat[self.sorted] = got
        return [flat[a:z] for a, z in zip(self.cut[:-1], self.cut[1:])]


class Slice:
    """The part of the automaton that one block's texts can reach.

    States are numbered: 0 the root; then, level by level, the contexts (level 1: the begin
    of a text and the words). whole, distinct, once, twice: training tokens, words, and words
    seen once and twice.
    """

    def __init__(self, block: Block, got: np.ndarray, facts: tuple[int, int, int, int], priors: tuple[float, ...]):
        whole, distinct, once, twice = facts
        total = block.totals(got)
        self.block, self.count = block, total[0]
        discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05
        unseen = discount * distinct / whole if whole else 1.0
        share = np.where(self.count > 0, np.maximum(self.count - discount, 0) / max(whole, 1), unseen)
        size = np.concatenate([total[1], self.count])
        #: where the states of each level begin
        self.begin = {1: 1}
        # log probability of a failure arc and the state it leads to, by state
        fail, shorter = [np.zeros(1), np.log10(priors[0] / (size + priors[0]))], [np.zeros(1 + len(size), np.int64)]
        self.root = np.log10(share)
        self.from_root = np.where(self.count > 0, np.arange(len(share)) + 2, 0)
        self.arcs, self.weight, self.target = {}, {}, {}
        lower = share
        #: a token's n-gram of a level as a state, 0 where training lacks it
        self.state = {1: self.from_root}
        for k in range(2, block.order + 1):
            count, prior = total[k], priors[k - 2]
            parent, last, suffix = block.parent[k], block.last[k], block.suffix[k]
            p = (count + prior * lower[suffix]) / (size[parent] + prior)
            seen = count > 0
            self.arcs[k] = (parent.astype(np.int64) * block.words + last)[seen]
            self.weight[k] = np.log10(p[seen])
            if k < block.order:
                self.begin[k] = self.begin[k - 1] + len(size)
                self.state[k] = np.where(seen, np.arange(len(count)) + self.begin[k], 0)
                fail.append(np.log10(priors[k - 1] / (count + priors[k - 1])))
                shorter.append(self.state[k - 1][suffix])
                self.target[k] = self.state[k][seen]
                lower, size = p, count
            else:
                self.target[k] = self.state[k - 1][suffix[seen]]
        self.fail, self.shorter = np.concatenate(fail), np.concatenate(shorter)

    def entry(self, token: np.ndarray) -> np.ndarray:
        """The state in which each of these tokens leaves its text: the longest seen context."""
        out = np.zeros(len(token), np.int64)
        for k in range(max(1, self.block.order - 1), 0, -1):
            gram = self.block.gram[k][token]
            out = np.where((out == 0) & (gram >= 0), self.state[k][gram], out)
        return out

    def scores(self) -> np.ndarray:
        """log10 probability of each text; all walkers advance together, token by token."""
        first = self.block.first
        size = np.diff(first)
        walkers = -(-size // WALK)
        text = np.repeat(np.arange(len(size)), walkers)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(walkers) - walkers, walkers)
        start = first[:-1][text] + nth * WALK
        steps = np.minimum(first[1:][text] - start, WALK)
        state = np.where(nth == 0, 1, self.entry(np.maximum(start - 1, 0)))
        order = np.argsort(-steps, kind="stable")
        start, state, total = start[order], state[order], np.zeros(len(order))
        active = np.searchsorted(-steps[order], -np.arange(1, WALK + 1), side="right")
        for t, n in enumerate(active[active > 0].tolist()):
            step, state[:n] = self._step(state[:n], self.block.word[start[:n] + t])
            total[:n] += step
        return np.bincount(text[order], total, len(size))

    def _step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability, state) of reading a word in each state."""
        gain, out = np.zeros(len(state)), np.empty(len(state), np.int64)
        todo = np.arange(len(state))
        for k in range(self.block.order, 1, -1):
            # walkers in states of this level try its arcs, else the failure arc
            here = np.flatnonzero(state[todo] >= self.begin[k - 1])
            i = todo[here]
            at = bt.found_in((state[i] - self.begin[k - 1]) * self.block.words + word[i], self.arcs[k])
            good, bad = i[at >= 0], i[at < 0]
            gain[good] += self.weight[k][at[at >= 0]]
            out[good] = self.target[k][at[at >= 0]]
            gain[bad] += self.fail[state[bad]]
            state[bad] = self.shorter[state[bad]]
            stay = np.ones(len(todo), bool)
            stay[here[at >= 0]] = False
            todo = todo[stay]
        gain[todo] += self.root[word[todo]]
        out[todo] = self.from_root[word[todo]]
        return gain, out


def _edges(ranges: int, order: int) -> np.ndarray:
    """Where the 2nd and later ranges of keys begin: few for words, more for longer n-grams."""
    quarter, words = 1 << 62, max(1, ranges // 12)
    pairs, longer = max(1, ranges * 5 // 12), max(1, ranges // 2 * max(0, order - 2))
    cuts = [quarter * k // words for k in range(1, words)] + [2 * quarter + quarter * k // pairs for k in range(pairs)]
    return np.array(cuts + [3 * quarter + quarter * k // longer for k in range(longer)], np.uint64)


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(block, data): the rows of each partition in blocks of about block_bytes, stored.

    A longer text is a block of its own. data is an Arrow stream, compressed.
    """

    def packed(number: int, part: list[pa.RecordBatch]) -> pa.RecordBatch:
        from pyspark import TaskContext

        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for b in part:
                out.write_batch(b)
        return pa.record_batch([pa.array([TaskContext.get().partitionId() << 32 | number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, number = [], 0, 0
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < b.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo if part else lo + 1, int(np.searchsorted(ends, before + block_bytes - size, side="right")))
                part.append(b.slice(lo, hi - lo))
                size += int(ends[hi - 1]) - before if hi > lo else 0
                lo = hi
                if lo < b.num_rows:
                    yield packed(number, part)
                    part, size, number = [], 0, number + 1
        if part:
            yield packed(number, part)

    return stored(rows.mapInArrow(pack, "block long, data binary"), "blocks")


def scored(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, priors: tuple[float, ...] = PRIORS, block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """One row for each of docs: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    train: a column that is true for the texts to learn from. order: words of the longest
    n-grams, 2 at least; priors: one for each length from 2 on. A null or empty text is one
    token, its end. Rows repeat as given, each counts; null ids are allowed. Without
    training texts every token is the unknown symbol, of probability 1. Other columns are not
    looked at.
    """
    if order < 2 or len(priors) < order - 1:
        raise ValueError("an order of 2 or more and a prior for each length from 2 on")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = _blocks(rows, block_bytes)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a text has about an n-gram of each length for 8 bytes
    edges = _edges(max(1, -(-size * (order - 1) // 8 // range_keys)), order)

    def block_of(data: bytes) -> tuple[pa.Table, Block]:
        table = pa.ipc.open_stream(data).read_all()
        return table, Block(table["text"], table["train"].combine_chunks().to_numpy(zero_copy_only=False), order)

    def cuts(b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Where each range ends among the keys, and the ranges that have any."""
        cut = np.concatenate([[0], np.searchsorted(b.keys, edges), [len(b.keys)]])
        return cut, np.flatnonzero(np.diff(cut))

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, b = block_of(data.as_buffer())
                cut, some = cuts(b)
                for r in some.tolist():
                    k, c = b.keys[cut[r] : cut[r + 1]], b.counts[cut[r] : cut[r + 1]]
                    yield pa.RecordBatch.from_pylist([{"part": r, "block": number, "n": len(k), "keys": _pack(np.diff(k, prepend=np.uint64(0))), "counts": _pack(c)}], pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def merge(table: pa.Table) -> pa.Table:
        n = table["n"].to_pylist()
        keys = np.concatenate([np.cumsum(_unpack(raw, k), dtype=np.uint64) for raw, k in zip(table["keys"].to_pylist(), n)])
        counts = np.concatenate([_unpack(raw, k) for raw, k in zip(table["counts"].to_pylist(), n)])
        by = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[by[1:]] != keys[by[:-1]]
        total = np.add.reduceat(counts[by], np.flatnonzero(new))
        mine = np.empty(len(keys), np.uint64)
        mine[by] = total[np.cumsum(new) - 1]
        words = total[keys[by[new]] < _BEGIN]
        cut = np.concatenate([[0], np.cumsum(n)])
        out = {"block": table["block"].combine_chunks(), "part": table["part"].combine_chunks(), "totals": pa.array([_pack(mine[a:z]) for a, z in zip(cut[:-1], cut[1:])], pa.binary())}
        for name, v in (("whole", words.sum()), ("distinct", (words > 0).sum()), ("once", (words == 1).sum()), ("twice", (words == 2).sum())):
            out[name] = pa.array(np.full(len(n), v, np.int64))
        return pa.table(out)

    stated = blocks.mapInArrow(state, "part int, block long, n long, keys binary, counts binary")
    names = ["whole", "distinct", "once", "twice"]
    totals = stated.repartition(len(edges) + 1, "part").groupBy("part").applyInArrow(merge, "block long, part int, totals binary, " + ", ".join(f"{x} long" for x in names))
    totals = stored(totals, "totals")
    ranges = totals.groupBy("part").agg(*[F.max(x).alias(x) for x in names])
    facts = tuple(int(x or 0) for x in ranges.agg(*[F.sum(x) for x in names]).first())
    whole, distinct = facts[:2]

    def score(given: pa.Table, got: pa.Table) -> pa.Table:
        table, b = block_of(given["data"][0].as_buffer())
        cut, _ = cuts(b)
        totals = np.zeros(len(b.keys), np.uint64)
        for r, raw in zip(got["part"].to_pylist(), got["totals"]):
            totals[cut[r] : cut[r + 1]] = _unpack(raw.as_buffer(), cut[r + 1] - cut[r])
        model = Slice(b, totals, facts, priors)
        base = np.log10(model.count + 1) - np.log10(whole + distinct + 1)
        # each text summed up alone, so that equal texts have equal sums; none is without a token
        sums = lambda x: np.add.reduceat(x, b.first[:-1])
        return pa.table(
            {
                "doc_id": table["doc_id"].combine_chunks(),
                "train": table["train"].combine_chunks(),
                "n_tokens": pa.array(np.diff(b.first)),
                "n_known": pa.array(sums((model.count > 0)[b.word].astype(np.int64))),
                "train_tokens": pa.array(np.full(len(b.first) - 1, whole)),
                "base_score": pa.array(sums(base[b.word])),
                "score": pa.array(model.scores()),
            }
        )

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    count = max(1, blocks.count())
    both = blocks.repartition(count, "block").groupBy("block").cogroup(totals.select("block", "part", "totals").repartition(count, "block").groupBy("block"))
    return both.applyInArrow(score, out)


def query(docs: DataFrame) -> DataFrame:
    """The digest of op5: doc_id, held_out, counts, base_score and score."""
    return scored(docs, fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).withColumnRenamed("train", "held_out").withColumn("held_out", ~F.col("held_out"))

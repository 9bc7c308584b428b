"""Vectorised views of Arrow text columns: UTF-8 bytes, words, lines and their hashes.

Python strings are never made here. A text column is taken as its byte buffer, cut into
slabs of a MB (a longer text is a slab of its own), and all per-character work is
numpy over the slab. The delimiters of every word rule used are ASCII, so byte rules
equal code-point rules on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLAB_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: Bytes that begin a code point
LEADS = np.ones(256, dtype=bool)
LEADS[0x80:0xC0] = False

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(*parts: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of several 64-bit columns."""
    out = np.full(len(parts[0]), 0x51ED270B35AF1C2D, dtype=np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + p)
    return out


#: Ranges of up to this many bytes are hashed side by side, longer ones one by one.
SHORT = 64
_STEP = np.uint64(0xA24BAED4963EE407)


class Bytes:
    """A buffer read in words of 8 bytes from any position."""

    def __init__(self, buf: np.ndarray):
        padded = np.zeros(len(buf) + 8, np.uint8)
        padded[: len(buf)] = buf
        self.raw = padded
        self.words = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))

    def at(self, where: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The 8 bytes from each position on; those past `left` bytes are 0."""
        out = self.words[where]
        few = np.flatnonzero(left < 8)
        out[few] &= (np.uint64(1) << (left[few] * 8).astype(np.uint64)) - np.uint64(1)
        return out


def same_bytes(a: Bytes, a_start: np.ndarray, a_end: np.ndarray, b: Bytes, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the ranges of a and b hold equal bytes, range by range."""
    size = a_end - a_start
    equal = size == b_end - b_start
    left = np.flatnonzero(equal)
    for k in range(0, SHORT, 8):
        left = left[size[left] > k]
        if not len(left):
            return equal
        n = size[left] - k
        good = a.at(a_start[left] + k, n) == b.at(b_start[left] + k, n)
        equal[left[~good]] = False
        left = left[good]
    for i in left[size[left] > SHORT].tolist():
        equal[i] = np.array_equal(a.raw[a_start[i] : a_end[i]], b.raw[b_start[i] : b_end[i]])
    return equal


class Hasher:
    """64-bit hashes of any byte ranges of a buffer.

    Ranges of up to SHORT bytes go through a non-linear finaliser for every 8 bytes, all
    ranges side by side; longer ones are hashed by XXH64. Nothing of the size of the buffer
    is kept but a copy of it.
    """

    def __init__(self, buf: np.ndarray, seed: int = 0):
        self.bytes = Bytes(buf)
        self.seed = seed

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix(size.astype(np.uint64) * _STEP + np.uint64(self.seed))
        left = np.flatnonzero((size > 0) & (size <= SHORT))
        k = 0
        while len(left):
            out[left] = mix((out[left] + _STEP) ^ self.bytes.at(start[left] + k, size[left] - k))
            k += 8
            left = left[size[left] > k]
        raw = self.bytes.raw
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]], self.seed)
        return out

    def exact(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the ranges, equal where and only where their bytes are equal."""
        seed = self.seed
        while True:
            _, first, at = np.unique(Hasher.__call__(self, start, end), return_index=True, return_inverse=True)
            of = first[at]
            if same_bytes(self.bytes, start, end, self.bytes, start[of], end[of]).all():
                self.seed = seed
                return at
            # two different ranges met in one hash: another seed tells them apart
            self.seed += 1


def text_hash(word: str) -> np.uint64:
    """The hash that Hasher gives a range with these bytes."""
    raw = np.frombuffer(word.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return Hasher(raw)(np.array([0]), np.array([len(raw)]))[0]


@dataclass
class Slab:
    """Texts lo..hi of a batch: their bytes and where each begins (hi-lo+1 offsets)."""

    lo: int
    hi: int
    buf: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def words(self, is_word: np.ndarray, buf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, first): byte ranges of the words, and each text's first word (n+1)."""
        buf = self.buf if buf is None else buf
        w = is_word[buf]
        edge = self.off[:-1][np.diff(self.off) > 0]
        begins, ends = w.copy(), w.copy()
        begins[1:] &= ~w[:-1]
        ends[:-1] &= ~w[1:]
        begins[edge] = w[edge]
        inner = edge[edge > 0] - 1
        ends[inner] = w[inner]
        start = np.flatnonzero(begins)
        return start, np.flatnonzero(ends) + 1, np.searchsorted(start, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""(start, end, first) of the \n-split lines; a text of k breaks has k+1 lines."""
        breaks = np.flatnonzero(self.buf == 10)
        start = np.sort(np.concatenate([self.off[:-1], breaks + 1]), kind="stable")
        # a break at a text's end and the next text's begin share a position: the line
        # after the break comes first
        per = np.searchsorted(breaks, self.off)
        count = np.diff(per) + 1
        first = np.concatenate([[0], np.cumsum(count)])
        end = np.empty(len(start), dtype=np.int64)
        last = first[1:] - 1
        mask = np.ones(len(start), dtype=bool)
        mask[last] = False
        end[mask] = breaks
        end[last] = self.off[1:]
        return start, end, first

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many of the bytes marked in mask each text holds."""
        if len(mask) > 256 * self.n:
            # few texts: a count of each is cheaper than sums at all positions
            return np.array([np.count_nonzero(mask[a:b]) for a, b in zip(self.off[:-1].tolist(), self.off[1:].tolist())], np.int64)
        sums = running(mask)
        return (sums[self.off[1:]] - sums[self.off[:-1]]).astype(np.int64)


def _flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def slabs(column: pa.Array | pa.ChunkedArray, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """The column's texts (null: empty) in slabs of at most limit bytes or one text."""
    column = _flat(column)
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield Slab(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def running(mask: np.ndarray) -> np.ndarray:
    """How many bytes are marked before each position; 4 bytes a position where that will do."""
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the segments first[i]..first[i+1]; empty segments give 0."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return sums[first[1:]] - sums[first[:-1]]


def found_in(keys: np.ndarray, sorted_table: np.ndarray) -> np.ndarray:
    """Position of each key in a sorted table, -1 where it is absent."""
    if not len(sorted_table):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.searchsorted(sorted_table, keys)
    at[at == len(sorted_table)] = 0
    return np.where(sorted_table[at] == keys, at, -1)

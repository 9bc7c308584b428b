"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z) and cut into words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The automaton is built over all items' words, with
one state chain for all items. A document's words are streamed through it; where the
tracked matching length reaches the window length (the window is ``WINDOW`` words, or an
item's whole length where that is less) the words of the match are hit.

Streaming is preceded by a lossless cut: a match of two words or more consists of word
pairs that stand together in some item, so only runs of such pairs are streamed (single
words are looked up where an item is one word long). The automaton, and nothing that
grows with the documents, goes to the tasks; its size is that of the benchmark and is
checked against ``MODEL_WORDS``; a larger benchmark is done in several passes of items.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.llm import bytetext as bt
from kinset.llm.common import shared_dir, ship, stored, uri

WINDOW = 10
#: Words of the items of one automaton, about: some 300 MB in a task.
MODEL_WORDS = 200_000
#: Words of an item above which it is cut into overlapping pieces.
PIECE_WORDS = 20_000
#: Bytes of text that are held while several automata pass over them.
HELD_BYTES = 16 << 20


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of integers.

    Each state keeps its longest match length, its suffix link and the end positions
    (item, words up to here) at which its words were added.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[list[tuple[int, int]]] = [[]]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, item: int, words: list[int]) -> None:
        last = 0
        for k, c in enumerate(words, 1):
            p = last
            q = self.next[p].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            else:
                last = self._state(self.length[p] + 1, {}, 0)
                while p != -1 and c not in self.next[p]:
                    self.next[p][c] = last
                    p = self.link[p]
                if p != -1:
                    q = self.next[p][c]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            self.ends[last].append((item, k))

    def windows(self, need: list[int]) -> dict[int, list[tuple[int, int]]]:
        """By state: (item, need[item]) of the items of which a window ends where it matches.

        What ends in a state ends in the state of its link too; an item goes along as far
        as its window fits the state's longest match.
        """
        out = {s: {i for i, _ in ends if need[i] <= self.length[s]} for s, ends in enumerate(self.ends) if ends}
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            to = self.link[s]
            if to > 0 and s in out:
                out.setdefault(to, set()).update(i for i in out[s] if need[i] <= self.length[to])
        return {s: [(i, need[i]) for i in sorted(items)] for s, items in out.items() if items}

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matching length) after each word."""
        state, n = 0, 0
        follow, link, length = self.next, self.link, self.length
        for c in words:
            to = follow[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = follow[state].get(c)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            yield state, n


@dataclass
class Words:
    """A slab's words: byte ranges in the lower-cased bytes, each text's first, hit marks."""

    slab: bt.Slab

    def __post_init__(self) -> None:
        self.lower = bt.LOWER[self.slab.buf]
        self.start, self.end, self.first = self.slab.words(bt.ALNUM, self.lower)
        self.hit = np.zeros(len(self.start), bool)
        #: by text of the slab, the ids of the items that occur
        self.items: dict[int, set[str | None]] = {}


@dataclass
class Model:
    """An automaton over the items of a part, its vocabulary and pairs, and the windows."""

    automaton: SuffixAutomaton
    seed: int
    hashes: np.ndarray
    spelled: bytes
    bounds: np.ndarray
    pairs: np.ndarray
    singles: np.ndarray
    shortest: int
    least: int
    ids: list[str | None]
    windows: dict[int, list[tuple[int, int]]]
    _bytes: bt.Bytes | None = field(default=None, repr=False)

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Model:
        """items: (id, text); ids may repeat, null texts have no words."""
        texts = [[w.tobytes() for w in np.split(x.lower, np.stack([x.start, x.end], axis=1).ravel())[1::2]] if len(x.start) else [] for x in (Words(s) for _, t in items for s in bt.slabs(pa.array([t], pa.string())))]
        words = sorted({w for t in texts for w in t})
        joined = np.frombuffer(b"".join(words), np.uint8)
        bounds = np.cumsum([0, *map(len, words)])
        seed, hashes = -1, np.zeros(2, np.uint64)
        while seed < 0 or len(np.unique(hashes)) < len(words):
            seed += 1
            hashes = bt.Hasher(joined, seed)(bounds[:-1], bounds[1:])
        order = np.argsort(hashes)
        number = {words[k]: n for n, k in enumerate(order.tolist())}
        lists = [[number[w] for w in t] for t in texts]
        automaton = SuffixAutomaton()
        for k, w in enumerate(lists):
            automaton.add(k, w)
        size = len(words)
        pairs = np.unique(np.array([a * size + b for w in lists for a, b in zip(w, w[1:])], np.int64))
        need = [min(len(w), window) for w in lists]
        some = [n for n in need if n]
        singles = np.unique(np.array([w[0] for w in lists if len(w) == 1], np.int64))
        ranges = np.stack([bounds[:-1], bounds[1:]])[:, order]
        return cls(automaton, seed, hashes[order], joined.tobytes(), ranges, pairs, singles, min((n for n in some if n > 1), default=0), min(some, default=1), [i for i, _ in items], automaton.windows(need))

    def _numbers(self, words: Words) -> np.ndarray:
        """Each word's number in the vocabulary, -1 where it is none of it."""
        hasher = bt.Hasher(words.lower, self.seed)
        at = bt.found_in(hasher(words.start, words.end), self.hashes)
        known = np.flatnonzero(at >= 0)
        if self._bytes is None:
            self._bytes = bt.Bytes(np.frombuffer(self.spelled, np.uint8))
        start, end = self.bounds[:, at[known]]
        at[known[~bt.same_bytes(hasher.bytes, words.start[known], words.end[known], self._bytes, start, end)]] = -1
        return at

    def mark(self, words: Words) -> None:
        """Mark the hit words of a slab and the items that occur in its texts."""
        at, first, hit = self._numbers(words), words.first, words.hit
        size = len(self.hashes)
        go = np.zeros(len(at), dtype=bool)
        if self.shortest and len(at) > 1:
            joined = (at[:-1] >= 0) & (at[1:] >= 0)
            edges = first[1:-1]
            edges = edges[(edges > 0) & (edges < len(at))]
            joined[edges - 1] = False
            where = np.flatnonzero(joined)
            joined[where] = bt.found_in(at[where] * size + at[where + 1], self.pairs) >= 0
            change = np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8))
            runs = np.stack([np.flatnonzero(change == 1), np.flatnonzero(change == -1) + 1], axis=1)
            for a, b in runs[runs[:, 1] - runs[:, 0] >= self.shortest].tolist():
                self._stream(at, a, b, first, hit, words.items)
                go[a:b] = True
        if len(self.singles):
            for p in np.flatnonzero(np.isin(at, self.singles) & ~go).tolist():
                self._stream(at, p, p + 1, first, hit, words.items)

    def _stream(self, at: np.ndarray, a: int, b: int, first: np.ndarray, hit: np.ndarray, found: dict[int, set[str | None]]) -> None:
        link, length, windows = self.automaton.link, self.automaton.length, self.windows
        text = int(np.searchsorted(first, a, side="right")) - 1
        for p, (state, n) in enumerate(self.automaton.walk(at[a:b].tolist()), a + 1):
            # the state's match, then its suffixes, as far as a window ends in them
            while state > 0 and n >= self.least:
                for item, need in windows.get(state, ()):
                    if need <= n:
                        hit[p - need : p] = True
                        found.setdefault(text, set()).add(self.ids[item])
                state = link[state]
                n = length[state] if state > 0 else 0


_held: dict[str, Model] = {}


def _model(path: str) -> Model:
    """The model of a file; a process keeps the last one."""
    if path not in _held:
        _held.clear()
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(name) as f:
            _held[path] = pickle.loads(f.read())
    return _held[path]


def _item_pieces(window: int, most: int):
    """A function that cuts items of more than `most` words into pieces under the same id.

    Neighbours share window - 1 words, so every window of the item stands in a piece, and a
    piece has at least one. An automaton so holds no item whole, however long it is.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for slab in bt.slabs(texts):
                words = Words(slab)
                size = np.diff(words.first)
                if size.max(initial=0) <= most:
                    yield pa.record_batch([c.slice(slab.lo, slab.n) for c in (ids, texts)], ["id", "text"])
                    continue
                for k, (a, z) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist()), slab.lo):
                    if z - a <= most:
                        yield pa.record_batch([c.slice(k, 1) for c in (ids, texts)], ["id", "text"])
                        continue
                    for at in range(a, z - window + 1, most - window + 1):
                        piece = words.lower[words.start[at] : words.end[min(at + most, z) - 1]].tobytes().decode()
                        yield pa.record_batch([ids.slice(k, 1), pa.array([piece], texts.type)], ["id", "text"])

    return cut


def build_models(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Files in the shared folder, each the pickled Model of a part of the items.

    A null id is no id, but its text counts. Without items there is no file.
    """
    spark = benchmark.sparkSession
    ship(spark)
    words_each, folder = MODEL_WORDS, f"{uri(shared_dir(spark))}/items-{uuid.uuid4().hex}"
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # two bytes a word at least
    parts = max(1, -(-size // (2 * words_each)))
    items = items.mapInArrow(_item_pieces(window, max(PIECE_WORDS, 2 * window)), "id string, text string")
    items = items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["id"].to_pylist(), table["text"].to_pylist()), key=lambda r: (r[0] is None, r[0] or "", r[1] or ""))
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        # each attempt writes a file of its own; the rows name those of one attempt
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
            f.write(pickle.dumps(Model.of(rows, window)))
        return pa.table({"path": [f"{folder}/{name}"]})

    built = stored(items.groupBy("part").applyInArrow(build, "path string"), "models")
    return sorted(r.path for r in built.collect())


def _scan(paths: list[str]):
    """A function from a text column to its slabs' Words, marked by all models."""

    def scan(column: pa.Array) -> Iterator[Words]:
        held, size = [], 0
        for slab in bt.slabs(column):
            words = Words(slab)
            if len(paths) == 1:
                _model(paths[0]).mark(words)
                yield words
                continue
            held.append(words)
            size += len(slab.buf)
            if size >= HELD_BYTES:
                yield from passes(held)
                held, size = [], 0
        yield from passes(held)

    def passes(held: list[Words]) -> list[Words]:
        for path in paths if held else ():
            for words in held:
                _model(path).mark(words)
        return held

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words. Items whose id is null mark words but are not
    counted or listed; an id that several rows bear counts once. Without items, or with
    items without words, nothing is hit. Rows repeat as given.
    """
    scan = _scan(build_models(benchmark, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, hits, items = [], [], {}
            for x in scan(b.column(1)):
                words.append(np.diff(x.first))
                hits.append(bt.segment_sums(x.hit.astype(np.int64), x.first))
                items.update({x.slab.lo + k: ids for k, ids in x.items.items()})
            names = [sorted({i for i in items.get(k, ()) if i is not None}) for k in range(b.num_rows)]
            none = np.zeros(0, np.int64)
            hits = np.concatenate([*hits, none])
            yield pa.record_batch(
                [b.column(0), pa.array(np.concatenate([*words, none])), pa.array(hits), pa.array([len(n) for n in names], pa.int64()), pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names]), pa.array(hits > 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with hit spans cut out of their texts; all other columns stay as they are.

    A maximal run of hit words goes, from its first word's begin to its last word's end,
    with the white space after it. A document of whose words more than max_coverage are
    hit goes whole. Null texts stay null; a column n_chars, where there is one, is set
    anew for the texts that change.
    """
    scan = _scan(build_models(benchmark, window))
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            change: dict[int, str | None] = {}
            for x in scan(column):
                slab, first, hit, start, end = x.slab, x.first, x.hit, x.start, x.end
                count = bt.segment_sums(hit.astype(np.int64), first)
                for k in np.flatnonzero(count).tolist():
                    lo, hi = first[k], first[k + 1]
                    if count[k] > max_coverage * (hi - lo):
                        change[slab.lo + k] = None
                        continue
                    edge = np.diff(np.concatenate([[False], hit[lo:hi], [False]]).astype(np.int8))
                    out, done = [], int(slab.off[k])
                    for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                        out.append(slab.buf[done : start[lo + a]].tobytes())
                        done = int(end[lo + z - 1])
                        while done < slab.off[k + 1] and not bt.NOT_SPACE[slab.buf[done]]:
                            done += 1
                    out.append(slab.buf[done : slab.off[k + 1]].tobytes())
                    change[slab.lo + k] = b"".join(out).decode("utf-8", "replace")
            if not change:
                yield b
                continue
            texts = column.to_pylist()
            for k, v in change.items():
                texts[k] = v
            keep = pa.array([change.get(k, "") is not None for k in range(b.num_rows)])
            cols = [pa.array(texts, column.type) if i == at else c for i, c in enumerate(b.columns)]
            if names.count("n_chars") == 1 and pa.types.is_integer(cols[names.index("n_chars")].type):
                i = names.index("n_chars")
                was = cols[i].to_pylist()
                cols[i] = pa.array([len(texts[k]) if change.get(k) is not None else v for k, v in enumerate(was)], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)


#: The same result in SQL: every window of the items against every window of the documents.
ORACLE = """
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, least(n, 10) AS k, array_to_string(w[p:p + least(n, 10) - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, n - least(n, 10) + 2)) AS p FROM i)),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw))),
m AS (SELECT DISTINCT r, p, dw.k AS k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""

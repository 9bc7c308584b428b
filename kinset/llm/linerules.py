"""Line-first cleaning: rules per line, failing lines go, then whole documents are judged.

Words are ``[^\\x20\\x09-\\x0D]+``; lines are what stands between ``\\n``; a line without a
word is no line for the rules and stays where it is. A line with a word fails as

* punctuation: signs ``#*$%&<>`` (3 at least, one for every second word), exclamation
  marks (3 at least, one for every third word), or fewer than 4 words without a closing
  sign at the end;
* navigation: separators ``| > » • ·`` (2 at least, one for every third word);
* boilerplate: one of ``PHRASES`` or ``LICENCE`` stands in it (A-Z lower-cased), or an
  earlier line of the text is equal to it, byte by byte.

A document is kept unless it has fewer than 10 words, more than a fifth of its words stand
in repeated 5-word windows, or its failing lines hold more than ``MAX_LOST`` of its words.
Lines that fail for a licence notice only are removed, but not held against the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.llm import bytetext as bt
from kinset.llm.common import ship
from kinset.llm.features import _earlier, _marks, _per_word

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Percent of a document's words that failing lines may hold.
MAX_LOST = 40

PHRASES = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "use cookies",
    "uses cookies",
    "enable javascript",
    "click here",
    "read more",
    "sign up for",
    "subscribe to our",
    "log in to",
    "share this",
    "follow us on",
    "skip to content",
    "back to top",
    "powered by",
    "copyright (c)",
    "lorem ipsum",
)
#: Licence notices: their lines go too, but a text with one is not the worse for it.
LICENCE = ("licensed under", "public license", "apache license", "mit license")

_SIGNS = _marks("#*$%&|<>")
_CODE = _marks("#*$%&<>")
_BARS = _marks("|>")
#: Separators of more than one byte: » • ·
_WIDE_BARS = tuple(c.encode() for c in "»•·")
_CLOSING = _marks(".!?:;,\"')]")
#: Closing signs of more than one byte: … ” » 。
_WIDE_CLOSING = tuple(c.encode() for c in "…”»。")


def _at(buf: np.ndarray, sign: bytes) -> np.ndarray:
    """Positions (as a mask) at which the bytes of sign begin."""
    out = np.zeros(len(buf), bool)
    k = len(sign)
    if len(buf) >= k:
        out[: len(buf) - k + 1] = np.logical_and.reduce([buf[i : len(buf) - k + 1 + i] == sign[i] for i in range(k)])
    return out


class Lines:
    """A slab's texts by word and line, with the base counts and each line's verdict."""

    def __init__(self, slab: bt.Slab):
        buf = slab.buf
        self.slab = slab
        hasher = bt.Hasher(buf)
        start, end, first = slab.words(bt.NOT_SPACE)
        self.n_words = np.diff(first)
        text = np.repeat(np.arange(slab.n), self.n_words)
        is_word = bt.NOT_SPACE[buf]
        self.word_chars = slab.per_text(is_word & bt.LEADS[buf])
        self.n_symbols = slab.per_text(_SIGNS[buf])
        self.n_repeat_words = self._repeated(hasher.exact(start, end), text, first)
        lo, hi, self.line_first = slab.lines()
        self.lo, self.hi = lo, hi
        begins = np.zeros(len(buf), bool)
        begins[start] = True
        self.line_words = w = _per_word(begins, lo, hi)
        self.has = w > 0
        line_text = np.repeat(np.arange(slab.n), np.diff(self.line_first))
        again = np.zeros(len(lo), bool)
        again[self.has] = _earlier(hasher.exact(lo[self.has], hi[self.has]), line_text[self.has])[0]
        self.n_dup_lines = bt.segment_sums(again.astype(np.int64), self.line_first)
        bars = _BARS[buf]
        for sign in _WIDE_BARS:
            bars |= _at(buf, sign)
        bars, code, shouts = (_per_word(x, lo, hi) for x in (bars, _CODE[buf], buf == 33))
        junk = self.has & (
            again
            | ((bars >= 2) & (3 * bars >= w))
            | ((code >= 3) & (2 * code >= w))
            | ((shouts >= 3) & (3 * shouts >= w))
            | ((w < 4) & ~self._closed(end, first, lo, hi))
            | self._phrases(lo, PHRASES)
        )
        self.fails = junk | (self.has & self._phrases(lo, LICENCE))
        self.lost = bt.segment_sums(np.where(self.fails, w, 0), self.line_first)
        held = bt.segment_sums(np.where(junk, w, 0), self.line_first)
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEATED_PERCENT * self.n_words)
        self.kept = ~self.base_failed & (100 * held <= MAX_LOST * self.n_words)

    def _repeated(self, h: np.ndarray, text: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(h) - WINDOW + 1
        if n < 1:
            return np.zeros(self.slab.n, np.int64)
        inside = text[:n] == text[WINDOW - 1 :]
        many = np.zeros(n, bool)
        many[inside] = _earlier(text[:n][inside], *(h[i : i + n][inside] for i in range(WINDOW)))[1] > 1
        cover = np.zeros(len(h) + 1, np.int64)
        cover[:n] += many
        cover[WINDOW : WINDOW + n] -= many
        return bt.segment_sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), first)

    def _closed(self, end: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether each line's last word ends in a closing sign."""
        buf = self.slab.buf
        out = np.zeros(len(lo), bool)
        last = np.searchsorted(end, hi, side="right") - 1
        stop = end[last[self.has]] if len(end) else np.zeros(0, np.int64)
        good = _CLOSING[buf[stop - 1]]
        for sign in _WIDE_CLOSING:
            begin = stop - len(sign)
            good |= (begin >= 0) & _at(buf, sign)[np.maximum(begin, 0)]
        out[self.has] = good
        return out

    def _phrases(self, lo: np.ndarray, phrases: tuple[str, ...]) -> np.ndarray:
        out = np.zeros(len(lo), bool)
        lower = bt.LOWER[self.slab.buf].tobytes()
        for phrase in phrases:
            raw = phrase.encode()
            at = lower.find(raw)
            while at >= 0:
                # a text's end, too, ends a line
                line = int(np.searchsorted(lo, at, side="right")) - 1
                if at + len(raw) <= self.hi[line]:
                    out[line] = True
                at = lower.find(raw, at + 1)
        return out

    def cleaned(self, k: int) -> bytes | None:
        """The bytes of text k without its failing lines; None where no line fails."""
        a, z = self.line_first[k], self.line_first[k + 1]
        if not self.fails[a:z].any():
            return None
        return b"\n".join(self.slab.buf[self.lo[i] : self.hi[i]].tobytes() for i in range(a, z) if not self.fails[i])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of op9, one row for each of docs: counts, base_failed, kept, lost_words.

    A null or empty text has no words and fails the base rules. Rows repeat as given.
    """
    ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Lines(s) for s in bt.slabs(b.column(1))]
            if got:
                cols = [pa.array(np.concatenate([getattr(x, n) for x in got])) for n in [*names, "base_failed", "kept", "lost"]]
                yield pa.record_batch([b.column(0), *cols], names=["doc_id", *names, "base_failed", "kept", "lost_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, lost_words long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents without their failing lines; all other columns stay as they are."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = b.column(at).to_pylist(), []
            for slab in bt.slabs(b.column(at)):
                lines = Lines(slab)
                keep += lines.kept.tolist()
                for k in np.flatnonzero(lines.kept).tolist():
                    new = lines.cleaned(k)
                    if new is not None:
                        texts[slab.lo + k] = new.decode("utf-8", "replace")
            cols = [pa.array(texts, b.column(at).type) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _oracle() -> str:
    word = "'[^\\x20\\x09-\\x0D]+'"
    lower = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases, licence = (" OR ".join(f"contains({lower}, '{p}')" for p in x) for x in (PHRASES, LICENCE))
    junk = "again OR (bars >= 2 AND 3 * bars >= n) OR (code >= 3 AND 2 * code >= n) OR (shouts >= 3 AND 3 * shouts >= n) OR (n < 4 AND NOT closed) OR boiler"
    count = lambda signs: f"len(regexp_extract_all(line, '{signs}'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, {word}) AS w FROM d),
g AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM w)),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(p, p + 5)) AS q FROM (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1) GROUP BY r),
l AS (SELECT r, k, lines[k] AS line FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT r, string_split(text, chr(10)) AS lines FROM d))),
lw AS (SELECT r, k, line, len(regexp_extract_all(line, {word})) AS n FROM l),
m AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again, {count('[|>»•·]')} AS bars, {count('[#*$%&<>]')} AS code, {count('!')} AS shouts,
  regexp_matches(line, '[.!?:;,"'')\\]…”»。][\\x20\\x09-\\x0D]*$') AS closed, ({phrases}) AS boiler, ({licence}) AS notice FROM lw WHERE n > 0),
s AS (SELECT r, sum(CASE WHEN again THEN 1 ELSE 0 END)::BIGINT AS dups,
  sum(CASE WHEN {junk} OR notice THEN n ELSE 0 END)::BIGINT AS lost, sum(CASE WHEN {junk} THEN n ELSE 0 END)::BIGINT AS held FROM m GROUP BY r),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dups, 0) AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost_words, coalesce(held, 0) AS held FROM w LEFT JOIN rep USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND 100 * held <= {MAX_LOST} * n_words AS kept, lost_words FROM b
"""


#: The same result in SQL.
ORACLE = _oracle()

"""Token counts by overlap resynchronisation.

A text of up to ``CHUNK`` bytes is encoded whole. A longer one is encoded in chunks that
overlap; each chunk's tokens get byte offsets, and two neighbours are spliced at a common
boundary in their overlap: left of it the earlier chunk's tokens count, right of it the later
one's. A boundary is common where both chunks end a token. It is proven stable where no piece
of the vocabulary holds the two characters that meet there side by side: pieces are merged
from neighbours, so none can ever reach across, whatever stands further off. (The space is
one of these characters, so the begin of most words is such a place; the others are breaks
that the vocabulary lacks, as between many CJK signs, digits, or letters and signs.) Where an
overlap has no stable boundary it is widened, up to the last splice; where that has none
either, the chunk's length is doubled and it is encoded anew, so the work stays in proportion
to the text.

The model puts a space before every text it encodes. A chunk's tokens count only behind a
stable boundary inside it, which that space does not reach.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinset.llm.common import ship

MODEL = "piece_bpe_32k.model"
CHUNK = 32 << 10
OVERLAP = 256
LIMIT = 4096
#: Bytes of short texts that are encoded in one call.
BATCH_BYTES = 1 << 20

_SPACE = "▁"
_loaded: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts the pieces of texts by a sentencepiece model."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        #: source bytes of each piece
        self.size = np.array([1 if self.model.is_byte(i) else len(p.replace(_SPACE, " ").encode()) for i, p in enumerate(pieces)])
        #: whether the model reads texts as they are, but for the space it puts before them
        self.separable = self._bytes(" a  b ") == 7 and self._bytes("ﬁ  ") == len("ﬁ  ".encode()) + 1
        #: the characters that stand side by side in some piece, as one number each
        joined = "\0".join(p.replace(_SPACE, " ") for i, p in enumerate(pieces) if not self.model.is_byte(i))
        self.inside = np.unique(_neighbours(joined))
        self.widened = 0

    def _bytes(self, text: str) -> int:
        return int(self.size[self.model.encode(text, num_threads=1)].sum())

    def counts(self, texts: list[str]) -> list[int]:
        out, part, size = [0] * len(texts), [], 0
        for k, t in enumerate(texts):
            if len(t) > self.chunk // 4 and len(raw := t.encode()) > self.chunk and self.separable:
                # the sign that stands for spaces inside the model is read as one
                out[k] = self.long(raw if _SPACE not in t else t.replace(_SPACE, " ").encode())
                continue
            part.append(k)
            size += len(t)
            if size >= BATCH_BYTES:
                self._whole(texts, part, out)
                part, size = [], 0
        self._whole(texts, part, out)
        return out

    def _whole(self, texts: list[str], part: list[int], out: list[int]) -> None:
        for k, ids in zip(part, self.model.encode([texts[k] for k in part], num_threads=1)):
            out[k] = len(ids)

    def _ends(self, raw: bytes, lo: int, hi: int) -> np.ndarray | None:
        """Offsets in raw at which the tokens of raw[lo:hi] end; None if they do not add up."""
        ids = self.model.encode(raw[lo:hi].decode("utf-8"), num_threads=1)
        ends = lo - 1 + np.cumsum(self.size[ids]) if ids else np.array([lo])
        return ends if ends[-1] == hi else None

    def _stable(self, raw: bytes, lo: int, hi: int) -> np.ndarray:
        """Proven boundaries behind lo and before hi, two code point boundaries of raw."""
        text = raw[lo:hi].decode("utf-8")
        lead = np.frombuffer(raw, np.uint8, hi - lo, lo)
        at = lo + np.flatnonzero((lead & 0xC0) != 0x80)
        return at[1:][~np.isin(_neighbours(text), self.inside)]

    def _last_stable(self, raw: bytes, lo: int, hi: int) -> np.ndarray:
        """Proven boundaries in the least widened overlap before hi that has any, if any."""
        overlap = self.overlap
        while True:
            back = max(lo, self._back(raw, hi - overlap))
            found = self._stable(raw, back, hi)
            if len(found) or back == lo:
                return found
            self.widened += 1
            overlap *= 2

    def long(self, raw: bytes) -> int:
        """Tokens of a long text."""
        n, total, chunk = len(raw), 0, self.chunk
        lo, counted = 0, -1  # the chunk's begin; tokens that end up to here are counted
        hi = self._cut(raw, min(chunk, n))
        ends = self._ends(raw, lo, hi)
        while hi < n:
            # a boundary nearer to the chunk's end than to the overlap's: both sides see it
            found = self._last_stable(raw, max(counted, 0), hi) if ends is not None else ()
            if len(found):
                at = int(found[len(found) // 2])
                start = self._back(raw, max(0, at - self.overlap))
                stop = self._cut(raw, min(hi + self.chunk, n))
                later = self._ends(raw, start, stop)
                if later is not None and at in later and at in ends:
                    total += int(np.count_nonzero((ends > counted) & (ends <= at)))
                    counted, lo, hi, ends, chunk = at, start, stop, later, self.chunk
                    continue
            # nothing to splice at: twice the length
            self.widened += 1
            chunk *= 2
            hi = self._cut(raw, min(lo + chunk, n))
            ends = self._ends(raw, lo, hi)
        if ends is None:
            return len(self.model.encode(raw.decode("utf-8"), num_threads=1))
        return total + int(np.count_nonzero(ends > counted))

    @staticmethod
    def _cut(raw: bytes, at: int) -> int:
        """The first code point boundary from at on."""
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    @staticmethod
    def _back(raw: bytes, at: int) -> int:
        """The last code point boundary up to at."""
        at = max(at, 0)
        while at > 0 and at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at


def _neighbours(text: str) -> np.ndarray:
    """Each pair of characters that meet in a text, as one number."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return points[:-1] << np.uint64(21) | points[1:]


def counter(model: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> PieceCounter:
    """The counter of a model, loaded once in a process; a bare name is a public vocabulary."""
    key = f"{model}:{chunk}:{overlap}"
    if key not in _loaded:
        path = model
        if os.sep not in model:
            import public_tokenizers

            path = public_tokenizers.path(model)
        _loaded[key] = PieceCounter(path, chunk, overlap)
    return _loaded[key]


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    A null text counts as empty: no bytes and what the model gives for the empty text.
    Rows repeat as given. model: a file's path on every machine, or a public vocabulary's name.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).counts
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                n = count([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
